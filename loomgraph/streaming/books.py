"""Books into a stored graph, chapter by chapter; a run that stopped goes on where it was.

Books come as a stream (doc_id, text). Spark's checkpoint says which files a batch holds, so a batch that is run again holds the same books.
Its chapters are taken in `parts` by a hash of their id. A part's graph rows go into the store first, then a manifest row for each of
its chapters is written: a part with a finished manifest is passed over, one that stopped in between is done again, and the
store takes rows that it has without a change. So a run that was stopped anywhere ends as one that was not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import definition_term, node_id, trace_id
from ..operators import chunking, extraction
from ..session import deleted, scratch
from ..sources.graph_store import GraphStore

MANIFEST = "doc_id string, chapter int, chapter_id string, title string, chunk_mode string, status string, n_chunks long, n_definitions long, n_relationships long"


def book_stream(spark: SparkSession, path: str, files_a_batch: int | None = None, bytes_a_batch: int = 8 << 30) -> DataFrame:
    """doc_id, text of the Parquet files in a folder (or of one file), as a stream; batches by bytes, unless a number of files is given.

    Each batch's upserts rewrite the buckets of the store, so the number of batches must not grow with that of small files.
    """
    schema = spark.read.parquet(path).schema
    limit = ("maxBytesPerTrigger", bytes_a_batch) if files_a_batch is None else ("maxFilesPerTrigger", files_a_batch)
    return spark.readStream.schema(schema).option(*limit).parquet(f"{path[:-1]}[{path[-1]}]").select("doc_id", "text")  # a pattern, so that a single file will do


def book_rows(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions and triples of chunks (as chunking.book_chunks makes them), with what is known of each chunk as `of`."""
    own = chunks.select(F.struct("doc_id", "chapter_id", "mode", "position", "chunk_id", "location").alias("doc_id"), "text")
    return extraction.definitions(own).withColumnRenamed("doc_id", "of"), extraction.relationships(own).withColumnRenamed("doc_id", "of")


def book_nodes(definitions: DataFrame) -> DataFrame:
    """Definition nodes as the store has them; metadata names the book, the chapter, the chunk and, in glossaries, the line."""
    said = F.concat("term", F.lit(" is "), "definition", F.lit("."))
    source = F.concat(F.lit("book:"), F.col("of.doc_id").cast("string"))
    line = F.when(F.col("of.mode") == "glossary", F.col("of.position"))
    about = F.struct(
        F.lit("definition").alias("category"), definition_term(F.col("term")).alias("term"), said.alias("definition_text"), F.lit("book").alias("ingestion_mode"), F.col("of.mode").alias("chunk_mode"), F.col("of.chunk_id").alias("chunk_id"),
        F.col("of.doc_id").cast("string").alias("book_id"), F.col("of.chapter_id").alias("chapter_id"), F.col("pos").alias("paragraph_index"), line.alias("line_index"),
    )
    return definitions.select(
        node_id(F.lit("Entity"), said).alias("id"), said.alias("value"), F.lit("Entity").alias("sem_type"), F.lit(1.0).alias("salience"), F.col("pos").cast("long").alias("step"), source.alias("source_id"), F.lit("definition_extractor").alias("method"), "confidence",
        trace_id(source, "definition_extractor", F.col("pos")).alias("trace_id"), F.parse_json(F.to_json(about)).alias("metadata"),
    )


def book_edges(triples: DataFrame, salience: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Edges and their traces as the store has them; the step is the chunk's place in its chapter."""
    source, step = F.concat(F.lit("book:"), F.col("of.doc_id").cast("string")), F.col("of.position").cast("long")
    rows = triples.select("src", "dst", "relation", F.lit(salience).alias("salience"), step.alias("step"), trace_id(source, "relationship_extractor", F.concat(F.col("of.chapter_id"), F.lit(":"), step.cast("string"), F.lit(":"), F.col("pos").cast("string"))).alias("trace_id"))
    return rows.select("src", "dst", "relation", "salience", "step"), rows.select("src", "dst", "relation", "trace_id", "step")


def ingest_books(stream: DataFrame, at: str, store: GraphStore, parts: int = 1, after_part: Callable[[int, int], None] | None = None) -> DataFrame:
    """Take all books that are there into the store; the manifest so far. `at` is the folder of this ingestion: checkpoint, manifest and the chapters of an unfinished batch.

    after_part is called behind each finished part, with the numbers of the batch and the part.
    """
    spark = store.spark

    def take(batch: DataFrame, number: int) -> None:
        place = lambda part: f"{at}/manifest/batch={number}/part={part}"
        left = [part for part in range(parts) if not finished(place(part))]
        kept = f"{at}/chapters/batch={number}"  # until the batch is done, also over a stop: a batch holds the same books when it is run again
        own = F.pmod(F.xxhash64("chapter_id"), F.lit(parts))
        if left and not finished(kept):
            chunking.chapters(batch.filter("doc_id is not null and text is not null")).filter(own.isin(left)).write.mode("overwrite").parquet(kept)
        for part in left:
            mine = spark.read.parquet(kept).filter(own == part)
            with scratch(spark) as write:
                titles = mine.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chapter").cast("int").alias("chapter"), "chapter_id", "title")
                take_part(titles, write(chunking.chapter_chunks(mine), "chunks"), place(part), write)
            if after_part:
                after_part(number, part)
        deleted(spark, kept)

    def finished(place: str) -> bool:
        done, files = store._hadoop(f"{place}/_SUCCESS")
        return files.exists(done)

    def take_part(titles: DataFrame, chunks: DataFrame, place: str, write: Callable[[DataFrame, str], DataFrame]) -> None:
        definitions, triples = (write(x, "rows") for x in book_rows(chunks))
        edges, traces = book_edges(triples)
        store.upsert(nodes=book_nodes(definitions), edges=edges, traces=traces)
        out = titles
        for name, rows, key in (("n_chunks", chunks, "chapter_id"), ("n_definitions", definitions, "of.chapter_id"), ("n_relationships", triples, "of.chapter_id")):
            out = out.join(rows.groupBy(F.col(key).alias("chapter_id")).agg(F.count(F.lit(1)).alias(name)), "chapter_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
        modes = chunks.groupBy("chapter_id").agg(F.min("mode").alias("chunk_mode"))
        out.join(modes, "chapter_id", "left").withColumn("status", F.when(F.col("n_chunks") > 0, "complete").otherwise("empty")).select(*(c.split()[0] for c in MANIFEST.split(", "))).write.mode("overwrite").parquet(place)

    query = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(take).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return manifest(spark, at)


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """A row for each chapter that has been taken in."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{at}/manifest")


def book_status(chapters: DataFrame) -> DataFrame:
    """doc_id, chapters, empty, n_chunks, n_definitions, n_relationships: a book's manifest rows added up."""
    return chapters.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chapters"), F.count_if(F.col("status") == "empty").alias("empty"), *(F.sum(c).alias(c) for c in ("n_chunks", "n_definitions", "n_relationships")))
