"""Documents to graph tables in one go, with a status for each file."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import definition_term, trace_id
from ..session import written
from ..sources.graph_store import GraphStore
from . import chunking, extraction, graph
from .numbering import ranked

#: Fewest characters of a chunk, by mode. Fixed values.
LEAST = {"document": 40, "dictionary": 5, "document_structured": 40, "book": 40, "semantic": 10}


@dataclass(frozen=True)
class Ingestion:
    """How documents become chunks, and how a batch of files is taken in.

    stop_on_error: files behind the first that fails, in order of path, are left out. save_per_file: the graph gets a version for each
    file in turn, else one for all. max_files: the first so many in order of path.
    """

    mode: str = "document"
    stop_on_error: bool = False
    save_per_file: bool = False
    max_files: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in LEAST:
            raise ValueError(f"mode must be one of {', '.join(LEAST)}")
        if self.max_files is not None and self.max_files < 1:
            raise ValueError("max_files must be at least 1")

    def cut(self, docs: DataFrame) -> DataFrame:
        """The chunks with all that their cutter tells."""
        cut = {"document": chunking.document_chunks, "dictionary": chunking.dictionary_chunks, "document_structured": chunking.structured_chunks, "book": chunking.book_chunks, "semantic": chunking.semantic_chunks}[self.mode]
        return cut(docs, LEAST[self.mode])

    def chunks(self, docs: DataFrame) -> DataFrame:
        """doc_id, text (and boost, where headings announce definitions)."""
        out = self.cut(docs)
        return out.select("doc_id", "text", *(["boost"] if "boost" in out.columns else []))


def ingested(docs: DataFrame, how: Ingestion = Ingestion()) -> dict[str, DataFrame]:
    """chunks (written), definitions, claims, triples, nodes, edges of docs (doc_id, text)."""
    chunks = written(how.chunks(docs), "chunks")
    definitions, triples = extraction.definitions(chunks), written(extraction.relationships(chunks), "triples")
    edges = graph.edge_table(triples)
    return {"chunks": chunks, "definitions": definitions, "claims": extraction.claims(chunks), "triples": triples, "nodes": graph.definition_nodes(definitions), "edges": edges}


def told_files(spark: SparkSession, paths: list[str], how: Ingestion = Ingestion()) -> DataFrame:
    """path, text, error of the files that a batch takes, as a written table. A file that is not UTF-8 or holds nothing is an error of its own row."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    if how.max_files is not None:
        files = files.join(files.select("path").orderBy("path").limit(how.max_files), "path", "left_semi")
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    told = files.select("path", text.alias("text")).withColumn("error", F.when(F.col("text").isNull(), "not UTF-8").when(~F.col("text").rlike(r"\S"), "empty"))
    told = written(told, "files")
    if how.stop_on_error:
        first = told.filter("error is not null").agg(F.min("path").alias("_first"))
        told = told.crossJoin(F.broadcast(first)).filter(F.col("_first").isNull() | (F.col("path") <= F.col("_first"))).drop("_first")  # one row
    return told


def file_report(spark: SparkSession, paths: list[str], how: Ingestion = Ingestion(), first: int | None = None) -> DataFrame:
    """path, success, error, n_chunks, n_definitions, n_triples: a row for each of the files, in order of path, the first so many if asked.

    Files are read whole, in parallel. A file that fails stops no other, unless how.stop_on_error says so.
    """
    docs = told_files(spark, paths, how if first is None else replace(how, max_files=first))
    parts = ingested(docs.filter("error is null").select(F.col("path").alias("doc_id"), "text"), how)
    out = docs.select("path", F.col("error").isNull().alias("success"), "error")
    for name in ("chunks", "definitions", "triples"):
        n = parts[name].groupBy(F.col("doc_id").alias("_p")).agg(F.count(F.lit(1)).alias(f"_{name}"))
        out = out.join(n, F.col("path") == F.col("_p"), "left").drop("_p").withColumn(f"n_{name}", F.coalesce(f"_{name}", F.lit(0))).drop(f"_{name}")
    return out.orderBy("path")


def graph_rows(docs: DataFrame, how: Ingestion = Ingestion()) -> dict[str, DataFrame]:
    """nodes, edges, traces of docs (doc_id, text) as a GraphStore takes them."""
    chunks = written(how.chunks(docs), "chunks")
    source, method = F.col("doc_id").cast("string"), F.lit("definition_extractor")
    nodes = graph.definition_nodes(extraction.definitions(chunks))
    about = F.to_json(F.struct(F.lit("definition").alias("category"), definition_term(F.col("term")).alias("term"), F.col("value").alias("definition_text"), F.lit(how.mode).alias("ingestion_mode")))
    nodes = nodes.select("id", "value", F.lit("Entity").alias("sem_type"), F.lit(1.0).alias("salience"), F.lit(0).cast("long").alias("step"), source.alias("source_id"), method.alias("method"), "confidence", trace_id(source, "definition_extractor", F.lit(0)).alias("trace_id"), F.parse_json(about).alias("metadata"))
    said = extraction.relationships(chunks).select("src", "dst", "relation", F.lit(0.75).alias("salience"), F.col("pos").cast("long").alias("step"), trace_id(source, "relationship_extractor", F.col("pos")).alias("trace_id"))
    return {"nodes": nodes, "edges": said.drop("trace_id"), "traces": said.drop("salience")}


def ingest_files(store: GraphStore, paths: list[str], how: Ingestion = Ingestion()) -> DataFrame:
    """Take files into a stored graph; path, success, error, version, seconds. seconds: of the upsert that took the file in."""
    spark = store.spark
    docs = told_files(spark, paths, how)
    good = docs.filter("error is null").select(F.col("path").alias("doc_id"), "text")
    names = [r["path"] for r in docs.filter("error is null").select("path").orderBy("path").toLocalIterator()] if how.save_per_file else [None]
    done = []
    for name in names:  # a version a file is what was asked for
        began = time.monotonic()
        version = store.upsert(**graph_rows(good if name is None else good.filter(F.col("doc_id") == name), how))
        done.append((name, version, round(time.monotonic() - began, 3)))
    saved = spark.createDataFrame(done, "_path string, version int, seconds double")
    same = F.col("error").isNull() & (F.lit(True) if not how.save_per_file else F.col("path") == F.col("_path"))
    return docs.join(F.broadcast(saved), same, "left").select("path", F.col("error").isNull().alias("success"), "error", "version", "seconds").orderBy("path")


def knowledge_items(docs: DataFrame, how: Ingestion = Ingestion()) -> DataFrame:
    """key, kind, content, doc_id, confidence: `title::claim::i` for the claims of a document in order, `title::defn::term` for definitions, of repeats the last.

    docs: doc_id, title, text. Claims are numbered over sorted ranges. Structured and book modes register definitions only.
    """
    named = docs.select("doc_id", "title", "text").filter("text is not null")
    parts = written(how.cut(named.select(F.struct("doc_id", "title").alias("doc_id"), "text")), "item-chunks")
    place = next(c for c in ("seq", "line", "para", "position", "group") if c in parts.columns)
    own = parts.select(F.struct(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.title").alias("title"), F.col(place).alias("at")).alias("doc_id"), "text", *(["boost"] if "boost" in parts.columns else []))
    said = extraction.definitions(own).select("doc_id.id", "doc_id.title", "doc_id.at", "pos", "term", "definition", "confidence")
    last = said.groupBy("id", "title", "term").agg(F.max_by(F.struct("definition", "confidence"), F.struct("at", "pos")).alias("l"))
    out = last.select(F.concat_ws("::", "title", F.lit("defn"), "term").alias("key"), F.lit("definition").alias("kind"), F.col("l.definition").alias("content"), F.col("id").alias("doc_id"), F.col("l.confidence").alias("confidence"))
    if how.mode in ("document_structured", "book"):
        return out
    claims = ranked(extraction.claims(own).select("doc_id.id", "doc_id.title", "doc_id.at", "pos", "claim"), ["id", "title"], ["at", "pos"], "i")
    return out.unionByName(claims.select(F.concat_ws("::", "title", F.lit("claim"), (F.col("i") - 1).cast("string")).alias("key"), F.lit("claim").alias("kind"), F.col("claim").alias("content"), F.col("id").alias("doc_id"), F.lit(0.7).alias("confidence")))


def report_totals(files: DataFrame) -> DataFrame:
    """One row: files, ok, failed, and sums over those that are ok."""
    ok = lambda c: F.sum(F.when(F.col("success"), F.col(c)).otherwise(0)).alias(c)
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), ok("n_chunks"), ok("n_definitions"), ok("n_triples"))
