"""Command lines: `python -m loomgraph batch|books|ask --state FOLDER ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import definition_term, query_term
from .operators import graph_queries, ingest, routing
from .session import session, ship
from .sources.graph_store import GraphStore, rebuilt_definitions
from .streaming import books


def batch(store: GraphStore, asked: argparse.Namespace) -> DataFrame:
    """Files or folders into the graph; a row for each file."""
    how = ingest.Ingestion(asked.mode, asked.stop_on_error, asked.save_per_file, asked.max_files)
    return ingest.ingest_files(store, asked.paths, how)


def take_books(store: GraphStore, asked: argparse.Namespace) -> DataFrame:
    """Text files as books, chapter by chapter; a later call goes on with what is new. A row for each book."""
    read = store.spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", asked.files_a_batch).load(asked.folder)
    told = read.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return books.book_status(books.ingest_books(told, f"{asked.state}/books", store, asked.parts))


def ask(store: GraphStore, asked: argparse.Namespace) -> DataFrame:
    """question, operator, term, answer, source: definitions and direct relations of what questions ask for; without an answer, a null."""
    spark = store.spark
    routed = routing.route(spark.createDataFrame([(n, q) for n, q in enumerate(asked.questions)], "n long, question string"), "question")
    known = rebuilt_definitions(store.read("nodes"))
    best = known.groupBy(definition_term(F.col("term")).alias("_k")).agg(F.min_by(F.struct("definition", "source_id"), F.struct(-F.col("confidence"), "node_id")).alias("d"))
    defined = routed.filter("operator = 'discourse.GET_DEFINITION'").join(best, definition_term(F.col("term")) == F.col("_k"), "left").select("n", "question", "operator", "term", F.col("d.definition").alias("answer"), F.col("d.source_id").alias("source"))
    edges = store.read("edges").withColumn("confidence", F.col("salience"))
    related = routed.filter("operator = 'discourse.GET_RELATIONSHIPS'")
    nodes = store.read("nodes").select(query_term(F.col("value")).alias("value"))
    hops = graph_queries.one_hop(related.select("term", F.col("relation_type").alias("relation")), edges, nodes)
    hops = hops.groupBy("term", F.col("relation").alias("relation_type")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("rank", "target")))), lambda x: x["target"]), ", ").alias("answer"))
    told = related.join(hops, ["term", "relation_type"], "left").select("n", "question", "operator", "term", F.when(F.col("answer") != "", F.col("answer")).alias("answer"), F.lit(None).cast("string").alias("source"))
    rest = routed.filter("operator not in ('discourse.GET_DEFINITION', 'discourse.GET_RELATIONSHIPS')").select("n", "question", "operator", "term", *(F.lit(None).cast("string").alias(c) for c in ("answer", "source")))
    return defined.unionByName(told).unionByName(rest).orderBy("n").drop("n", *([] if asked.provenance else ["source"]))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    kinds = parser.add_subparsers(required=True)
    for name, run in (("batch", batch), ("books", take_books), ("ask", ask)):
        kind = kinds.add_parser(name, description=run.__doc__)
        kind.add_argument("--state", required=True, help="folder of the graph, as a path that all executors can reach")
        kind.add_argument("--buckets", type=int, default=64)
        kind.set_defaults(run=run)
        if run is batch:
            kind.add_argument("--mode", default="document", choices=sorted(ingest.LEAST))
            kind.add_argument("--stop-on-error", action="store_true")
            kind.add_argument("--save-per-file", action="store_true")
            kind.add_argument("--max-files", type=int)
            kind.add_argument("paths", nargs="+")
        elif run is take_books:
            kind.add_argument("--parts", type=int, default=1)
            kind.add_argument("--files-a-batch", type=int, default=8)
            kind.add_argument("folder")
        else:
            kind.add_argument("--no-provenance", dest="provenance", action="store_false")
            kind.add_argument("questions", nargs="+")
    asked = parser.parse_args(args)
    spark = spark or session()
    ship(spark)
    return asked.run(GraphStore(spark, f"{asked.state}/graph", asked.buckets), asked)


if __name__ == "__main__":
    main().show(1000, truncate=False)
