"""A stored graph that can be inserted into: tables in hash buckets, copied on write, published version by version.

A store is a folder. `manifest/v<number>.json` names, for each table, the folder of each bucket; other files are never changed. An
upsert reads the buckets that its rows fall into, merges, writes these buckets to new folders and publishes a manifest that
takes them over and leaves all others. Publishing is a rename that fails if the version is there already: whoever loses the race looks at
the winner's version, merges again what the winner changed too, and tries the next number. Readers see whole versions only.

| table | bucket by | a repeated row |
|---|---|---|
| nodes | id | the known one stays; of new ones the least (step, source_id, trace_id, value) |
| edges | src | the known salience and step stay; of new ones those of the least (step, -salience) |
| traces | src, dst, relation, trace_id | the known step stays; of new ones the least |
| events | one folder an append | numbered on from the last event, without gaps |

Traces of an edge are rows of their own, in buckets of their own hash, so that an edge that a third of all documents state is spread.
What a bucket takes is dealt by AQE (a rebalance), so that a large bucket is several files. Files are sorted and have Bloom filters on
what lookups ask for. `metadata` of nodes is a VARIANT.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import deleted, scratch

SCHEMA = "1.2"


@dataclass(frozen=True)
class Layout:
    columns: str
    key: tuple[str, ...]
    #: What a bucket is the hash of; the first column is also what files are sorted by.
    bucket: tuple[str, ...] = ()
    blooms: tuple[str, ...] = ()
    #: Which of several new rows of a key counts.
    order: str = ""


LAYOUTS = {
    "nodes": Layout("id string, value string, sem_type string, salience double, step long, source_id string, method string, confidence double, trace_id string, metadata variant", ("id",), ("id",), ("id", "value"), "struct(step, source_id, trace_id, value)"),
    "edges": Layout("src string, dst string, relation string, salience double, step long", ("src", "dst", "relation"), ("src",), ("src",), "struct(step, -salience)"),
    "traces": Layout("src string, dst string, relation string, trace_id string, step long", ("src", "dst", "relation", "trace_id"), ("src", "dst", "relation", "trace_id"), ("src",), "step"),
    "events": Layout("number long, step long, event_type string, node string, metadata string", ()),
}


def names(table: str) -> list[str]:
    return [c.split()[0] for c in LAYOUTS[table].columns.split(", ")]


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # Versions

    def _hadoop(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, files = self._hadoop(f"{self.path}/manifest")
        if not files.exists(path):
            return []
        return sorted(int(f.getPath().getName()[1:-5]) for f in files.listStatus(path) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The latest version, or the one asked for; an empty store is version 0."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return {"schema": SCHEMA, "version": 0, "buckets": self.buckets, "events": 0, "tables": {t: {} for t in LAYOUTS}}
        path, files = self._hadoop(f"{self.path}/manifest/v{version:012d}.json")
        stream = files.open(path)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found["schema"] != SCHEMA:
            raise ValueError(f"the graph has schema {found['schema']}, this code reads {SCHEMA}")
        return found

    def _publish(self, manifest: dict) -> bool:
        """False if another writer has published this version first."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        draft, files = self._hadoop(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v{manifest['version']:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            files.delete(draft, False)
            return False

    # Reading

    def bucket_of(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*LAYOUTS[table].bucket), F.lit(self.buckets)).cast("int")

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table, or what some of its buckets hold."""
        return self._read(table, self.manifest(version), buckets)

    def _read(self, table: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = manifest["tables"][table]
        own = [f"{self.path}/{at}" for b, at in folders.items() if buckets is None or int(b) in buckets]
        if not own:
            return self.spark.createDataFrame([], LAYOUTS[table].columns)
        return self.spark.read.schema(LAYOUTS[table].columns).parquet(*own)

    def find(self, table: str, version: int | None = None, **equals: str) -> DataFrame:
        """Rows with these values. Where they name what the table is bucketed by, only that bucket is read; filters reach its files."""
        by, buckets = LAYOUTS[table].bucket, None
        if set(by) <= set(equals):
            key = self.spark.range(1).select(*(F.lit(equals[c]).alias(c) for c in by))
            buckets = [key.select(self.bucket_of(table)).first()[0]]
        rows = self.read(table, version, buckets)
        for column, value in equals.items():
            rows = rows.filter(F.col(column) == value)
        return rows

    def find_all(self, table: str, asked: DataFrame, version: int | None = None) -> DataFrame:
        """Rows whose bucket columns are in asked (which has these columns); other buckets are not read."""
        by = LAYOUTS[table].bucket
        asked = asked.select(*by).distinct()
        touched = [r[0] for r in asked.select(self.bucket_of(table)).distinct().collect()]  # at most as many as there are buckets
        return self.read(table, version, touched).join(asked, list(by), "left_semi")

    def bucketed(self, table: str, name: str, by: str, buckets: int | None = None) -> DataFrame:
        """The table as one of Spark's catalog, bucketed and sorted by a column: joins with others of that kind need no shuffle."""
        rows = self.read(table).repartition(buckets or self.buckets, by)
        rows.write.mode("overwrite").bucketBy(buckets or self.buckets, by).sortBy(by).option(f"parquet.bloom.filter.enabled#{by}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").saveAsTable(name)
        return self.spark.table(name)

    # Writing

    def upsert(self, tries: int = 20, **new: DataFrame) -> int:
        """Merge rows into tables, by name; the version that has them. Rows need the columns of LAYOUTS but for events, whose number is given."""
        with scratch(self.spark) as write:
            return self._upsert({t: write(df.select(*(c for c in names(t) if c != "number")), f"new-{t}") for t, df in new.items()}, tries)

    def _upsert(self, new: dict[str, DataFrame], tries: int) -> int:
        touched = {t: self._touched(t, df) for t, df in new.items()}
        base, parts = None, {}
        for _ in range(tries):
            latest = self.manifest()
            if latest["buckets"] != self.buckets:
                raise ValueError(f"the graph has {latest['buckets']} buckets, not {self.buckets}")
            for table, rows in new.items():
                if base is None or self._changed(table, base, latest, touched[table]):
                    parts[table] = self._write(table, rows, latest, touched[table])
            base = latest
            tables = {t: latest["tables"][t] | parts.get(t, {}) for t in LAYOUTS}
            n = latest["events"] + (new["events"].count() if "events" in new else 0)
            if self._publish(latest | {"version": latest["version"] + 1, "events": n, "tables": tables}):
                return latest["version"] + 1
        raise RuntimeError(f"{tries} other writers came first")

    def _touched(self, table: str, rows: DataFrame) -> list[int]:
        return [] if table == "events" else sorted(r[0] for r in rows.select(self.bucket_of(table)).distinct().collect())  # at most as many as there are buckets

    @staticmethod
    def _changed(table: str, base: dict, latest: dict, touched: list[int]) -> bool:
        """Whether what was written for base does not fit latest."""
        if table == "events":
            return base["events"] != latest["events"]
        return any(base["tables"][table].get(str(b)) != latest["tables"][table].get(str(b)) for b in touched)

    def _write(self, table: str, rows: DataFrame, manifest: dict, touched: list[int]) -> dict[str, str]:
        folder, layout = f"{table}/{uuid.uuid4().hex}", LAYOUTS[table]
        if table == "events":
            numbered(rows, ["step", "event_type", "node", "metadata"], after=manifest["events"]).select(*names(table)).write.parquet(f"{self.path}/{folder}")
            return {str(manifest["version"] + 1): folder}
        merged = merge(table, self._read(table, manifest, touched), rows)
        out = merged.withColumn("bucket", self.bucket_of(table)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *layout.key)
        writer = out.write.partitionBy("bucket").option("parquet.bloom.filter.adaptive.enabled", "true")  # sized by what a file holds, not a megabyte each
        for column in layout.blooms:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.path}/{folder}")
        return {str(b): f"{folder}/bucket={b}" for b in touched}

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions but the last ones, and the folders that none of those names; how many folders went. Not beside a running upsert."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        used = {at for m in kept for folders in m["tables"].values() for at in folders.values()}
        gone = {at for v in versions[:-keep] for folders in self.manifest(v)["tables"].values() for at in folders.values()} - used
        for at in gone:
            deleted(self.spark, f"{self.path}/{at}")
        for v in versions[:-keep]:
            deleted(self.spark, f"{self.path}/manifest/v{v:012d}.json")
        return len(gone)


def merge(table: str, known: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, one of each key."""
    layout, own = LAYOUTS[table], names(table)
    rest = [c for c in own if c not in layout.key]
    both = known.select(*own, F.lit(0).alias("_new")).unionByName(new.select(*own, F.lit(1).alias("_new")))
    first = both.groupBy(*layout.key).agg(F.min_by(F.struct(*rest), F.struct("_new", F.expr(layout.order).alias("o"))).alias("_f"))
    return first.select(*(c if c in layout.key else F.col(f"_f.{c}") for c in own))


def rebuilt_definitions(nodes: DataFrame) -> DataFrame:
    """term, definition, source_id, confidence, step, node_id of the nodes that are definitions with a term: what a definition store is filled with after a load.

    Paths of the VARIANT metadata are taken in the scan. Confidence and source are those of a node's first provenance, 0.8 and unknown without one.
    """
    field = lambda name: F.try_variant_get("metadata", f"$.{name}", "string")
    text = F.coalesce(field("definition_text"), F.col("value"))
    own = nodes.select(field("category").alias("_c"), field("term").alias("term"), text.alias("definition"), F.coalesce("source_id", F.lit("unknown")).alias("source_id"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"), "step", F.col("id").alias("node_id"))
    return own.filter("_c = 'definition' and term <> '' and definition <> ''").drop("_c")
