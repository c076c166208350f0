"""Snapshots of a graph: one directory per version, published by a manifest row that is written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.2"


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], step: int) -> str:
    """Write the tables under path/v<step> and publish them; a reader never sees a half-written version."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{step}/{name}")
    manifest = spark.createDataFrame([(VERSION, step, sorted(tables))], "schema_version string, step long, tables array<string>")
    manifest.write.mode("append").parquet(f"{path}/manifest")
    return f"{path}/v{step}"


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the latest published version; another schema version is an error."""
    last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("step")).first()
    if last["schema_version"] != VERSION:
        raise ValueError(f"snapshot has schema {last['schema_version']}, this code reads {VERSION}")
    return {name: spark.read.parquet(f"{path}/v{last['step']}/{name}") for name in last["tables"]}
