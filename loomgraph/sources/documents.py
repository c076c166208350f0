"""Text files, JSON files and directories as documents; datasets as key-value rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """path, title, text: one row per file, read whole; directories are read file by file, in parallel."""
    files = spark.read.text(list(paths), wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"), F.col("value").alias("text"))


def json_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """path, title, author, text: one row per JSON file; text is the whole object as JSON, the title that of the object, else the file's name without its ending."""
    files = spark.read.text(list(paths), wholetext=True)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.coalesce(field("title"), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("title"), field("author").alias("author"), F.col("value").alias("text"))


def dataset_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """dataset, key, value, seq of a JSON file that holds one object."""
    files = spark.read.text(path, wholetext=True)
    pairs = files.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("seq", "e"))
    return pairs.select(F.lit(name).alias("dataset"), F.col("e.key").alias("key"), F.col("e.value").alias("value"), F.col("seq").cast("long").alias("seq"))


def inline_dataset(spark: SparkSession, name: str, records: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(name, str(k), v, i) for i, (k, v) in enumerate(records.items())], "dataset string, key string, value string, seq long")


#: Built-in capitals. Fixed values.
COUNTRY_CAPITALS = {"France": "Paris", "Spain": "Madrid", "Japan": "Tokyo", "United States": "Washington, D.C.", "Mexico": "Mexico City", "Canada": "Ottawa", "Germany": "Berlin", "Italy": "Rome", "United Kingdom": "London", "China": "Beijing"}
STATE_CAPITALS = {"Texas": "Austin", "California": "Sacramento", "Florida": "Tallahassee", "New York": "Albany", "North Carolina": "Raleigh", "Virginia": "Richmond", "Washington": "Olympia", "Arizona": "Phoenix", "Alaska": "Juneau", "Hawaii": "Honolulu"}
