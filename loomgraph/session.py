"""Sessions and the code that tasks import."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(name: str = "loomgraph", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and adaptive execution."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("LOOMGRAPH_DRIVER_MEMORY", "8g"),
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for tasks that run its Python functions."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own only in a local session."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; deleted when Python ends, if the session still runs then."""
    app = spark.sparkContext.applicationId
    at = f"{shared_folder(spark)}/{app}"
    if app not in _OWNED:
        _OWNED.add(app)
        atexit.register(_forget, spark, at)
    return at


_OWNED: set[str] = set()


def _forget(spark: SparkSession, at: str) -> None:
    if spark.sparkContext._jsc is not None:
        deleted(spark, at)


def deleted(spark: SparkSession, at: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is read more than once is computed once, and a lost executor loses nothing."""
    return _table(df, f"{own_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}")


def _table(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function as written(), whose tables are deleted when the block ends, also after a failure."""
    at = f"{own_folder(spark)}/scratch/{uuid.uuid4().hex}"
    try:
        yield lambda df, name: _table(df, f"{at}/{name}-{uuid.uuid4().hex}")
    finally:
        deleted(spark, at)
