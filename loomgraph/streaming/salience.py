"""Salience as the state of a stream: a value for each node, decayed when it is touched again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.graph import DECAY, FLOOR, decayed
from ..session import own_folder

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = StructType([StructField("salience", DoubleType()), StructField("step", LongType())])


class Salience(StatefulProcessor):
    """Amounts (node, step, amount) -> (node, step, salience after it). The state of a node is its last salience and that step.

    Steps without an amount cost nothing: their decay is made up for at the next one. An amount for a step before the state's
    counts at the state's step, as news that came late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.last.get() if self.last.exists() else None
        salience, step = at if at else (0.0, 0)
        amounts: dict[int, float] = {}  # a batch's distinct steps of one node
        for part in rows:
            for s, a in zip(part["step"].tolist(), part["amount"].tolist()):  # grouping in pandas costs more than a node's few rows
                if s == s:  # not null
                    s = max(int(s), step)
                    amounts[s] = amounts.get(s, 0.0) + (float(a) if a == a and a is not None else 0.0)
        for s in sorted(amounts):
            if s == step and at:  # this step has been decayed already
                salience = max(FLOOR, salience + amounts[s] * DECAY)
            else:
                held = max(FLOOR, salience * DECAY ** max(0, s - step - 1)) if salience else 0.0
                salience = max(FLOOR, (held + amounts[s]) * DECAY)
            step, at = s, True
        self.last.update((salience, step))
        yield pd.DataFrame({"node": [key[0]], "step": [step], "salience": [salience]})

    def close(self) -> None:
        pass


def salience_stream(amounts: DataFrame, node_type: str = "long") -> DataFrame:
    """The stream of updates of a stream of node, step, amount."""
    return amounts.groupBy("node").transformWithStateInPandas(Salience(), f"node {node_type}, step long, salience double", outputMode="Update", timeMode="None")


def run_salience(spark: SparkSession, amounts: DataFrame, last: int, node_type: str = "long", at: str | None = None) -> DataFrame:
    """node, salience at step `last`, from all input that is there. A later call with the same folder goes on with its state."""
    at = at or f"{own_folder(spark)}/salience/{uuid.uuid4().hex}"
    before = spark.conf.get(STORE)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{at}/updates/part={number}")

    spark.conf.set(STORE, ROCKS)  # the store that can hold states of this kind
    try:
        query = salience_stream(amounts, node_type).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        spark.conf.set(STORE, before)
    updates = spark.read.schema(f"node {node_type}, step long, salience double, _batch long").option("recursiveFileLookup", "true").parquet(f"{at}/updates")
    final = updates.groupBy("node").agg(F.max_by(F.struct("step", "salience"), "_batch").alias("f"))
    return final.select("node", F.round(decayed(F.col("f.salience"), F.lit(last) - F.col("f.step")), 9).alias("salience"))
