"""Deliveries as a stream: each micro-batch is merged into the current rows, the latest delivery of an id wins.

This is an addition of this engine; the batch form of the same rule is ``operators.prepare.current``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.prepare import current
from quillon.sinks.publish import history, load, publish

_VERSION = "_batch"


def merge(old: DataFrame | None, new: DataFrame, version: list[str]) -> DataFrame:
    """The current rows after ``new`` deliveries; of equal versions the new one wins, so a repeated batch changes nothing."""
    fresh = new.withColumn(_VERSION, F.lit(1))
    rows = fresh if old is None else old.withColumn(_VERSION, F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    return current(rows, [*version, _VERSION]).drop(_VERSION)


def upsert(deliveries: DataFrame, folder: str, checkpoint: str, version: list[str], partitions: int | None = None, once: bool = True) -> StreamingQuery:
    """Merges a stream of deliveries into the builds of ``folder``; every micro-batch publishes one build.

    A batch that is run again after a failure is merged again to the same rows.
    """
    spark: SparkSession = deliveries.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            old = load(spark, folder) if history(spark, folder) else None
            publish(merge(old, batch, version), folder, partitions)

    writer = deliveries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
