"""Builds: a partitioned table, and a manifest written last that makes it the current one."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import drop

POINTER = "current.json"
KEPT_BUILDS = 2
#: Rows per partition that keep files of a comfortable size.
ROWS_PER_PARTITION = 2_000_000
FORMAT = 1


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then renamed into it: readers see the old or the new one, whole."""
    beside, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _path(spark, path)
    if not fs.rename(beside, target):  # some file systems refuse to replace
        fs.delete(target, False)
        fs.rename(beside, target)


def _read_text(spark: SparkSession, path: str) -> str | None:
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(rows: DataFrame, folder: str, partitions: int | None = None, sort: tuple[str, ...] = ("oracle_id", "scryfall_id")) -> dict:
    """Writes ``rows`` as a new build of ``folder``, makes it current, and drops all but the last builds.

    Rows are partitioned by ``oracle_id``, so a card's rows lie together, and sorted within files, so that ids prune; a card
    of more rows than a partition should hold, and rows of no card, are spread over as many as they need.
    Returns the manifest.  A build without its manifest is not one: a run that dies leaves the current build as it was.
    """
    spark = rows.sparkSession
    build = uuid.uuid4().hex
    total = rows.count()
    n = partitions or max(1, math.ceil(total / ROWS_PER_PARTITION))
    path = f"{folder.rstrip('/')}/build={build}"
    part = F.when(F.col("oracle_id").isNull(), F.pmod(F.xxhash64("scryfall_id"), F.lit(n))).otherwise(0)
    most = max(1, total // n)
    large = rows.groupBy("oracle_id").agg(F.count("*").alias("_n")).where(F.col("oracle_id").isNotNull() & (F.col("_n") > max(most, ROWS_PER_PARTITION // 20))).select("oracle_id", F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    # at most n cards are as large as a partition
    spread = rows.join(F.broadcast(large), "oracle_id", "left").withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("scryfall_id"), F.col("_parts"))).otherwise(part))
    spread.repartition(n, "oracle_id", "_part").select(*rows.columns).sortWithinPartitions(*sort).write.mode("error").parquet(path)
    written = spark.read.parquet(path)
    printings, cards = written.agg(F.count("*"), F.count_distinct("oracle_id")).first()
    before = history(spark, folder)
    manifest = {"format": FORMAT, "build": build, "partitions": n, "partition_key": "oracle_id", "printings": printings, "cards": cards, "columns": written.columns}
    _write_text(spark, f"{path}/_manifest.json", json.dumps(manifest))
    _write_text(spark, f"{folder.rstrip('/')}/{POINTER}", json.dumps([build, *before][:KEPT_BUILDS]))
    for old in before[KEPT_BUILDS - 1 :]:
        drop(spark, f"{folder.rstrip('/')}/build={old}")
    return manifest


def history(spark: SparkSession, folder: str) -> list[str]:
    """The kept builds, current first."""
    return json.loads(_read_text(spark, f"{folder.rstrip('/')}/{POINTER}") or "[]")


def manifest(spark: SparkSession, folder: str, build: str | None = None) -> dict:
    """The manifest of the current or a given build; raises if there is none or it is not one that can be read."""
    build = build or next(iter(history(spark, folder)), None)
    found = json.loads(_read_text(spark, f"{folder.rstrip('/')}/build={build}/_manifest.json") or "null") if build else None
    if not found:
        raise FileNotFoundError(f"no build in {folder}")
    if found.get("format") != FORMAT or found.get("partition_key") != "oracle_id":
        raise ValueError(f"build {build} has an unknown format")
    return found


def load(spark: SparkSession, folder: str, build: str | None = None) -> DataFrame:
    """The rows of the current or a given build."""
    return spark.read.parquet(f"{folder.rstrip('/')}/build={manifest(spark, folder, build)['build']}")
