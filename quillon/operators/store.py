"""A prepared table kept for many queries.

Rows lie as the removal of old deliveries leaves them: spread by the printing's id, so that a card with a third of all
rows is in every file.  Buckets by card would save the choice of one printing per card its shuffle, but they would put
such a card into one task; as it is, each split sends on one row a card at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillon.runtime import shared_folder

_built: dict[str, StructType] = {}


def _state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the sources' files with their sizes and times: other data, other store."""
    context = spark.sparkContext
    seen = []
    for path in paths:
        root = context._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(context._jsc.hadoopConfiguration())
        seen += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(root))
    return hashlib.sha256("\n".join([context.applicationId, *seen]).encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def store(spark: SparkSession, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes of ``sources``; made once a session as long as the sources stay as they are."""
    state = _state(spark, sources)
    path = f"{shared_folder(spark)}/store-{state}"
    if path not in _built or not _exists(spark, path):
        df = build()
        df.write.mode("overwrite").parquet(path)
        _built[path] = df.schema
    return spark.read.schema(_built[path]).parquet(path)
