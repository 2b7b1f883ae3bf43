"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes; keys with more are joined by broadcast, and there are at most 1 / SHARE of them.
HEAVY_ROWS, SHARE = 100_000, 1 / 10_000


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The inner join on ``key``, of which ``right`` has each value once.  ``rows`` is about the size of ``left``.

    Keys with many rows are found by a count that is combined before its shuffle; their few rows of ``right`` go to
    every task, and no row of theirs is shuffled.  A null key joins nothing.
    """
    if rows <= heavy_rows:
        return left.join(right, key)
    heavy = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(heavy_rows, rows * SHARE)).select(key)
    few = F.broadcast(right.join(F.broadcast(heavy), key, "left_semi"))
    rest = left.join(F.broadcast(heavy), key, "left_anti")
    return left.join(few, key).unionByName(rest.join(right, key))


def left_join_unique(left: DataFrame, right: DataFrame, keys: list[str], rows: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The left outer join on ``keys``, of which ``right`` has each combination once.

    Rows without a key have no partner and are never shuffled to find that out; keys with many rows meet theirs by
    broadcast, as in ``join_unique``.
    """
    if rows <= heavy_rows:
        return left.join(right, keys, "left")
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    more = [f for f in right.schema.fields if f.name not in keys]
    heavy = left.where(known).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(heavy_rows, rows * SHARE)).select(*keys)
    few = F.broadcast(heavy.join(right, keys, "left"))
    columns = [*left.columns, *(f.name for f in more)]
    alone = left.where(~known).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in more))
    some, rest = left.where(known).join(few, keys), left.where(known).join(F.broadcast(heavy), keys, "left_anti").join(right, keys, "left")
    return alone.select(*columns).unionByName(some.select(*columns)).unionByName(rest.select(*columns))
