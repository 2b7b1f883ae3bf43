"""Ranking of linked lists that are spread over a cluster.

Every element names its successor.  Rounds of contraction splice out the elements whose hash is greater than those of
both neighbours (about a third a round, no two of them neighbours), until the rest fits in one task by a stated bound;
there pointer doubling ranks it with numpy.  The spliced elements then get their ranks back in reverse order, one join a
round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import drop, materialise

#: Elements that one task may rank, a few MB of arrays; small, so that the rounds run at every size that is worth them.
ONE_TASK = 60_000


def _rank_in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    element = table["element"].to_numpy()
    order = np.argsort(element)
    element = element[order]
    after = table["after"].to_numpy()[order]
    sums = [table[w].to_numpy()[order].copy() for w in ("length", "delta")]
    last = after < 0
    to = np.where(last, np.arange(len(element)), np.searchsorted(element, np.where(last, element, after)))
    live = ~last
    while live.any():
        at = np.flatnonzero(live)
        ahead = to[at]
        for s in sums:
            s[at] += np.where(live[ahead] | last[ahead], s[ahead], 0)
        # an element is done once it points at the list's end, whose own weight has been added
        to[at] = to[ahead]
        done = last[ahead]
        live[at[done]] = False
        last[at[done]] = True
    for lo in range(0, len(element), 50_000):
        cut = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(element[cut]), pa.array(sums[0][cut]), pa.array(sums[1][cut])], ["element", "length", "delta"])


def suffix_sums(lists: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """From (element, after, length, delta), with ``after`` -1 at a list's end: the sums of length and delta from each
    element to the end of its list, itself included."""
    spark = lists.sparkSession
    lists = lists.select("element", "after", "length", "delta")
    rest, path = materialise(lists, "lists")
    paths, rounds = [path], []
    size = rest.count()
    if size > one_task:
        before = rest.where("after >= 0").select(F.col("after").alias("element"), F.col("element").alias("before"))
        rest, path = materialise(rest.join(before, "element", "left"), "lists")
        paths.append(path)
    while size > one_task:
        rank = lambda c, turn=len(rounds): F.xxhash64(c, F.lit(turn))
        e, ahead, behind = F.col("element"), F.col("after"), F.col("before")
        goes = (ahead >= 0) & (rank(e) > rank(ahead)) & (behind.isNull() | (rank(e) > rank(behind)))
        gone = rest.where(goes)
        rounds.append(gone.select("element", "after", "length", "delta"))
        # the element before takes over what the spliced one counts, the element after its link backwards
        over = gone.select(F.col("element").alias("after"), F.col("after").alias("after2"), F.col("length").alias("l2"), F.col("delta").alias("d2"))
        back = gone.select(F.col("element").alias("before"), F.col("before").alias("before2"), F.lit(True).alias("moved"))
        kept = rest.where(~goes).join(over, "after", "left").join(back, "before", "left")
        kept = kept.select(
            "element", F.coalesce("after2", "after").alias("after"), (F.col("length") + F.coalesce("l2", F.lit(0))).alias("length"), (F.col("delta") + F.coalesce("d2", F.lit(0))).alias("delta"),
            F.when(F.col("moved"), F.col("before2")).otherwise(F.col("before")).alias("before"),
        )
        rest, path = materialise(kept, "lists")
        paths.append(path)
        size = rest.count()
    ranked = rest.select("element", "after", "length", "delta").repartition(1).mapInArrow(_rank_in_one_task, "element bigint, length bigint, delta bigint")
    ranked, path = materialise(ranked, "ranked")
    for gone in reversed(rounds):
        end = ranked.select(F.col("element").alias("after"), F.col("length").alias("l2"), F.col("delta").alias("d2"))
        found = gone.join(end, "after", "left").select("element", (F.col("length") + F.coalesce("l2", F.lit(0))).alias("length"), (F.col("delta") + F.coalesce("d2", F.lit(0))).alias("delta"))
        ranked, newer = materialise(ranked.unionByName(found), "ranked")
        drop(spark, path)
        path = newer
    for old in paths:
        drop(spark, old)
    return ranked


def next_in_order(df: DataFrame, by: list[str]) -> DataFrame:
    """Each row with ``next_<c>``: the columns of the row that follows in the order ``by`` (null: none does).

    The rows are range-partitioned, so no key's rows have to meet in one task; only the first row of each partition
    goes through the driver.
    """
    pid = F.spark_partition_id().alias("pid")
    spread, _ = materialise(df.select(*by).repartitionByRange(*by).select(*by, pid), "ordered")
    firsts = spread.groupBy("pid").agg(F.min(F.struct(*by)).alias("first")).collect()
    firsts.sort(key=lambda r: tuple(r["first"]))
    follow = [(a["pid"], *b["first"]) for a, b in zip(firsts, firsts[1:], strict=False)]
    kinds = dict(df.dtypes)
    schema = "pid int, " + ", ".join(f"over_{c} {kinds[c]}" for c in by)
    chunk = Window.partitionBy("pid").orderBy(*by)
    led = spread.select("*", *(F.lead(c).over(chunk).alias(f"in_{c}") for c in by))
    led = led.join(F.broadcast(df.sparkSession.createDataFrame(follow, schema)), "pid", "left")
    return led.select(*by, *(F.coalesce(f"in_{c}", f"over_{c}").alias(f"next_{c}") for c in by))


def running_total(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows that come before in the order of ``by``, nulls last.

    ``by`` must not repeat.  Range partitions add up their own rows; only one sum a partition goes through the driver.
    """
    order = F.col(by).asc_nulls_last()
    spread, _ = materialise(df.repartitionByRange(order).withColumn("_pid", F.spark_partition_id()), "totals")
    sums = spread.groupBy("_pid").agg(F.sum(value).alias("s"), F.min(by).alias("first")).collect()
    sums.sort(key=lambda r: (r["first"] is None, r["first"]) if r["first"] is not None else (True,))
    before, offsets = 0, []
    for r in sums:
        offsets.append((r["_pid"], before))
        before += r["s"]
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = df.sparkSession.createDataFrame(offsets, "_pid int, _start bigint")
    return spread.withColumn("_own", own).join(F.broadcast(starts), "_pid").withColumn(out, F.col("_own") + F.col("_start")).drop("_pid", "_own", "_start")


def row_numbers(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: each row's place, from 1, within its ``group`` in this order; rows without a group are left out.

    The rows are range-partitioned by group and order, so a large group is spread over many tasks; a partition adds to
    the places of its first group what the partitions before it hold of that group, one number a partition.
    """
    spread, _ = materialise(df.where(F.col(group).isNotNull()).repartitionByRange(F.col(group).asc(), *order).withColumn("_pid", F.spark_partition_id()), "places")
    counts = spread.groupBy("_pid", group).agg(F.count("*").alias("n"))
    edges = counts.groupBy("_pid").agg(F.min(group).alias("first"), F.min_by("n", group).alias("n_first"), F.max(group).alias("last"), F.max_by("n", group).alias("n_last")).collect()
    offsets, open_group, held = [], None, 0
    for r in sorted(edges, key=lambda r: r["_pid"]):
        if r["first"] != open_group:
            held = 0
        offsets.append((r["_pid"], r["first"], held))
        held = held + r["n_first"] if r["first"] == r["last"] else r["n_last"]
        open_group = r["last"]
    kind = dict(df.dtypes)[group]
    begins = df.sparkSession.createDataFrame(offsets, f"_pid int, _first {kind}, _held bigint")
    place = F.row_number().over(Window.partitionBy("_pid", group).orderBy(*order))
    led = spread.withColumn("_place", place).join(F.broadcast(begins), "_pid", "left")
    return led.withColumn(out, (F.col("_place") + F.when(F.col("_first") == F.col(group), F.col("_held")).otherwise(0)).cast("int")).drop("_pid", "_first", "_held", "_place")
