"""The N highest-scoring items of every group, by descending score bands.

The items are range-partitioned into bands of the score and the bands are worked off from the top.  In a band, items of
groups that are already full are dropped by an anti-join before anything is ranked; of the rest each input split keeps
its own best N a group before the shuffle, so a group with a third of all rows never meets in one task; the exact rank,
ties included, decides only the places that are left.

Groups with more than a thousandth of the rows (a thousand at most) take part in the anti-join by broadcast, all others
by a shuffle in which none of them is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import clean_id
from quillon.runtime import drop, materialise

#: Quantiles of the score that bound the bands; the top one is small, since it fills most large groups.
BANDS = (0.5, 0.8, 0.95)
#: A group with more than this share of the rows is handled by broadcast; there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 1000


def _best(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def top_n(df: DataFrame, group: str, score: str, ties: list[str], n: int, bands: tuple[float, ...] = BANDS, scores: DataFrame | None = None) -> DataFrame:
    """The ``n`` rows of greatest ``score`` of every ``group``, equal scores by smaller ``ties``: ``group``, ``score``,
    ``ties``, and ``rank_no`` from 1.

    Rows whose group is null, or whose score is null or NaN, take no part; infinite scores do, and -0.0 equals 0.0.  Null
    ties come first.  Rows equal in all these columns are interchangeable and each counts.  An empty table gives no
    rows.  Other columns are never read, so their names cannot clash.

    ``scores`` may name a cheaper table with the column ``score`` of about the same distribution, such as the one ``df`` was
    deduped from: the bounds of the bands come from its quantiles.  They decide how the work is split, never the result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    named = [F.col(c).alias(f"t{i}") for i, c in enumerate(ties)]
    rows = df.select(F.col(group).alias("g"), (F.col(score) + F.lit(0).cast(df.schema[score].dataType)).alias("s"), *named).where("g is not null and s is not null and not isnan(s)")
    edges = sorted(set((df if scores is None else scores).where(~F.isnan(score)).approxQuantile(score, list(bands), 0.005))) if bands else []
    band = sum((F.when(F.col("s") >= F.lit(e).cast(df.schema[score].dataType), 1).otherwise(0) for e in edges), F.lit(0))
    kept, kept_path = materialise(rows.withColumn("band", band.cast("int")), "bands", partition_by="band")

    sizes = kept.groupBy("g").agg(F.count("*").alias("size"))
    total = kept.count()
    heavy, _ = materialise(sizes.where(F.col("size") > max(total * HEAVY, 1000)).select("g"), "heavy")
    order = [F.col("s").desc(), *(F.col(f"t{i}").asc_nulls_first() for i in range(len(ties)))]
    columns = ["g", "s", *(f"t{i}" for i in range(len(ties)))]
    winners: list[DataFrame] = []
    for b in range(len(edges), -1, -1):
        items = kept.where(F.col("band") == b).select(*columns)
        if not winners:
            ranked = _best(items, "g", order, n).withColumnRenamed("place", "rank_no")
        else:
            held = winners[0]
            for w in winners[1:]:
                held = held.unionByName(w)
            have = held.groupBy("g").agg(F.count("*").cast("int").alias("have"))
            full = have.where(F.col("have") >= n).select("g")
            large = F.broadcast(heavy.join(full.withColumn("full", F.lit(True)), "g", "left"))
            marked = items.join(large.withColumn("heavy", F.lit(True)), "g", "left").where("full is null")
            open_ = marked.where("heavy is not null").select(*columns).unionByName(marked.where("heavy is null").select(*columns).join(full, "g", "left_anti"))
            placed = _best(open_, "g", order, n).join(have, "g", "left")
            ranked = placed.withColumn("rank_no", F.col("place") + F.coalesce("have", F.lit(0))).where(F.col("rank_no") <= n).select(*columns, "rank_no")
        done, _ = materialise(ranked, "winners")
        winners.append(done)
    drop(spark, kept_path)
    out = winners[0]
    for w in winners[1:]:
        out = out.unionByName(w)
    return out.select(F.col("g").alias(group), F.col("s").alias(score), *(F.col(f"t{i}").alias(c) for i, c in enumerate(ties)), "rank_no")


def latest_delivery(df: DataFrame, item: str, version: list[str], carry: list[str]) -> DataFrame:
    """Each item (by cleaned id) as its row of greatest ``version`` columns, nulls least: ``item`` and ``carry``."""
    rows = df.select(clean_id(item).alias("item"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(version)), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).where("item is not null")
    newest = Window.partitionBy("item").orderBy(*(F.col(f"v{i}").desc_nulls_last() for i in range(len(version))))
    one = rows.withColumn("newest", F.row_number().over(newest)).where("newest = 1")
    return one.select(F.col("item").alias(item), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))
