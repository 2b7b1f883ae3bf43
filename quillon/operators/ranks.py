"""Ranks over the whole catalogue and within a card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import natural_key
from quillon.plans.list_ranking import row_numbers, running_total
from quillon.plans.skew import join_unique
from quillon.runtime import materialise

#: Ranks beyond this count as this.
LAST_RANK = 1024


def name_percent_ranks(df: DataFrame, name: str, rank: str, seen: str) -> DataFrame:
    """(name, score): 25 times the percent rank of each different name, unknown ranks last.  A name's ``rank`` is that of its
    first row in the order of ``seen``.

    A percent rank is the number of smaller values over all but one, so counting per value of ``rank`` and summing the
    counts in order gives it without ranking all names in one task.
    """
    # the order as a struct, so that a row without it counts as the first instead of being passed over
    first = F.min_by(F.struct(F.col(rank).alias("r")), F.struct(seen))
    names, _ = materialise(df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(first.alias("first")).select("name", "first.r"), "names")
    total, known = names.agg(F.count("*"), F.count("r")).first()
    before = running_total(names.where("r is not null").groupBy("r").agg(F.count("*").alias("n")), "r", "n", "before")
    score = (25.0 * F.col("before") / (total - 1)) if total > 1 else F.lit(0.0)
    last = F.lit(25.0 * known / (total - 1) if total > 1 else 0.0)
    ranked = join_unique(names.where("r is not null"), before.select("r", "before"), "r", known)
    return ranked.select(F.col("name").alias(name), score.alias("score")).unionByName(names.where("r is null").select(F.col("name").alias(name), last.alias("score")))


def slot_ranks(prepared: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """(oracle_id, set_code, collector_number, rank): the place of every printing slot within its card, from 0.

    Pinned slots come first (``pinned``: the same three columns), then slots with an English row, then numbers without
    letters before them, then newer ones, then by number as people count.  Rows that lack part of a slot have none.
    """
    slot = ["oracle_id", "set_code", "collector_number"]
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    slots = prepared.where("oracle_id is not null and set_code is not null and collector_number is not null").groupBy(*slot).agg(F.max("released").alias("released"), F.max(english).alias("english"))
    slots = slots.withColumn("key", natural_key(F.col("collector_number")))
    if pinned is not None:
        slots = slots.join(pinned.select(*slot).distinct().withColumn("pinned", F.lit(True)), slot, "left")
    first = [F.coalesce("pinned", F.lit(False)).desc()] if pinned is not None else []
    order = [*first, F.col("english").desc(), F.rlike("key.prefix", F.lit("[a-z]")).asc(), F.col("released").desc_nulls_last(), F.col("key").asc(), F.col("set_code").asc(), F.col("collector_number").asc()]
    placed = row_numbers(slots, "oracle_id", order, "place")
    return placed.withColumn("rank", F.least(F.col("place") - 1, F.lit(LAST_RANK))).drop("place")
