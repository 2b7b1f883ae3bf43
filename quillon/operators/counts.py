"""Counts and lists over the whole catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_counts(prepared: DataFrame) -> DataFrame:
    """How many cards have each type; ``Kindred`` also counts as ``Tribal``."""
    exploded = prepared.where("is_canonical").select("oracle_id", F.explode("types").alias("type"))
    counted = exploded.groupBy("type").agg(F.count_distinct("oracle_id").alias("n_cards"))
    return counted.unionByName(counted.where("type = 'Kindred'").withColumn("type", F.lit("Tribal")))


def keyword_counts(prepared: DataFrame) -> DataFrame:
    """How many cards have each keyword, in lower case."""
    exploded = prepared.where("is_canonical").select("oracle_id", F.explode("keywords").alias("keyword"))
    return exploded.groupBy("keyword").agg(F.count_distinct("oracle_id").alias("n_cards"))


def sets_with_extras(prepared: DataFrame) -> DataFrame:
    """The codes of sets that hold extra rows."""
    return prepared.where(F.array_contains("is_tags", F.lit("extra"))).select("set_code").distinct()


def totals(prepared: DataFrame) -> DataFrame:
    """One row: cards, printings, and those in the default lane."""
    return prepared.agg(F.count_distinct("oracle_id").alias("n_cards"), F.count("*").alias("n_printings"), F.count_if("is_canonical").alias("n_canonical"))


def distinct_values(prepared: DataFrame, column: str) -> DataFrame:
    """The different values of a column, nulls and empty text left out; of an array column its members."""
    kind = dict(prepared.dtypes)[column]
    values = prepared.select((F.explode(column) if kind.startswith("array") else F.col(column)).alias("value"))
    return values.where("value is not null and cast(value as string) <> ''").distinct()


def illustration_counts(prepared: DataFrame) -> DataFrame:
    """How often each artwork was printed under each name, among English rows of regular sets and borders."""
    regular = prepared.where("lang = 'en' and coalesce(set_type, '') <> 'memorabilia' and coalesce(border, '') not in ('gold', 'yellow') and illustration_id is not null")
    return regular.groupBy("illustration_id", "card_name").agg(F.count("*").alias("illustration_count"))
