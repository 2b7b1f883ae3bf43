"""Rulings: whole ones, once each, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.columns import clean_id
from quillon.plans.list_ranking import row_numbers


def clean_rulings(df: DataFrame) -> DataFrame:
    """(oracle_id, source, published_at, comment) of rulings that have all four, dates cut to ten characters, once each."""
    rows = df.select(clean_id("oracle_id").alias("oracle_id"), "source", F.col("published_at").cast("string").alias("published_at"), "comment")
    rows = rows.where("oracle_id is not null and source <> '' and length(published_at) >= 10 and comment <> ''")
    return rows.withColumn("published_at", F.substring("published_at", 1, 10)).distinct()


def parse_rulings(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rulings from JSON lines; others than whole ones are left out."""
    schema = "oracle_id string, source string, published_at string, comment string"
    return clean_rulings(lines.select(F.from_json(line, schema).alias("r")).select("r.*"))


def bucketed(rulings: DataFrame) -> DataFrame:
    """(oracle_id, rulings): each card's rulings as one ordered list, by the rule of ``numbered``; a list is one value, so a
    card's rulings have to fit into a task."""
    listed = F.sort_array(F.collect_list(F.struct(F.date_diff(F.lit("9999-12-31"), F.col("published_at").try_cast("date")).alias("age"), "comment", "source", "published_at")))
    return rulings.groupBy("oracle_id").agg(F.transform(listed, lambda r: F.struct(r["published_at"].alias("published_at"), r["comment"].alias("comment"), r["source"].alias("source"))).alias("rulings"))


def numbered(rulings: DataFrame) -> DataFrame:
    """Rulings with their ``place`` within the card: newest first, then by comment and source."""
    return row_numbers(rulings, "oracle_id", [F.col("published_at").desc(), F.col("comment").asc(), F.col("source").asc()], "place")
