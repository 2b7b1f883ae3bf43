"""Plans, not rows: what a query makes Spark do."""

import pytest

from quillon.operators.search import search
from quillon.search_queries import corpus


@pytest.fixture(scope="module")
def cards(spark, data):
    return corpus(spark, data)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scan_line(text, word):
    return " ".join(line for line in text.split("\n") if word in line)


def test_comparisons_reach_the_scan(cards):
    text = plan(search(cards, "cmc<=4 r>=rare t:creature", unique="printing", limit=None).rows.select("scryfall_id"))
    pushed = scan_line(text, "PushedFilters")
    assert "LessThanOrEqual(cmc" in pushed and "GreaterThanOrEqual(rarity" in pushed and "StringContains(type_line_lower" in pushed


def test_only_needed_columns_are_read(cards):
    text = plan(search(cards, "cmc<=4", unique="printing", orderby="name", limit=None).rows.select("scryfall_id"))
    read = scan_line(text, "ReadSchema")
    assert "oracle_text" not in read and "card_faces" not in read and "cmc" in read


def test_splits_choose_before_the_shuffle(cards):
    text = plan(search(cards, "t:creature", unique="card").rows.select("scryfall_id"))
    assert "Partial" in scan_line(text, "Arguments: [card_key") and text.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in text


def test_queries_stay_out_of_python(cards):
    text = plan(search(cards, "jotun m:{R} o:/a b/ a:lee c>=g -is:dfc", unique="artwork").rows)
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
