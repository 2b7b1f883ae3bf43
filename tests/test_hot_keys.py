"""One key with a third of all rows, null keys, and the ranks and joins that have to bear them."""

import random

from pyspark.sql import functions as F

from quillon.operators.prepare import prepare, with_unique_tag
from quillon.operators.ranks import LAST_RANK, slot_ranks
from quillon.operators.rulings import bucketed, numbered
from quillon.plans import skew
from quillon.plans.list_ranking import row_numbers
from quillon.plans.skew import left_join_unique
from quillon.sinks.publish import load, publish
from tests.test_plans import plan


def hot(n):
    return ["hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{i % 40}" for i in range(n)]


def test_left_join_keeps_rows_without_a_partner(spark):
    left = spark.createDataFrame([(k, i % 2, i) for i, k in enumerate(hot(900))], "k string, b int, v int")
    right = spark.createDataFrame([("hot", 0, 1), ("k3", 1, 2), ("none", 0, 3)], "k string, b int, w int")
    expected = sorted(map(repr, left.join(right, ["k", "b"], "left").select("k", "b", "v", "w").collect()))
    for most in (10_000, 100, 1):
        assert sorted(map(repr, left_join_unique(left, right, ["k", "b"], 900, most).select("k", "b", "v", "w").collect())) == expected
    assert left_join_unique(left.limit(0), right, ["k", "b"], 900, 1).collect() == []


def test_row_numbers_of_a_group_in_many_partitions(spark):
    random.seed(4)
    rows = [(k, random.randrange(50), i) for i, k in enumerate(hot(1200))]
    got = row_numbers(spark.createDataFrame(rows, "k string, a int, b int").repartition(6), "k", [F.col("a").desc(), F.col("b").asc()], "n")
    expected = {}
    for k in {r[0] for r in rows} - {None}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            expected[r[2]] = n
    assert {r["b"]: r["n"] for r in got.collect()} == expected
    assert row_numbers(got.select("k", "a", "b").limit(0), "k", [F.col("a").desc()], "n").collect() == []
    assert "Exchange SinglePartition" not in plan(got)


def test_slots_beyond_the_last_rank_share_it(spark):
    rows = [("o", "s", str(i), "en") for i in range(LAST_RANK + 30)] + [(None, "s", "1", "en")]
    df = spark.createDataFrame(rows, "oracle_id string, set_code string, collector_number string, lang string").withColumn("released", F.lit(None).cast("date"))
    ranks = sorted(r["rank"] for r in slot_ranks(df).collect())
    assert ranks == [*range(LAST_RANK), *[LAST_RANK] * 30]


def test_cards_of_one_set_by_broadcast_of_the_hot_one(spark, monkeypatch):
    rows = [(f"s{i}", k, f"set{i % 2}" if k != "k4" else "one") for i, k in enumerate(hot(300))]
    df = prepare(spark.createDataFrame(rows, "scryfall_id string, oracle_id string, card_set_code string"))
    expected = sorted(r[0] for r in rows if r[1] == "k4")
    for most in (100_000, 10):
        monkeypatch.setattr(skew, "HEAVY_ROWS", most)
        tagged = with_unique_tag(df)
        assert tagged.count() == 300 and expected and set(expected) <= {r["scryfall_id"] for r in tagged.where("array_contains(is_tags, 'unique')").collect()}


def test_a_hot_card_is_spread_over_files(spark, tmp_path, monkeypatch):
    from quillon.sinks import publish as module

    monkeypatch.setattr(module, "ROWS_PER_PARTITION", 200)
    rows = spark.createDataFrame([(f"s{i}", k) for i, k in enumerate(hot(900))], "scryfall_id string, oracle_id string")
    publish(rows, str(tmp_path / "b"), partitions=6)
    got = load(spark, str(tmp_path / "b"))
    assert sorted(map(repr, got.select("scryfall_id", "oracle_id").collect())) == sorted(map(repr, rows.collect()))
    sizes = [r["n"] for r in got.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 3 and max(sizes) < 450


def test_rulings_of_a_hot_card(spark):
    rows = [("hot", f"2020-01-{i % 28 + 1:02d}", f"c{i:03d}", "s") for i in range(200)] + [("b", "2021-01-01", "x", "s")]
    df = spark.createDataFrame(rows, "oracle_id string, published_at string, comment string, source string")
    got = numbered(df).where("oracle_id = 'hot'").orderBy("place").collect()
    assert [(r["place"], r["comment"]) for r in got] == [(i + 1, r[2]) for i, r in enumerate(sorted(rows[:-1], key=lambda r: (-int(r[1][-2:]), r[2])))]
    assert [r["comment"] for r in bucketed(df).where("oracle_id = 'hot'").first()["rulings"]] == [r["comment"] for r in got]


def test_facts_of_the_whole_catalogue_join_the_rows_once(spark, monkeypatch):
    import functools
    import json

    from quillon.operators import transform
    from quillon.sources.jsonl import parse_records

    base = dict(name="Bear", lang="en", released_at="2001-06-04", layout="normal", type_line="Creature", colors=["G"], color_identity=["G"], legalities={}, rarity="common")
    records = [base | dict(id=f"s{i}", oracle_id=k or "", set=f"set{i % 4}", collector_number=str(i), name=f"n{i % 5}", illustration_id=f"i{i % 3}", edhrec_rank=i % 7) for i, k in enumerate(hot(120))]
    rows = transform.transform(parse_records(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "line_no int, line string")))
    tags = spark.createDataFrame([(1, "t", "x", ["u"], [("hot", None), (None, "i1")], 1), (2, "u", "y", None, [("k3", None)], 1)], "row_no bigint, id string, slug string, parent_ids array<string>, taggings array<struct<oracle_id:string,illustration_id:string>>, updated_at int")
    shown = lambda df: sorted(map(repr, df.select("scryfall_id", "card_oracle_tags", "card_art_tags", "illustration_count", "cubecobra_score", "prefer_score").collect()))
    expected = shown(transform.finalize(rows, tags))
    monkeypatch.setattr(transform, "left_join_unique", functools.partial(left_join_unique, heavy_rows=1))
    final = transform.finalize(rows, tags)
    assert plan(final).count("Scan parquet") <= 20  # two mentions a scan
    assert shown(final) == expected and len(expected) == 120


def test_the_planner_keeps_few_forms_of_the_columns_of_rows(spark):
    from quillon.operators.transform import transform
    from quillon.sources.jsonl import parse_records

    rows = transform(parse_records(spark.createDataFrame([(1, "{}")], "line_no int, line string")))
    assert rows._jdf.queryExecution().optimizedPlan().validConstraints().size() < 500  # each is a whole expression
