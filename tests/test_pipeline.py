import json

import pytest
from pyspark.sql import functions as F

from quillon import pipeline_queries as pipeline
from quillon.functions.mana import parse_cost, wheel_order
from quillon.operators.counts import keyword_counts, type_counts
from quillon.operators.prepare import prepare
from quillon.operators.ranks import name_percent_ranks, slot_ranks
from quillon.operators.search import order_keys, search
from quillon.operators.transform import finalize, transform
from quillon.plans.query import QueryError
from quillon.sinks import publish, render
from quillon.sources.jsonl import canonical_flag, checked, local_dump, parse_records, read_lines
from quillon.streaming.upserts import upsert
from tests.sql_check import connect, differences


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", list(pipeline.SQL))
def test_query_matches_sql(spark, data, con, name):
    assert differences(pipeline.QUERIES[name](spark, data), con, pipeline.SQL[name]) == []


def record(**more):
    base = dict(id="A1", oracle_id="O1", name="Fire // Ice", lang="en", released_at="2001-06-04", layout="split", type_line="Instant // Instant", set="APC", set_type="expansion", collector_number="128a", rarity="uncommon", colors=["R", "U"], color_identity=["R", "U"], legalities={"modern": "legal"}, prices={"usd": None, "usd_foil": "1.50"}, edhrec_rank="77", border_color="black", frame="1997", frame_effects=["legendary"], finishes=["nonfoil"], games=["paper"], promo=True, promo_types=["judgegift"], artist="A & B", artist_ids=["x", "y"], custom={"k": 1}, illustration_id="I1")
    return base | more


FACES = [dict(name="Fire", mana_cost="{1}{R}", type_line="Instant", oracle_text="Fire deals damage.", colors=["R"]), dict(name="Ice", mana_cost="{1}{U}", type_line="Instant — Trap", oracle_text="Tap it.", power="2", toughness="1+*", printed_name="Eis", illustration_id="I2")]


def transformed(spark, *records):
    lines = [r if isinstance(r, str) or r is None else json.dumps(r) for r in records]
    return transform(parse_records(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, line string")))


def test_faces_are_merged(spark):
    row = transformed(spark, record(card_faces=FACES)).first()
    assert row["type_line"] == "Instant // Instant — Trap" and row["card_types"] == ["Instant"] and row["card_subtypes"] == ["Trap"]
    assert row["oracle_text"] == "Fire deals damage.\n//\nTap it." and row["flavor_text"] == "" and row["mana_cost_text"] == "{1}{R}"
    assert row["card_colors"] == ["R", "U"] and (row["creature_power"], row["creature_toughness"]) == (2.0, 1.0)
    assert row["price_usd"] == 1.5 and row["edhrec_rank"] == 77 and row["collector_number_int"] == 128 and row["card_rarity_int"] == 1
    assert set(row["card_is_tags"]) == {"promo", "judge"} and row["card_frame_data"] == ["1997", "Legendary"]
    assert row["printed_name_folded"] == "fire // eis" and row["residue"] == {"custom": '{"k":1}'} and row["illustration_id"] == "i1"


def test_type_words_of_all_rows(spark, data, tmp_path):
    faces = [dict(name="a", type_line="Legendary Creature — Elf Scout"), dict(name="b", type_line="Creature — Elf  wall"), dict(name="c")]
    lines = [record(card_faces=faces, type_line="Instant — Trap"), record(), record(card_faces=[])]
    spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "line_no bigint, line string").write.parquet(str(tmp_path / "bulk_lines.parquet"))
    own = sorted(tuple(r) for r in pipeline.QUERIES["prj_type_words_all"](spark, str(tmp_path)).collect())
    assert own == sorted([*((0, "type", w) for w in ("Legendary", "Creature", "Instant")), *((0, "subtype", w) for w in ("Elf", "Scout", "Wall", "Trap")), (1, "type", "Instant"), (1, "type", "//")])

    got = {tuple(r) for r in pipeline.QUERIES["prj_type_words_all"](spark, data).collect()}
    plain = {tuple(r) for r in pipeline.QUERIES["prj_type_words"](spark, data).collect()}
    expected = set()
    for r in pipeline.rows(spark, data).where("size(card_faces) > 0").select("line_no").join(spark.read.parquet(f"{data}/bulk_lines.parquet"), "line_no").select("line_no", "line").collect():
        whole = json.loads(r["line"])
        for face in whole["card_faces"]:
            halves = (whole["type_line"] if face.get("type_line") is None else face["type_line"]).title().split("—", 1)
            expected |= {(r["line_no"], kind, w) for kind, half in zip(("type", "subtype"), halves, strict=False) for w in half.split()}
    assert expected and got - plain == expected and plain <= got


def test_incomplete_and_odd_records(spark):
    assert transformed(spark, record(id=None), record(colors=None), record(card_faces=[]), "", None, "{", "[1]", '"x"').count() == 0
    odd = transformed(spark, record(cmc="2.5", edhrec_rank=True, card_faces=None, rarity="odd", type_line="Legendary Creature — Urza's Aura-thing", set_type="memorabilia")).first()
    assert odd["cmc"] == 2.5 and odd["edhrec_rank"] is None and odd["card_rarity_int"] == -1 and "extra" in odd["card_is_tags"]
    assert odd["card_subtypes"] == ["Urza'S", "Aura-Thing"] and odd["card_faces"] == []


def test_sources(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "default_cards.jsonl.gz", "wt") as f:
        f.write("\n".join([json.dumps(record()), "<html>", json.dumps(record(id="B"))]))
    lines = read_lines(spark, local_dump(str(tmp_path), "default_cards"))
    assert checked(parse_records(lines)).count() == 2
    broken = spark.createDataFrame([("x" * 1000,)] * 1200, "line string")
    with pytest.raises(ValueError):
        checked(parse_records(broken))
    with pytest.raises(FileNotFoundError):
        local_dump(str(tmp_path), "rulings")
    rows = canonical_flag(transform(parse_records(lines)), spark.createDataFrame([("A1",)], "id string"))
    assert {r["scryfall_id"]: r["is_canonical"] for r in rows.collect()} == {"a1": True, "b": False}


def test_finalize_counts_over_the_whole_catalogue(spark):
    tags = spark.createDataFrame(
        [(1, "T1", "Card Draw!", None, [("O1", None)], 1), (2, "t2", "advantage", None, [], 1), (3, "t1", "card draw", ["t2"], [("O1", None), (None, "I2")], 2)],
        "row_no bigint, id string, slug string, parent_ids array<string>, taggings array<struct<oracle_id:string,illustration_id:string>>, updated_at int",
    )
    rows = transformed(spark, record(card_faces=FACES), record(id="a2", set="two", released_at="2010-01-01", edhrec_rank=None, name="Other", collector_number="9"), record(id="a3", lang="ja", name="Third", edhrec_rank=5, collector_number="128a"))
    final = {r["scryfall_id"]: r for r in finalize(rows, tags).collect()}
    assert final["a1"]["card_oracle_tags"] == ["advantage", "card-draw"] and final["a1"]["card_art_tags"] == ["advantage", "card-draw"] and final["a2"]["card_art_tags"] == []
    assert (final["a1"]["cubecobra_score"], final["a2"]["cubecobra_score"], final["a3"]["cubecobra_score"]) == (12.5, 25.0, 0.0)
    assert final["a1"]["illustration_count"] == 1 and final["a3"]["illustration_count"] == 0
    assert final["a2"]["prefer_score"] > final["a1"]["prefer_score"] > final["a3"]["prefer_score"]  # newer first, then the better of one slot
    pinned = {r["scryfall_id"]: r["prefer_score"] for r in finalize(rows, None, spark.createDataFrame([("o1", "apc", "128a")], "oracle_id string, card_set_code string, collector_number string")).collect()}
    assert pinned["a1"] > pinned["a2"]


def test_percent_ranks_need_the_whole(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 3), ("d", None), ("a", 9)], "name string, rank int").coalesce(1).withColumn("seen", F.monotonically_increasing_id())
    assert {r["name"]: round(r["score"], 4) for r in name_percent_ranks(df, "name", "rank", "seen").collect()} == {"a": 0.0, "b": 0.0, "c": 16.6667, "d": 25.0}
    assert name_percent_ranks(df.limit(1), "name", "rank", "seen").first()["score"] == 0.0
    assert name_percent_ranks(df.where("false"), "name", "rank", "seen").count() == 0


def test_slots_rank_as_people_count(spark):
    rows = [("o", "s", n, d, lang) for n, d, lang in [("10", "2020-01-01", "en"), ("9", "2020-01-01", "en"), ("A1", "2024-01-01", "en"), ("11", "2024-01-01", "ja"), ("3", "2021-01-01", "en"), ("3", "2021-01-01", "ja")]]
    df = spark.createDataFrame(rows, "oracle_id string, set_code string, collector_number string, released string, lang string").withColumn("released", F.col("released").cast("date"))
    assert [r["collector_number"] for r in slot_ranks(df).orderBy("rank").collect()] == ["3", "9", "10", "A1", "11"]


def test_publish_load_query_and_prune(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = finalize(transformed(spark, record(card_faces=FACES), record(id="a2", name="Other", oracle_id="o2")))
    with pytest.raises(FileNotFoundError):
        publish.manifest(spark, folder)
    builds = [publish.publish(rows, folder, 2)["build"] for _ in range(3)]
    assert publish.history(spark, folder) == [builds[2], builds[1]] and publish.manifest(spark, folder)["cards"] == 2
    assert not (tmp_path / "store" / f"build={builds[0]}").exists()
    loaded = prepare(publish.load(spark, folder))
    assert [r["scryfall_id"] for r in search(loaded, "fire o:damage m:{R}").rows.collect()] == ["a1"]
    one, many = (sorted(r["scryfall_id"] for r in search(prepare(publish.load(spark, folder, publish.publish(rows, folder, n)["build"])), "").rows.collect()) for n in (1, 7))
    assert one == many == ["a1", "a2"]


def test_rendering(spark):
    p = prepare(finalize(transformed(spark, record(card_faces=FACES), record(id="a2", name='Say "x", y', oracle_id="o2", oracle_text="", artist=None)))).cache()
    assert render.select_fields(p, ["name", "cmc", "name"]).columns == ["name", "cmc"]
    for bad in ([], ["nope"]):
        with pytest.raises(QueryError):
            render.select_fields(p, bad)
    text = render.csv_text(p.orderBy("scryfall_id")).split("\n")
    assert text[0].startswith("multiverse_id,mtgo_id,set,collector_number") and '"Say ""x"", y"' in text[2] and text[1].endswith("/fire-ice,a1") and ",,1.5,,," in text[1]
    assert render.csv_cell("") == '""' and render.csv_cell(None) == "" and render.csv_cell("a") == "a"
    lines = p.select(F.col("scryfall_id"), render.card_text().alias("t")).orderBy("scryfall_id").collect()
    assert lines[0]["t"].split("\n")[0] == "Fire {1}{R}" and "2/1" in lines[0]["t"] and "\n\nIce" in lines[0]["t"]
    obj = json.loads(p.where("scryfall_id = 'a1'").select(render.card_object().alias("o")).first()["o"])
    assert obj["colors"] == ["U", "R"] and obj["prices"]["usd"] is None and obj["prices"]["usd_foil"] == "1.50" and len(obj["prices"]) == 6 and obj["mana_cost"] == "{1}{R} // {1}{U}" and [f["name"] for f in obj["card_faces"]] == ["Fire", "Ice"] and obj["scryfall_uri"].endswith("/fire-ice") and obj["rarity"] == "uncommon"
    found = search(p, "t:instant")
    columns = json.loads(render.columns_json(render.select_fields(found.rows, ["name"]), []))
    assert len(columns["name"]) == 2
    assert json.loads(render.rows_json(render.select_fields(p, ["name", "power"])).orderBy("value").first()["value"]).keys() == {"name", "power"}
    page = render.list_object(found, ["x"], size=1)
    assert page["has_more"] and page["next_page"]["page"] == 2 and page["next_page"]["order"] == "edhrec" and page["total_cards"] == 2
    assert render.list_object(search(p, "cmc>90"), [])["status"] == 404 and render.list_object(found, [], number=9)["status"] == 422
    assert [render.page_number(x) for x in (None, "2", "3x", "-1", "x")] == [1, 2, 3, 1, 1]
    assert {r["type"]: r["n_cards"] for r in type_counts(p).collect()}["Instant"] == 2
    assert keyword_counts(p).count() == 0 and len(order_keys("set")) == 6


def test_write_csv_reads_back(spark, tmp_path):
    p = prepare(finalize(transformed(spark, record(card_faces=FACES))))
    render.write_csv(p, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["name"] == "Fire // Ice"


@pytest.mark.parametrize(
    "text,cost,colors,cmc",
    [("rr2", "{2}{R}{R}", "R", 4), ("{g}{w}", "{G}{W}", "GW", 2), ("uw", "{W}{U}", "WU", 2), ("x{2/r}", "{X}{2/R}", "R", 2), ("0", "{0}", "", 0), ("", "{0}", "", 0), ("zyxc{r/p}1", "{X}{Y}{Z}{1}{R/P}{C}", "R", 3), ("11", "{11}", "", 11), ("{hw}", "{HW}", "W", 0.5), ("wur", "{U}{R}{W}", "URW", 3)],
)
def test_costs(text, cost, colors, cmc):
    c = parse_cost(text)
    assert (c.cost, "".join(c.colors), c.cmc) == (cost, colors, cmc)
    assert (c.colorless, c.monocolored, c.multicolored) == (len(colors) == 0, len(colors) == 1, len(colors) > 1)


def test_bad_costs_and_the_wheel():
    for bad in ("q!", "{foo}", "r-", "{w/u/b}", "q"):
        with pytest.raises(QueryError):
            parse_cost(bad)
    assert wheel_order(set("WG")) == ("G", "W") and wheel_order(set("WUB")) == ("W", "U", "B") and wheel_order(set()) == ()


def test_stream_of_deliveries(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    schema = "scryfall_id string, oracle_id string, card_name string, v int"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upsert(stream, folder, checkpoint, ["v"], 1).awaitTermination()
        return {r["scryfall_id"]: r["card_name"] for r in publish.load(spark, folder).collect()}

    assert deliver([("A", "o", "one", 1), ("b", "o", "two", 1)]) == {"a": "one", "b": "two"}
    assert deliver([("a", "o", "new", 2), ("b", "o", "late", 0)]) == {"a": "new", "b": "two"}
    assert len(publish.history(spark, folder)) == 2
