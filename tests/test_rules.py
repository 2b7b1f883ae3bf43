"""The catalogue of raw records: its queries against SQL, and cases that the tables do not hold."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon import rules_queries as rules
from quillon.functions.text import collate_text, fold_accents, fold_text
from quillon.operators.catalogs import CATALOGS, catalog, set_list, symbology
from quillon.operators.lookup import collection, containing
from quillon.operators.prepare import prepare
from quillon.operators.search import search
from quillon.operators.transform import finalize, transform
from quillon.plans.policy import parse_softly, soften
from quillon.plans.query import QueryError
from quillon.sinks.render import card_object
from quillon.sources.jsonl import parse_records, read_lines
from tests.sql_check import connect, differences


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n in rules.SQL if n in ("rtx_all", "rtx_oracle", "rtx_identity", "rtx_otag_alias", "rtx_color_faces_exact", "rtx_mixed", "rtx_card_cmc", "prj_final_rows", "snk_objects", "jn_collection_kinds", "cat_values", "cat_symbols", "cat_set_list", "jn_set_of")])
def test_query_matches_sql(spark, data, con, name):
    assert differences(rules.QUERIES[name](spark, data), con, rules.SQL[name]) == []


def record(**more):
    base = dict(id="a", oracle_id="o", name="Bear", lang="en", released_at="2001-06-04", layout="normal", type_line="Creature — Bear", set="one", collector_number="1", rarity="common", colors=["G"], color_identity=["G"], legalities={}, oracle_text="")
    return base | more


@pytest.fixture(scope="module")
def cards(spark):
    face = lambda name, text, line="Creature — Bear", **m: dict(name=name, oracle_text=text, type_line=line, mana_cost="{G}") | m
    records = [
        record(id="v", oracle_id="1"), record(id="reminder", oracle_id="2", oracle_text="(It is a bear.)"), record(id="texted", oracle_id="3", oracle_text="Trample"),
        record(id="land", oracle_id="4", type_line="Land Creature — Bear"), record(id="front", oracle_id="5", layout="adventure", card_faces=[face("A", ""), face("B", "Draw a card.", "Sorcery")]),
        record(id="back", oracle_id="6", layout="transform", card_faces=[face("A", "Draw."), face("B", "")]), record(id="null", oracle_id="7", oracle_text="whole", flavor_text="own", card_faces=[face("A", None, flavor_text=None), face("B", "x")]),
        record(id="promo", oracle_id="8", promo=True, power="3", toughness="2", prices={"tix": "0.5", "usd_foil": "2"}), record(id="later", oracle_id="8", released_at="2020-01-01", power="*", toughness="1+*", prices={"tix": "7"}),
        record(id="v", oracle_id="1", name="Old Bear", lang="de"),
    ]
    lines = spark.createDataFrame([(len(records) - i, json.dumps(r)) for i, r in enumerate(records)], "line_no int, line string")
    return prepare(finalize(transform(parse_records(lines)))).cache()


def ids(cards, query, **options):
    return {r["scryfall_id"] for r in search(cards, query, unique="printing", limit=None, include_extras=True, include_variations=True, **options).rows.collect()}


def test_cards_without_text_on_their_front(cards):
    assert ids(cards, "is:vanilla") == {"v", "reminder", "front", "null", "promo", "later"}


def test_a_null_field_of_a_face_is_its_own(cards):
    row = cards.where("scryfall_id = 'null'").first()
    assert row["oracle_text"] == "x" and row["flavor_text"] == "own"


def test_of_repeated_ids_the_last_line_counts(cards):
    assert cards.where("scryfall_id = 'v'").first()["card_name"] == "Bear"


def test_preference_and_orders_by_what_the_tables_lack(cards):
    one = lambda **o: [r["scryfall_id"] for r in search(cards, "oracleid:8", include_extras=True, **o).rows.collect()]
    assert one(prefer="promo") == ["promo"] and one(prefer="newest") == ["later"]
    assert one(unique="printing", orderby="power") == ["later", "promo"] and one(unique="printing", orderby="toughness", direction="desc") == ["promo", "later"]
    assert one(unique="printing", orderby="tix") == ["later", "promo"]
    assert [r["scryfall_id"] for r in search(cards, "oracleid:8 order:tix dir:asc unique:prints", include_extras=True).rows.collect()] == ["promo", "later"]


def test_objects_by_layout(cards):
    one = lambda i: json.loads(cards.where(f"scryfall_id = '{i}'").select(card_object({"decks": "/d?q="}, back="B").alias("o")).first()["o"])
    whole, two = one("front"), one("back")
    assert whole["mana_cost"] == "{G} // {G}" and "image_uris" in whole and "colors" not in whole["card_faces"][0] and whole["card_back_id"] == "B"
    assert "mana_cost" not in two and "image_uris" not in two and two["card_faces"][1]["image_uris"]["png"].split("/")[3] == "back" and two["card_faces"][0]["oracle_text"] == "Draw."
    assert one("promo")["promo"] is True and one("promo")["prices"] == {"usd": None, "usd_foil": "2.00", "usd_etched": None, "eur": None, "eur_foil": None, "tix": "0.50"} and one("promo")["related_uris"] == {"decks": "/d?q=Bear"}
    assert len(set(one("v")) | set(two) | set(one("promo"))) > 50


def test_identifiers_of_all_kinds(spark, cards):
    asked = [(0, "v", None, None, None, None), (1, None, "8", None, None, None), (2, None, None, "bear", None, None), (3, None, None, None, "ONE", "1"), (4, "none", None, None, None, None), (5, None, None, "  ", None, None), (6, "v", None, None, None, None)]
    df = spark.createDataFrame(asked, "position int, id string, oracle_id string, name string, set string, collector_number string")
    found, missing = collection(cards, df)
    assert sorted(r["position"] for r in found.collect()) == [0, 1, 2, 3, 6] and sorted(r["position"] for r in missing.collect()) == [4, 5]
    linked = cards.withColumn("multiverse_ids", cards["multiverse_ids"]).where("scryfall_id in ('v', 'back')")
    from pyspark.sql import functions as F

    linked = linked.withColumn("multiverse_ids", F.array(F.lit(5).cast("bigint"), F.lit(6).cast("bigint"))).withColumn("external_ids", F.create_map(F.lit("mtgo_id"), F.lit(77).cast("bigint")))
    found, missing = collection(linked, spark.createDataFrame([(0, "77", None), (1, None, 6), (2, None, 9)], "position int, mtgo_id string, multiverse_id int"))
    assert sorted(r["position"] for r in found.collect()) == [0, 1] and [r["position"] for r in missing.collect()] == [2]


def test_a_whole_name_stands_alone(cards):
    assert containing(cards, "bear").count() == 1 and containing(cards, "ea").count() == 1 and containing(cards, "  ").count() == 0


def test_catalogs_and_symbols(spark, cards):
    got = {name: {r["value"] for r in catalog(cards, name).collect()} for name in CATALOGS}
    assert got["creature-types"] == {"Bear"} and got["card-types"] == {"Creature", "Land", "Sorcery"} and got["powers"] == {"3", "*"} and got["toughnesses"] == {"2", "1+*"} and got["ability-words"] == set()
    assert {r["value"] for r in catalog(cards, "ability-words", spark.createDataFrame([("ability-words", "Landfall"), ("powers", "1")], "catalog string, value string")).collect()} == {"Landfall"}
    with pytest.raises(ValueError):
        catalog(cards, "Powers")
    df = prepare(spark.createDataFrame([("a", "{2/R}{HW}{X}", "{T}: Add {C/P}.")], "scryfall_id string, mana_cost_text string, oracle_text string"))
    assert {r["symbol"]: (r["mana_value"], "".join(r["colors"])) for r in symbology(df).collect()} == {"{2/R}": (2.0, "R"), "{HW}": (0.5, "W"), "{X}": (0.0, ""), "{T}": (0.0, ""), "{C/P}": (1.0, "")}
    sets = spark.createDataFrame([("B ", "X", None, None, None, None), ("a", "x", None, None, None, 3), ("c", " ", None, None, None, None)], "id string, code string, set_name string, set_type string, released_at string, tcgplayer_id bigint").selectExpr("*", "cast(null as string) parent_set_code")
    assert [(r["code"], r["id"]) for r in set_list(sets).collect()] == [("x", "a")]


def test_folding_of_all_scripts(spark):
    texts = ["Ａｂｃ ﬁre", "Άθως Йод", "ǽ Ŋŧ ı ĸ", "½ ﷺ", "가 はﾞ", "नमस्ते", "plain", "", "n̈ṻ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["f"] for r in df.select(fold_accents(df["t"]).alias("f")).collect()] == [fold_text(t) for t in texts]
    assert collate_text("Ａｂｃ ﬁre") == "abcfire" and fold_text("Άθως") == "Αθως" and fold_text("Ŋ") == "NG" and fold_text("नमस्ते") == "नमसते"


def test_patterns_are_those_of_the_engine(cards):
    assert ids(cards, "t:/(?P<a>crea)ture/") and ids(cards, "name:/^BEAR$/") and ids(cards, r"t:/CREATURE \S BEAR/")
    for bad in ("o:/(a+)+b/", "o:/((ab)*c*)*/", "o:/[a-/", "o:/(?=a)/", r"o:/\p{Nope}/"):
        with pytest.raises(QueryError):
            ids(cards, bad)
    assert ids(cards, "t:/(cr)+ea/")


@pytest.mark.parametrize("query,left", [("t:elf r:notarare", "t:elf"), ("t:elf r>zero", "t:elf"), ("t:elf devotion:{r}{g}", "t:elf"), ("t:elf devotion:{r/g}{g/r}", "t:elf devotion:{r/g}{g/r}"), ("t:elf c:\"xyz\"", "t:elf"), ("t:elf o:/[/", "t:elf"), ("t:elf cmc:abc", "t:elf"), ("t:elf oracleid:abc", "t:elf"), ("t:elf lang:zz", "t:elf"), ("t:elf f:nope", "t:elf"), ("t:elf cmc>=abc", "t:elf (cmc<0 cmc>0)")])
def test_values_are_checked_by_kind(spark, query, left):
    text, warnings = soften(query)
    assert text == left and (len(warnings) == 1) == (left == "t:elf")
    parse_softly(query)


def test_compressed_lines_whatever_their_name(spark, tmp_path):
    import gzip

    (tmp_path / "dump.jsonl").write_bytes(gzip.compress(b'{"a":1}\n') + gzip.compress(b'{"b":2}\n'))
    (tmp_path / "plain.jsonl").write_text("x\ny\n")
    assert sorted(r["line"] for r in read_lines(spark, str(tmp_path), sniff=True).collect()) == ["x", "y", '{"a":1}', '{"b":2}']


def test_labels_pin_their_slots(spark):
    from quillon.operators.transform import pinned_slots

    lines = spark.createDataFrame([(i, json.dumps(record(id=f"r{i}", oracle_id="o", collector_number=str(i)))) for i in range(4)], "line_no int, line string")
    rows = transform(parse_records(lines))
    pins = pinned_slots(rows, spark.createDataFrame([(" R3 ",), (None,), ("none",)], "id string"))
    assert [tuple(r) for r in pins.collect()] == [("o", "one", "3")]
    scores = {r["scryfall_id"]: r["prefer_score"] for r in finalize(rows, pinned=pins).collect()}
    assert max(scores, key=scores.get) == "r3" and scores["r3"] > scores["r0"] + 1000


def test_building_the_store_collects_garbage_between_its_tables(spark, tmp_path, monkeypatch):
    import gc

    from quillon.runtime import materialise

    written, collected = [], []

    def finalize(df, tags, kept):
        for _ in range(12):
            df, path = materialise(df, "several")
            kept.append(path)
            written.append(path)
        return df

    for t in ("bulk_lines", "tags"):
        spark.range(3).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stub in {"rows": lambda spark, d: spark.range(9), "finalize": finalize, "prepare": lambda df: df, "with_card_facts": lambda df, ids: df.where("id < 5")}.items():
        monkeypatch.setattr(rules, name, stub)
    monkeypatch.setattr(gc, "collect", lambda *_: collected.append(len(written)))
    assert rules.rules_corpus(spark, str(tmp_path)).count() == 5
    assert len({n for n in collected if 0 < n < 12}) >= 2 and collected[-1] == 12
    done = len(collected)
    rules.rules_corpus(spark, str(tmp_path))
    materialise(spark.range(3), "single")
    assert len(collected) == done  # only while it is built


def test_collecting_garbage_gives_back_freed_memory_outside_the_heap(spark):
    from quillon.runtime import collect_garbage

    jvm = spark.sparkContext._jvm
    parts = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not parts.exists():
        pytest.skip("memory can't be read here")
    held = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", parts.read_text())[1]) / 1024
    taken = [jvm.java.util.zip.Deflater() for _ in range(600)]  # about 0.25 MB each, outside the heap
    for i, one in enumerate(taken):
        if i % 50 != 49:  # what stays keeps the allocator from giving back the others by itself
            one.end()
    for _ in range(2):
        jvm.System.gc()
    before = held()
    collect_garbage(spark)
    assert before - held() > 40
    for one in taken[49::50]:
        one.end()


def test_the_largest_plan_is_made_after_a_collection(spark, tmp_path, monkeypatch):
    import gc

    done = []
    for t in ("bulk_lines", "tags"):
        spark.range(3).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stub in {"rows": lambda spark, d: spark.range(9), "finalize": lambda df, tags, kept: done.append("final") or df, "prepare": lambda df: done.append("prepare") or df, "with_card_facts": lambda df, ids: df}.items():
        monkeypatch.setattr(rules, name, stub)
    monkeypatch.setattr(gc, "collect", lambda *_: done.append("collected"))
    assert rules.rules_corpus(spark, str(tmp_path)).count() == 9
    assert done[:3] == ["final", "collected", "prepare"]


def test_the_store_is_built_from_kept_rows(spark, data, monkeypatch):
    from tests.test_plans import plan

    monkeypatch.setattr(rules, "store", lambda spark, sources, build: build())
    text = plan(rules.rules_corpus(spark, data))
    assert text.count("Scan parquet") <= 10  # two mentions a scan; a plan of the rows for every reader of them took the driver's memory


def test_facts_of_cards_at_once_are_those_of_each(spark):
    from quillon.operators.prepare import with_artist_spellings, with_card_facts, with_unified_artworks, with_unique_tag

    rows = [("a", "o1", "s1", "Ann Lee", ["1"], ["x", None]), ("b", "o1", "s2", "A. Lee", ["1"], ["x", "y"]), ("c", "o2", "s1", "Bo", ["2"], [None]), ("d", None, "s1", None, None, ["z"])]
    df = prepare(spark.createDataFrame(rows, "scryfall_id string, oracle_id string, card_set_code string, card_artist string, artist_ids array<string>, face_illustrations array<string>"))
    each = with_unique_tag(with_unified_artworks(with_artist_spellings(df, "artist_ids")))
    shown = lambda df: sorted(map(repr, df.select("scryfall_id", F.array_sort("artist_entities"), "artwork", "is_tags").collect()))
    assert shown(with_card_facts(df, "artist_ids")) == shown(each) and sorted(with_card_facts(df, "artist_ids").columns) == sorted(each.columns)
