import pytest

from quillon.operators import lookup
from quillon.operators.prepare import cost_counts, current, prepare, stat, with_artist_spellings
from quillon.operators.search import listing, sample, search
from quillon.plans.query import QueryError

ROWS = [
    dict(scryfall_id="a1", oracle_id="A", card_name="Jötun Grunt", card_lang="en", card_set_code="one", collector_number="9", cmc=2.0, card_colors=["W"], card_color_identity=["W"], type_line="Creature — Giant", creature_power=4.0, creature_toughness=4.0, prefer_score=2.0, price_usd=1.0, released_at="2010-05-01", card_artist="Ann Lee", artist_ids=["x"], oracle_text="Trample (It pierces.)", illustration_id="i1"),
    dict(scryfall_id="a2", oracle_id="A", card_name="Jötun Grunt", card_lang="en", card_set_code="two", collector_number="10", cmc=2.0, card_colors=["W"], card_color_identity=["W"], type_line="Creature — Giant", creature_power=4.0, creature_toughness=4.0, prefer_score=2.0, price_usd=None, released_at="2012-05-01", card_artist="A. Lee", artist_ids=["x"], oracle_text="Trample", illustration_id="i2"),
    dict(scryfall_id="a3", oracle_id="A", card_name="Jötun Grunt", card_lang="ja", card_set_code="two", collector_number="10", cmc=2.0, card_colors=["W"], card_color_identity=["W"], type_line="Creature — Giant", prefer_score=9.0, is_canonical=False, released_at="2012-05-01", printed_name="ヨツン"),
    dict(scryfall_id="b1", oracle_id="B", card_name="Fire // Ice", card_lang="en", card_set_code="one", collector_number="12a", cmc=4.0, card_colors=["R", "U"], card_color_identity=["R", "U"], type_line="Instant // Instant", prefer_score=1.0, price_usd=3.0, card_layout="split", card_faces=[("Fire", "Instant", "{1}{R}", ["R"], None, None), ("Ice", "Instant", "{1}{U}", ["U"], None, None)]),
    dict(scryfall_id="c1", oracle_id="C", card_name="Werebear", card_lang="en", card_set_code="one", collector_number="2", cmc=None, card_colors=["G"], card_color_identity=["G"], type_line="Creature — Bear // Creature — Bear", prefer_score=float("nan"), card_faces=[("Were", "Creature", "{G}", None, "1", "4"), ("Bear", "Creature", "", None, "5", "1+*")], card_is_tags=["extra"]),
    dict(scryfall_id="d1", oracle_id=None, card_name=None, card_lang=None, card_set_code=None, type_line=None),
]
SCHEMA = "scryfall_id string, oracle_id string, card_name string, card_lang string, card_set_code string, collector_number string, cmc double, card_colors array<string>, card_color_identity array<string>, type_line string, creature_power double, creature_toughness double, prefer_score float, price_usd double, released_at string, card_artist string, artist_ids array<string>, oracle_text string, illustration_id string, is_canonical boolean, printed_name string, card_layout string, card_faces array<struct<name:string,type_line:string,mana_cost:string,colors:array<string>,power:string,toughness:string>>, card_is_tags array<string>"


@pytest.fixture(scope="module")
def cards(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return prepare(spark.createDataFrame([tuple(r.get(n) for n in names) for r in ROWS], SCHEMA)).cache()


def ids(result):
    return [r["scryfall_id"] for r in result.rows.collect()]


ALL = dict(unique="printing", orderby="name", include_extras=True, include_multilingual=True)


@pytest.mark.parametrize(
    "query,expected",
    [
        ("", {"a1", "a2", "a3", "b1", "c1", "d1"}),
        ("jotun", {"a1", "a2", "a3"}),
        ('"jotun"', set()),
        ('"jötun"', {"a1", "a2", "a3"}),
        ("!JotunGrunt", {"a1", "a2", "a3"}),
        ("-cmc<3", {"b1", "c1", "d1"}),
        ("cmc>=0", {"a1", "a2", "a3", "b1"}),
        ("o:pierces", set()),
        ("fo:pierces", {"a1"}),
        ("c=r", {"b1"}),
        ("c:ur", set()),
        ("id:ur", {"b1", "d1"}),
        ("id:wubrg", {"a1", "a2", "a3", "b1", "c1", "d1"}),
        ("pow>tou", {"c1"}),
        ("pow=5 pow=1", {"c1"}),
        ("tou=1", {"c1"}),
        ("pow=tou", {"a1", "a2", "c1"}),
        ("m:{R}", {"b1"}),
        ("m={1}{U}", {"b1"}),
        ("m>=1", {"b1", "c1"}),
        ("m>=2", {"b1"}),
        ("m=0", set()),
        ("devotion:{W}", set()),
        ("a:annlee", {"a1"}),
        ("layout:split", {"b1"}),
        ("is:localizedname", {"a3"}),
        ("usd/cmc>=0.5", {"a1", "b1"}),
        ("cmc/(cmc-2)>0", {"b1"}),
        ("date>2010", {"a2", "a3"}),
        ("t:/bear$/", {"c1"}),
    ],
)
def test_filters(cards, query, expected):
    if "(cmc-2)" in query:  # a group is a condition, never an operand of a sum that starts with it
        with pytest.raises(QueryError):
            search(cards, "(t:elf)+1>2", **ALL)
    assert set(ids(search(cards, query, limit=None, **ALL))) == expected


def test_default_lane_leaves_out_extras_and_other_languages(cards):
    assert set(ids(search(cards, "cmc>0 or t:creature", unique="printing"))) == {"a1", "a2", "b1"}
    assert "a3" in ids(search(cards, "lang:ja", unique="printing"))


def test_representative_is_chosen_within_the_filter(cards):
    assert ids(search(cards, "t:giant", prefer="oldest")) == ["a1"]
    assert ids(search(cards, "t:giant", prefer="newest")) == ["a2"]
    assert ids(search(cards, "t:giant e:two")) == ["a2"]
    assert ids(search(cards, "t:giant")) == ["a1"]  # equal scores: the lesser id
    assert ids(search(cards, "t:giant", unique="artwork", orderby="name")) == ["a1", "a2"]


def test_unknown_prices_are_lowest_either_way(cards):
    assert ids(search(cards, "t:giant or t:instant", unique="printing", orderby="usd", direction="asc")) == ["a2", "a1", "b1"]
    assert ids(search(cards, "t:giant or t:instant", unique="printing", orderby="usd")) == ["b1", "a1", "a2"]


def test_pages_join_to_the_whole(cards):
    whole = ids(search(cards, "", limit=None, **ALL))
    assert sum((ids(search(cards, "", limit=2, offset=o, **ALL)) for o in (0, 2, 4)), []) == whole
    assert ids(search(cards, "", limit=0, **ALL)) == [] and search(cards, "", limit=1, **ALL).total() == 6


def test_bad_options(cards):
    for bad in (dict(limit=-1), dict(offset=-1), dict(unique="x"), dict(orderby="x"), dict(prefer="x"), dict(direction="x")):
        with pytest.raises(QueryError):
            search(cards, "", **bad)


def test_sample_is_reproducible(cards):
    once = [r["scryfall_id"] for r in sample(cards, "", 2, seed=1, include_extras=True).collect()]
    assert once == [r["scryfall_id"] for r in sample(cards, "", 2, seed=1, include_extras=True).collect()] and len(once) == 2
    with pytest.raises(QueryError):
        sample(cards, "", 0)
    assert listing(cards).count() == 5  # all but the one in another language


def test_artists_answer_to_all_their_spellings(cards):
    more = with_artist_spellings(cards, "artist_ids")
    assert set(ids(search(more, "a:annlee", **ALL))) == {"a1", "a2"}


def test_lookups(cards, spark):
    first = lambda df: [r["scryfall_id"] for r in df.collect()]
    assert first(lookup.exact(cards, "jotun grunt")) == ["a1"] and first(lookup.exact(cards, "Jotun Grunt", "TWO")) == ["a2"]
    assert first(lookup.exact(cards, "ice")) == ["b1"] and first(lookup.exact(cards, "no such")) == []
    hit = lookup.fuzzy(cards, "Jotun Gruntt").collect()
    assert hit[0]["scryfall_id"] == "a1" and not hit[0]["ambiguous"]
    assert lookup.fuzzy(cards, "Jotun Grnt").count() == 0 and lookup.fuzzy(cards, "zzz").count() == 0  # 8 of 13 trigrams: below the floor
    assert first(lookup.containing(cards, "grunt jo")) == ["a1"] and lookup.containing(cards, " ").count() == 0
    assert [r["card_name"] for r in lookup.autocomplete(cards, "jo").collect()] == ["Jötun Grunt"] and lookup.autocomplete(cards, "j").count() == 0
    asked = spark.createDataFrame([(1, "one", "9", None), (2, None, None, "fire ice"), (3, None, None, "nope"), (4, "one", "9", None)], "position int, set string, collector_number string, name string")
    found, missing = lookup.collection(cards, asked)
    assert sorted((r["position"], r["scryfall_id"]) for r in found.collect()) == [(1, "a1"), (2, "b1"), (4, "a1")]
    assert [r["position"] for r in missing.collect()] == [3]
    assert first(lookup.by_id(cards, " A1 ")) == ["a1"] and first(lookup.by_number(cards, "ONE", "9")) == ["a1"]


def test_stats_and_costs(spark):
    df = spark.createDataFrame([("1+*",), ("7-*",), ("*²",), ("∞",), ("3.5",), ("-1",), (None,), ("x",)], "s string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(stat(F.col("s"))).collect()] == [1.0, 7.0, 0.0, None, 3.5, -1.0, None, None]
    costs = spark.createDataFrame([("{2}{R}{R}{W/U}",), ("",), (None,), ("{0}",)], "s string").select(cost_counts(F.col("s"))).collect()
    assert [r[0] for r in costs] == [{"#": 2, "R": 2, "W/U": 1}, None, None, {}]


def test_current_takes_the_latest_and_drops_removed(spark):
    df = spark.createDataFrame([(" X ", 1, None), ("x", 2, None), ("y", 1, 5), ("", 3, None), (None, 4, None)], "scryfall_id string, v int, gone int")
    assert [(r["scryfall_id"], r["v"]) for r in current(df, ["v"], "gone").collect()] == [("x", 2)]
    assert prepare(df.limit(0)).count() == 0


def test_lenient_search_warns(cards):
    found = search(cards, "t:giant f:nosuch", lenient=True)
    assert found.warnings == ["Unknown format “nosuch”."] and ids(found) == ["a1"]
    with pytest.raises(QueryError):
        search(cards, "f:nosuch", lenient=True)


def test_first_of_each_query(cards):
    got = {(r["query_no"], r["scryfall_id"]) for r in lookup.first_of_each(cards, ["t:giant", "t:none", "c=r"]).collect()}
    assert got == {(0, "a1"), (2, "b1")}


def test_ids_of_other_catalogues(spark, cards):
    rows = spark.createDataFrame([("p1", "o", "i", [5, 6], {"arena_id": 9}), ("p2", "o", None, None, None)], "scryfall_id string, oracle_id string, illustration_id string, multiverse_ids array<bigint>, external_ids map<string,bigint>")
    assert {r["key"] for r in lookup.routing_keys(rows).collect()} == {"p1", "p2", "i", "multiverse:5", "multiverse:6", "arena_id:9"}
    prepared = prepare(rows)
    assert lookup.by_external_id(prepared, "multiverse", 6).first()["scryfall_id"] == "p1" and lookup.by_external_id(prepared, "arena_id", 9).count() == 1 and lookup.by_external_id(prepared, "mtgo_id", 9).count() == 0
    sets = spark.createDataFrame([("id1", "ABC", 7), ("id0", "abc", 8), ("abd", "xyz", None)], "id string, code string, tcgplayer_id bigint")
    assert [lookup.set_of(sets, k).first()["id"] for k in ("Abc", "ID1", "8", "abd")] == ["id0", "id1", "id0", "abd"] and lookup.set_of(sets, "none").count() == 0


def test_rulings_and_pictures(spark, cards):
    from quillon.operators.rulings import bucketed, parse_rulings
    from quillon.sinks.render import image_uris, ruling_object

    lines = ['{"oracle_id":"O ","source":"a","published_at":"2020-01-02T00:00","comment":"x"}', '{"oracle_id":"o","source":"a","published_at":"2021-01-02","comment":"z"}', '{"oracle_id":"o","source":"a","published_at":"2021-01-02","comment":"y"}', '{"oracle_id":"o","source":"","published_at":"2021-01-02","comment":"y"}', '{"oracle_id":"o","source":"a","published_at":"2021","comment":"y"}', "junk", None]
    r = parse_rulings(spark.createDataFrame([(x,) for x in lines * 2], "line string"))
    assert [x["comment"] for x in bucketed(r).first()["rulings"]] == ["y", "z", "x"]
    assert [x["comment"] for x in lookup.rulings_of(r, " O").collect()] == ["y", "z", "x"]
    assert '"object":"ruling"' in r.select(ruling_object().alias("o")).first()["o"]
    assert cards.where("scryfall_id = 'a1'").select(image_uris("http://x/").alias("u")).first()["u"]["png"] == "http://x/png/front/a/1/a1.png"


def test_partly_unknown_artworks_join_what_they_fit(spark):
    from quillon.operators.prepare import with_unified_artworks

    rows = [("a", "A", ["1", "2"]), ("b", "A", ["1", None]), ("c", "A", [None, "2"]), ("d", "A", [None, None]), ("e", "A", ["1", "3"]), ("f", "A", [None, "9"]), ("g", "B", ["1", None]), ("h", "A", [None, None])]
    df = spark.createDataFrame(rows, "scryfall_id string, card_key string, face_illustrations array<string>")
    got = {r["scryfall_id"]: r["artwork"] for r in with_unified_artworks(df).collect()}
    assert got == {"a": ["1", "2"], "b": ["1", "2"], "c": ["1", "2"], "d": [], "e": ["1", "3"], "f": ["9"], "g": ["1"], "h": []}


def test_store_is_made_anew_after_release(spark, data):
    from quillon.runtime import release
    from quillon.search_queries import corpus

    n = corpus(spark, data).count()
    release(spark)
    assert corpus(spark, data).count() == n


GRID = [(o, d, u, m) for i, o in enumerate(("artist", "cmc", "color", "edhrec", "eur", "name", "power", "rarity", "released", "set", "toughness", "usd")) for d, u, m in [(("asc", "desc")[i % 2], ("card", "printing", "artwork")[i % 3], i % 4 < 2)]]


@pytest.fixture(scope="module")
def spread(spark, data):
    """The same rows, full of ties, in other partitions and another order."""
    from quillon.search_queries import corpus

    cards = corpus(spark, data)
    return cards, cards.repartition(7, "card_name").cache()


@pytest.mark.parametrize("orderby,direction,unique,multilingual", GRID)
def test_pages_do_not_depend_on_partitions(spread, orderby, direction, unique, multilingual):
    pages = [[(r["position"], r["scryfall_id"]) for r in search(c, "t:creature or t:land", orderby=orderby, direction=direction, unique=unique, include_multilingual=multilingual, limit=37, offset=11).rows.orderBy("position").collect()] for c in spread]
    assert pages[0] == pages[1] and len(pages[0]) == 37
