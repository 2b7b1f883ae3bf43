"""The subpackage's operators against brute force, on dirty and degenerate input."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import pages
from quillon.llm import queries as llm
from quillon.llm.leaks import LEAST_PIECE, distances, find_leaks, myers, reach
from quillon.llm.mixture import BROADCAST_SOURCES, TARGETED, VOCABULARY, _encoding, _tokens, count_tokens, mix, rates
from quillon.llm.top_groups import latest_delivery, top_n
from quillon.llm.words import words
from tests.sql_check import connect, differences

# --- top N


def best(rows, n):
    by = {}
    for g, s, t in rows:
        if g is not None and s is not None and not math.isnan(s):
            by.setdefault(g, []).append((-s, t is not None, t or "", s))
    return sorted((g, k + 1, s, t if known else None) for g, items in by.items() for k, (_, known, t, s) in enumerate(sorted(items)[:n]))


@pytest.mark.parametrize("n,bands", [(3, (0.5, 0.8, 0.95)), (1, (0.5,)), (5, ()), (40, (0.1, 0.9))])
def test_top_n(spark, n, bands):
    random.seed(n)
    score = lambda: random.choice([None, math.nan, math.inf, -math.inf, -0.0, 0.0, 1.0, 1.0, random.random()])
    groups = ["hot"] * 1500 + ["low"] * 1200 + [f"g{i % 300}" for i in range(900)] + [None] * 20
    rows = [(g, score() if g != "low" else random.random() - 5, random.choice([None, f"t{i:05d}"]), "clash", 1) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g string, s double, t string, band string, have int")
    got = sorted((r["g"], r["rank_no"], r["s"], r["t"]) for r in top_n(df, "g", "s", ["t"], n, bands).collect())
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(best([r[:3] for r in rows], n), key=key)


def test_top_n_of_nothing_and_of_equals(spark):
    schema = "g string, s float, t string"
    empty = spark.createDataFrame([], schema)
    assert top_n(empty, "g", "s", ["t"], 3).collect() == []
    assert top_n(spark.createDataFrame([(None, None, None), ("a", None, "x"), ("a", math.nan, "x")], schema), "g", "s", ["t"], 3).collect() == []
    same = spark.createDataFrame([("a", 1.0, "x")] * 7, schema)
    assert [r["rank_no"] for r in top_n(same, "g", "s", ["t"], 3).orderBy("rank_no").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        top_n(same, "g", "s", ["t"], 0)


def test_latest_delivery(spark):
    df = spark.createDataFrame([(" X", 1, 1, "old"), ("x", 1, 2, "new"), ("x", None, 9, "null"), ("", 1, 1, "no"), (None, 1, 1, "no")], "id string, at int, row int, v string")
    assert [tuple(r) for r in latest_delivery(df, "id", ["at", "row"], ["v"]).collect()] == [("x", "new")]


def test_p1_matches_sql(spark, data):
    assert differences(llm.p1_found(spark, data), connect(data), llm.ORACLE["p1_found"]) == []


# --- leaks


def distance_by_table(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        above, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (p != c)))
    return min(row)


@given(st.text(alphabet="ab c", max_size=12), st.text(alphabet="ab c", max_size=20))
def test_myers(pattern, text):
    assert myers(pattern, text) == distance_by_table(pattern, text)


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
@settings(max_examples=300)
def test_words(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf")).lower()
    expected = "".join(c if c.isalnum() else " " for c in plain).split(" ")
    assert words(text) == [w for w in expected if w]


def leaks_by_windows(docs, items, window):
    out = set()
    for d, text in docs:
        own = words(text)
        for i, item in items:
            w = words(item)
            n = min(window, len(w))
            if n and any(own[a : a + n] == w[b : b + n] for a in range(len(own) - n + 1) for b in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_windows(spark):
    random.seed(5)
    vocabulary = ["Ärger", "tap", "the", "card", "7", "mana", "né", "İ", "ﬁre"]
    text = lambda n: " ".join(random.choice(vocabulary) + random.choice(["", ",", "­", "!", "\n"]) for _ in range(n))
    items = [(i, text(random.choice([2, 3, 5, 9]))) for i in range(25)] + [(90, None), (91, " ..! "), (3, "tap")]
    docs = [(i, text(random.choice([0, 4, 40]))) for i in range(120)] + [(500, None), (501, ""), (502, items[0][1] * 3000)]
    docs += [(600 + i, "x " + unicodedata.normalize("NFD", t).upper()) for i, t in items[:5]]
    d, q = spark.createDataFrame([(*r, 0) for r in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")
    expected = leaks_by_windows(docs, items, 4)
    for block in (4 << 20, 200):  # one block, and more blocks than a worker keeps
        got = [(r["doc_id"], r["item_id"]) for r in find_leaks(d, q, window=4, errors=1, block_bytes=block).where("edits = 0").collect()]
        assert set(got) == expected and len(got) == len(set(got))
    assert find_leaks(d.limit(0), q).collect() == [] and find_leaks(d, q.limit(0)).collect() == []


def beginnings(pattern, text):
    """Edits between a pattern and the beginning of a text that is most like it."""
    row = list(range(len(text) + 1))
    for i, p in enumerate(pattern, 1):
        above, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (p != c)))
    return min(row)


@given(st.text(alphabet="ab ", max_size=14), st.text(alphabet="ab ", max_size=18), st.integers(0, 3))
def test_distances_of_beginnings(pattern, text, most):
    ends = list(range(1, len(pattern) + 1))
    exact = [beginnings(pattern[:e], text) for e in ends]
    assert distances(pattern, text, ends, most) == [d if d <= most else None for d in exact]
    assert reach(pattern, text, most) == [max([e for e, d in zip(ends, exact, strict=True) if d <= k], default=0) for k in range(most + 1)]


def edited(s):
    s = list(s)
    for _ in range(random.choice([0, 0, 1, 2, 3])):
        i = random.randrange(len(s))
        s[i] = random.choice([random.choice("abx "), "", s[i] + random.choice("ab ")])
    return "".join(s)


@pytest.mark.parametrize("window,errors", [(2, 3), (3, 1), (4, 2), (12, 2), (12, 0), (6, 1)])
def test_edited_leaks_against_tables(spark, window, errors):
    random.seed(window * 10 + errors)
    vocabulary = "lantern moth of a the card old heron reach tide anvil mason".split()
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, text(random.choice([1, 2, 5, 9, 20]))) for i in range(12)]
    docs = []
    for i in range(150):
        source = random.choice(items)[1].split()
        lo = random.randrange(len(source))
        docs.append((i, f"{text(random.randrange(6))} {edited(' '.join(source[lo : lo + random.randrange(1, 15)]))} {text(random.randrange(6))}"))
    expected = {}
    for d, body in docs:
        body = f" {' '.join(words(body))} "
        for i, item in items:
            w = words(item)
            n = min(window, len(w))
            passages = {f" {' '.join(w[j : j + n])} " for j in range(len(w) - n + 1)}
            edits = [e for p in passages if (e := distance_by_table(p, body)) <= max(0, min(errors, len(p) // LEAST_PIECE - 1))]
            if edits:
                expected[d, i] = (len(edits), edits.count(0), len(passages), min(edits))
    got = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), window, errors)
    assert {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in got.collect()} == expected and expected


def test_a_short_item_has_to_be_met_as_it_is(spark):
    d = spark.createDataFrame([(1, "the cat sat on a mat"), (2, "a dog sat")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in find_leaks(d, spark.createDataFrame([(1, "dog")], "item_id bigint, text string"), errors=2).collect()] == [2]


def test_edited_leaks(spark):
    item = "neither the old lantern nor the new lantern has reach when the tenth card leaves"
    docs = [(1, item), (2, item.replace("lantern", "lanterm", 1)), (3, item.replace("old", "odl")), (4, "neither the old lamp nor a new one has reach"), (5, "so " + item.replace("tenth", "tnth") + " there")]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r["edits"] for r in find_leaks(d, q, window=99, errors=2).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 5: 1}
    part = {r["doc_id"]: (r["passages"], r["of_passages"]) for r in find_leaks(d, q, window=5, errors=0).collect()}
    assert part[1] == (11, 11) and 0 < part[2][0] < 11 and 4 not in part


# --- mixture


def test_tokens_of_pieces_add_up():
    encoding = _encoding(VOCABULARY)
    random.seed(1)
    text = "".join(random.choice(["word", " the", "  ", "\n\n", "é", "42", "!?", " x"]) for _ in range(120_000))
    assert _tokens(encoding, text) == len(encoding.encode_ordinary(text))


SOURCES = "source string, target_share double, max_copies int, tokens bigint"


def test_rates_meet_every_share_when_they_can(spark):
    found, size = rates(spark.createDataFrame([("a", 0.5, 1, 1000), ("b", 0.3, 4, 100), ("none", 0.1, 2, 0), ("c", 0.2, 2, 400)], SOURCES))
    rows = found.collect()
    sizes = {s["source"]: s["rate"] * s["tokens"] for s in rows}
    total = sum(sizes.values())
    assert total == pytest.approx(size) == pytest.approx(4 * 100 / 0.3) and all(s["rate"] <= s["max_copies"] for s in rows)
    assert [sizes[n] / total for n in "abc"] == pytest.approx([0.5, 0.3, 0.2]) and sizes["none"] == 0


def test_rates_of_a_given_total_hand_on_what_is_missing(spark):
    two = spark.createDataFrame([("a", 0.5, 10, 1000), ("b", 0.5, 2, 100)], SOURCES)
    a, b = rates(two, 2000)[0].orderBy("source").collect()
    assert b["rate"] == 2 and a["rate"] == pytest.approx(1.8)
    a, b = rates(two, TARGETED)[0].orderBy("source").collect()
    assert b["rate"] == 2 and a["rate"] == pytest.approx(0.9)
    assert all(s["rate"] == s["max_copies"] for s in rates(spark.createDataFrame([("a", 1.0, 2, 10), ("b", 1.0, 3, 10)], SOURCES), 1e9)[0].collect())
    random.seed(4)
    many = [(f"s{i}", random.random(), random.randrange(4), random.randrange(500)) for i in range(60)]
    rows = rates(spark.createDataFrame(many, SOURCES), 12_000)[0].collect()
    assert sum(r["rate"] * r["tokens"] for r in rows) == pytest.approx(min(12_000, sum(m * t for _, _, m, t in many)))
    level = {r["rate"] * r["tokens"] / r["target_share"] for r in rows if 0 < r["rate"] < r["max_copies"]}
    assert max(level) == pytest.approx(min(level)) and all(r["max_copies"] * r["tokens"] / r["target_share"] <= max(level) * (1 + 1e-9) for r in rows if r["rate"] and r["rate"] == r["max_copies"])


def test_more_sources_than_are_broadcast(spark):
    n = BROADCAST_SOURCES + 1
    documents = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.lit("word").alias("text"))
    targets = spark.range(n).select(F.concat(F.lit("S"), "id").alias("source"), F.lit(0.5).alias("target_share"), F.lit(2).alias("max_copies"))
    mixed, report = mix(documents, targets)
    assert mixed.count() == 2 * n and report.agg(F.sum("n_copies"), F.count("*")).first() == (2 * n, n)


def test_mix(spark):
    docs = [(i, "one two three" if i % 3 else None, ["A-b", " a_B", "a b", "other", None, "tiny" if i % 30 == 5 else "other"][i % 6]) for i in range(3000)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a_b", 0.6, 1), ("Tiny", 0.3, 3), ("absent", 0.2, 2), (None, 0.5, 1), ("tiny", None, None)], "source string, target_share double, max_copies int")
    mixed, report = mix(documents, targets, seed=3)
    rows = mixed.collect()
    assert {r["source"] for r in rows} == {"a_b", "tiny"} and max(r["copy_no"] for r in rows if r["source"] == "a_b") == 1 and max(r["copy_no"] for r in rows) == 3
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    told = {r["source"]: r for r in report.collect()}
    assert set(told) == {"a_b", "tiny", "absent"} and told["absent"]["n_copies"] == 0
    assert told["tiny"]["actual_share"] == pytest.approx(1 / 3, abs=0.03) and told["a_b"]["actual_share"] == pytest.approx(2 / 3, abs=0.03)
    assert {s: r["n_copies"] for s, r in told.items()} == {s: sum(r["source"] == s for r in rows) for s in told}
    again = mix(documents.repartition(7), targets, seed=3)[0]
    assert sorted(map(tuple, again.select("doc_id", "copy_no").collect())) == sorted((r["doc_id"], r["copy_no"]) for r in rows)
    filled = {r["source"]: r for r in mix(documents, targets, TARGETED)[1].collect()}
    assert filled["tiny"]["rate"] == 3 and filled["tiny"]["missing_tokens"] > 0 and filled["a_b"]["missing_tokens"] >= 0 and filled["a_b"]["n_copies"] > told["a_b"]["n_copies"]
    assert mix(documents, targets.limit(0))[0].collect() == [] and mix(documents.limit(0), targets)[0].collect() == []


def test_count_tokens_of_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", " X "), (3, "word " * 60_000, "x-y")], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in count_tokens(df).collect()}
    assert got[1] == (None, 0) and got[2] == ("x", 0) and got[3] == ("x_y", len(_encoding(VOCABULARY).encode_ordinary("word " * 60_000)))


# --- pages

PROSE = [
    "The owner of this lantern draws three cards when it leaves the field, and that is why we play it. It has been good to us in every match so far!",
    "Nobody expected the heron to hold off nine attackers.\nIt did, and the table went quiet for a while.\nWe still talk about it when the store closes.",
    "- When the board is empty, this costs one more than it should.\n- In the second game it came back from the graveyard, which is easy to miss.\n- I cut it for a land because the deck was too slow.",
    "[Old Lantern](http://shop.example/p/12) was reprinted with new art, and I would rather hold it than the moth. See https://a.example/x for the list that we used in the final.",
    "El dueño de la linterna roba tres cartas cuando deja el campo. Nadie esperaba verla en la final, porque casi nadie guarda maná.",
    "Nach der letzten Änderung kostet die Laterne drei mehr, weil selten Mana offen bleibt. Im zweiten Spiel kehrt sie nur einmal zurück.",
    "新しい版によるとランタンの能力は八マナ多くかかる。二本目では墓地から戻ると思う。遅いデッキには強いカードだ。",
    "it keeps its reach, which is easy to miss / on a tight budget i would rather hold the moth than the heron / we counted nine copies of it in the top tables",
]
LISTS = [
    "foil lantern, moth singles, heron store, reach cards, old basin, foil heron, tides singles, moth store, trample cards, foil basin, weaver, lantern singles, anvil store",
    "\n".join(f'<a href="https://x{i}-cards.example/p/{i}">Old Lantern of Place{i}</a>' for i in range(20)),
    "\n".join(f"* [Next page](http://y{i}.test/set/{i})" for i in range(15)),
    "\n".join(f"www.z{i}-shop.example/p/{i}" for i in range(20)),
    " ".join(f"#tag{i % 17}" for i in range(60)),
    "\n".join(f"Old Lantern {i} - NM - {i}.50 EUR - in stock" for i in range(15)),
    "cheap lantern price buy lantern cheap cheap price lantern sale buy lantern price sale lantern cheap buy buy sale price lantern " * 4,
    "\n".join(f"Lantern{i} ({i * 7})" for i in range(30)),
    "Price lantern now. Buy here! Lantern sale. Here now price lantern! Sale buy. Now lantern here. Price buy! " * 6,
    PROSE[0] + "\n" + "booster lantern sealed trade cards lantern booster best lantern cards sealed trade " * 12,
]


FOREIGN = [
    "Владелец этого фонаря берёт три карты, когда он покидает поле, и поэтому мы им играем. Он был хорош в каждой партии до сих пор! Никто не ожидал, что цапля сдержит девять нападающих.",
    "Никто не ожидал, что цапля сдержит девять нападающих.\nЭто случилось, и за столом стало тихо.\nМы до сих пор говорим об этом, когда магазин закрывается.",
    "Właściciel tej latarni dobiera trzy karty, gdy opuszcza ona pole, i dlatego nią gramy. Do tej pory była dobra w każdej partii! Nikt nie spodziewał się, że czapla powstrzyma dziewięciu napastników.",
    "这盏灯笼离开战场时，它的主人抓三张牌，所以我们才使用它。到目前为止它在每场比赛中都很好！没有人想到苍鹭能挡住九个攻击者。",
    "이 등불의 주인은 등불이 전장을 떠날 때 카드 세 장을 뽑으며, 그래서 우리는 그것을 사용한다. 지금까지 모든 경기에서 좋았다! 아무도 왜가리가 공격자를 막아낼 것이라고 예상하지 못했다.",
    "Bu fenerin sahibi, sahadan ayrıldığında üç kart çeker ve bu yüzden onu oynuyoruz. Kimse balıkçılın dokuz saldırganı durduracağını beklemiyordu.",
    "Ο ιδιοκτήτης αυτού του φαναριού τραβάει τρία φύλλα όταν φεύγει από το πεδίο, και γι' αυτό το παίζουμε. Κανείς δεν περίμενε ότι ο ερωδιός θα σταματούσε εννέα επιτιθέμενους.",
    "Tämän lyhdyn omistaja nostaa kolme korttia, kun se poistuu kentältä, ja siksi pelaamme sitä. Kukaan ei odottanut, että haikara pysäyttäisi yhdeksän hyökkääjää.",
]
FOREIGN_LISTS = ["фонарь, цапля, карты, магазин, цена, фольга, фонарь купить, цапля купить, дешево, набор, фольга, карты цена, магазин карты, фонарь цена, цапля фольга", "灯笼, 苍鹭, 卡牌, 商店, 价格, 闪卡, 灯笼购买, 苍鹭价格, 卡牌商店, 套装, 灯笼商店, 闪卡价格"]


def test_pages_in_languages_without_listed_words(spark):
    texts = PROSE * 12 + LISTS * 2 + FOREIGN + FOREIGN_LISTS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    flagged = {texts[r["doc_id"]] for r in pages.list_pages(df).collect()}
    assert flagged == {*LISTS, *FOREIGN_LISTS}


def test_pages(spark):
    texts = PROSE * 12 + LISTS * 2 + [None, "", "  \n ", "!!!", "word"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, prose string")
    flagged = {r["doc_id"] for r in pages.list_pages(df).collect()}
    lists = set(range(len(PROSE) * 12, len(PROSE) * 12 + len(LISTS) * 2))
    assert flagged == lists
    kinds = {r["doc_id"]: r for r in pages.page_kinds(df).collect()}
    assert len(kinds) == len(texts) and all(r["n_words"] == r["prose"] + r["link_list"] + r["tag_list"] + r["menu"] for r in kinds.values())
    assert kinds[len(texts) - 5]["n_words"] == 0 and kinds[len(PROSE) * 12 + 3]["link_list"] == kinds[len(PROSE) * 12 + 3]["n_words"]
    assert pages.list_pages(df.limit(0)).collect() == []


def test_model_is_fitted_on_all_pages(spark):
    few = PROSE + LISTS
    texts = [few[i * i % 97 % len(few)] for i in range(4500)] + [None, ""]
    got = pages.fit_model(pages.page_symbols(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)))
    encoded = {t: pages.encode(t)[0] for t in few}
    for a, b in zip(got, pages.fit([encoded[t] for t in texts if t]), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_a_very_long_page():
    model = pages.fit([])
    n, words_ = pages.shares("\n".join([PROSE[0]] * 3000), model)
    assert words_[pages.PROSE] == n > 80_000
    n, words_ = pages.shares("x" * 2_000_000 + " " + "cheap lantern " * 100_000, model)
    assert words_[pages.PROSE] < n / 2


def test_forward_backward_sums_over_paths():
    start, move, emit = pages.prior()
    symbols = np.array([0, 5, 40])
    other = np.array([7, 7, 7, 3, 100], np.int64)
    paths = {}
    for a in range(4):
        for b in range(4):
            for c in range(4):
                paths[a, b, c] = start[a] * emit[a, symbols[0]] * move[a, b] * emit[b, symbols[1]] * move[b, c] * emit[c, symbols[2]]
    total = sum(paths.values())
    # between pages that are longer and shorter
    alone = pages.posterior(other, np.array([5]), start, move, emit)
    state, moved = pages.posterior(np.concatenate([other, symbols, [9], other]), np.array([5, 3, 1, 5]), start, move, emit, np.array([0.0, 1.0, 3.0, 0.0]))
    assert state[:5] == pytest.approx(alone[0]) and state[9:] == pytest.approx(alone[0])
    state = state[5:8]
    for t in range(3):
        for k in range(4):
            assert state[t, k] == pytest.approx(sum(p for path, p in paths.items() if path[t] == k) / total)
    assert moved.sum() == pytest.approx(2) and moved[1, 2] == pytest.approx(sum(p * ((a, b) == (1, 2)) + p * ((b, c) == (1, 2)) for (a, b, c), p in paths.items()) / total)


def test_queries_of_the_package_run(spark, data):
    for name, query in llm.QUERIES.items():
        df = query(spark, data)
        assert df.count() > 0, name


def test_a_missing_dependency_is_an_error_of_its_own(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    assert {"p1_found", "p6_found", "p7_mix", "p8_found"} <= set(entry.queries())
    for name in [n for n in sys.modules if n.startswith("quillon.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(sys.modules["quillon"], "llm", raising=False)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    with pytest.raises(ImportError):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)
