"""The core's data operators against brute force, on dirty and degenerate input."""

import datetime
import json
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import json_tape
from quillon.functions.bitmap import Bitmap
from quillon.operators.flatten import _flatten, flat_tables, flatten_lines, part_links
from quillon.operators.hierarchy import ancestors, roots, segments, summary
from quillon.operators.key_totals import key_totals, large_keys
from quillon.operators.orphans import month_of, orphan_references
from quillon.plans.list_ranking import next_in_order, suffix_sums


def ts(text):
    return datetime.datetime.fromisoformat(text)


# --- bitmaps


@given(st.sets(st.integers(0, 200_000), max_size=60), st.sets(st.integers(0, 200_000), max_size=60), st.booleans())
@settings(max_examples=60, deadline=None)
def test_bitmaps_are_sets(a, b, dense):
    if dense:
        a, b = a | set(range(65_000, 72_000)), b | set(range(60_000, 70_000, 2))
    x, y = Bitmap.of(np.array(sorted(a), np.int64)), Bitmap.of(np.array(sorted(b), np.int64))
    for got, expected in ((x, a), (x | y, a | b), (x & y, a & b), (x.and_not(y), a - b)):
        assert got.decode().tolist() == sorted(expected) and len(got) == len(expected)


# --- totals per key


KEYS = "k string, id string, art string, t timestamp_ntz, first_t string"


def test_key_totals(spark):
    random.seed(4)
    keys = ["Hot "] * 300 + ["hot"] * 200 + [f"k{i % 40}" for i in range(200)] + [None, "  "]
    rows = [(k, random.choice([None, "", f"I{i % 90} ", f"i{i % 90}"]), random.choice([None, f"a{i % 7}"]), random.choice([None, ts(f"2024-01-{i % 28 + 1:02d}")]), "clash") for i, k in enumerate(keys)]
    got = {r["k"]: (r["n_ids"], r["n_art"], r["first_t"], r["last_t"]) for r in key_totals(spark.createDataFrame(rows, KEYS), "k", {"n_ids": "id", "n_art": "art"}, "t").collect()}
    by = defaultdict(lambda: (set(), set(), []))
    norm = lambda x: (x or "").strip().lower() or None
    for k, i, a, t, _ in rows:
        if norm(k):
            ids, arts, times = by[norm(k)]
            ids |= {norm(i)} - {None}
            arts |= {norm(a)} - {None}
            times += [t] if t else []
    assert got == {k: (len(i), len(a), min(t, default=None), max(t, default=None)) for k, (i, a, t) in by.items()}


def test_key_totals_of_nothing(spark):
    empty = spark.createDataFrame([], KEYS)
    assert key_totals(empty, "k", {"n": "id"}, "t").collect() == []
    assert large_keys(empty, "k", "id", "t", 1).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, KEYS)
    assert key_totals(nulls, "k", {"n": "id"}, "t").collect() == []


def test_large_keys_includes_the_exact_share(spark):
    rows = [("big", f"b{i}", None, None, None) for i in range(98)] + [("one", "x", None, None, None), ("two", "y", None, None, None)]
    assert {r["k"] for r in large_keys(spark.createDataFrame(rows, KEYS), "k", "id", "t", 1).collect()} == {"big", "one", "two"}
    rows += [("two", "z", None, None, None)]
    assert {r["k"] for r in large_keys(spark.createDataFrame(rows, KEYS), "k", "id", "t", 1).collect()} == {"big", "two"}


# --- orphans


def test_orphans_at_boundaries(spark):
    parents = spark.createDataFrame(
        [("A", ts("2024-02-01T00:00:00"), None), ("b ", ts("2024-02-10T00:00:00"), ts("2024-04-05T12:00:00")), ("c", ts("2024-03-05T00:00:00"), ts("2024-03-06T00:00:00")), ("c", ts("2024-03-05T00:00:00"), ts("2024-03-06T00:00:00")), ("d", None, None), ("e", ts("2024-03-02T00:00:00"), ts("2024-03-02T00:00:00")), ("f", ts("2024-02-01T00:00:00"), ts("2024-03-01T00:00:00")), (None, ts("2024-01-01T00:00:00"), None)],
        "key string, since timestamp_ntz, until timestamp_ntz",
    )
    cases = [  # row, key, time, orphan
        (1, "a", "2024-01-31T23:59:59.999999", True), (2, " A", "2024-02-01T00:00:00", False), (3, "a", "2029-01-01T00:00:00", False),
        (4, "b", "2024-02-09T23:59:59", True), (5, "b", "2024-02-10T00:00:00", False), (6, "b", "2024-03-15T00:00:00", False), (7, "b", "2024-04-05T12:00:00", True), (8, "b", "2024-04-05T11:59:59", False),
        (9, "c", "2024-03-05T10:00:00", False), (10, "c", "2024-03-06T00:00:00", True), (11, "c", "2024-03-04T00:00:00", True), (12, "d", "2024-03-04T00:00:00", True), (13, "e", "2024-03-02T00:00:00", True),
        (14, "f", "2024-02-29T23:59:59", False), (15, "f", "2024-03-01T00:00:00", True), (16, "zz", "2024-03-01T00:00:00", True), (17, " ", "2024-03-01T00:00:00", False), (18, None, "2024-03-01T00:00:00", False), (1, "a", "2024-01-31T23:59:59.999999", True),
    ]
    refs = spark.createDataFrame([(n, k, ts(t), "clash") for n, k, t, _ in cases] + [(99, "a", None, "clash")], "row bigint, ref string, at timestamp_ntz, since string")
    got = orphan_references(refs, "row", "ref", "at", parents, "key", "since", "until").select("row", month_of(None).alias("m")).collect()
    assert sorted(tuple(r) for r in got) == sorted((n, t[:7]) for n, _, t, orphan in cases if orphan)
    assert orphan_references(refs, "row", "ref", "at", parents.limit(0), "key", "since", "until").count() == 17
    assert orphan_references(refs.limit(0), "row", "ref", "at", parents, "key", "since", "until").count() == 0


def test_orphans_against_brute_force_with_hot_keys(spark):
    random.seed(9)
    day = lambda: ts("2024-01-01") + datetime.timedelta(hours=random.randrange(24 * 200))
    key = lambda: random.choice(["hot", "gone", f"k{random.randrange(60)}"])
    parents = []
    for _ in range(150):
        a = day()
        parents.append((random.choice(["hot", f"k{random.randrange(70)}"]), a, random.choice([None, a + datetime.timedelta(hours=random.randrange(1, 2000)), a + datetime.timedelta(hours=random.randrange(1, 20))])))
    refs = [(i, key(), day()) for i in range(6000)]
    expected = {i for i, k, t in refs if not any(p == k and a <= t and (u is None or u > t) for p, a, u in parents)}
    for heavy_rows in (100_000, 50):
        got = orphan_references(spark.createDataFrame(refs, "row bigint, ref string, at timestamp_ntz"), "row", "ref", "at", spark.createDataFrame(parents, "key string, since timestamp_ntz, until timestamp_ntz"), "key", "since", "until", heavy_rows)
        assert sorted(r["row"] for r in got.collect()) == sorted(expected) and 0 < len(expected) < 6000


# --- JSON


def _clean(v):
    return None if v is None or isinstance(v, (bool, dict, list)) else str(v).strip().lower() or None


def _id(v):
    from urllib.parse import urlsplit

    if _clean(v.get("id")):
        return _clean(v["id"])
    if isinstance(v.get("uri"), str):
        segments = [x for x in urlsplit(v["uri"]).path.split("/") if x.strip()]
        return _clean(segments[-1]) if segments else None


def links_by_recursion(rows):
    out = set()

    def walk(n, v, parts, faces, near):
        if isinstance(v, dict):
            own = _id(v)
            if own and parts:
                out.add((n, near, own))
            near = own if own and (parts or not faces) else near
            for k, x in v.items():
                walk(n, x, parts or k == "all_parts", faces or k == "card_faces", near)
        elif isinstance(v, list):
            for x in v:
                walk(n, x, parts, faces, near)
        elif isinstance(v, str) and parts:
            try:
                walk(n, json.loads(v), True, faces, near)
            except ValueError:
                pass

    for n, line in rows:
        try:
            walk(n, json.loads(line), False, False, None)
        except (ValueError, TypeError):
            pass
    return out


LINES = [
    '{"id":"R","all_parts":[{"id":"P1","component":"token"},{"id":null,"uri":"https://x.example/c/P2/?q=1#f"},{"id":" "},null,"see",[[{"id":"P3"}]]]}',
    '{"id":"R","card_faces":[{"id":"F","name":"x","all_parts":{"id":"P4","all_parts":[{"id":"P5"}]}}]}',
    '{"data":[{"id":"A","all_parts":{"0":{"id":7},"k":{"id":"P6"}}},{"id":"B","all_parts":"[{\\"id\\":\\"P7\\",\\"all_parts\\":\\"[{\\\\\\"id\\\\\\":\\\\\\"P8\\\\\\"}]\\"}]"}]}',
    '{"all_parts":[{"uri":"P9"}]}', '[{"id":"A","all_parts":[{"id":"X"}]},{"id":"B","all_parts":[{"id":"X"}]}]', '{"id":"R"} {"id":"S"}', '{"id":"R","all_parts":[{"id":"X"}]', "", "null", None, '"text"', '{"id":"R","all_parts":""}',
    '{"\\u0069d":"R","all\\u005fparts":[{"id":"\\u0058\\"\\\\"}]}', ' \t{"id" : "R" , "all_parts" : [ { "id" : "Y" } ] }\n',
]


def test_parts_against_recursion(spark):
    rows = list(enumerate(LINES)) + list(enumerate(LINES))
    df = spark.createDataFrame([(n, x, "clash") for n, x in rows], "line_no bigint, line string, id string")
    assert {tuple(r) for r in part_links(df).collect()} == links_by_recursion(rows)
    assert part_links(df.limit(0)).collect() == []


def test_parts_of_the_given_lines(spark, data):
    df = spark.read.parquet(f"{data}/bulk_lines.parquet")
    got = [tuple(r) for r in part_links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == links_by_recursion([(r["line_no"], r["line"]) for r in df.collect()])


def test_flat_tables_name_their_parents(spark):
    line = '{"id":"R","name":"n","oracle_id":"O","card_faces":[{"name":"f1","mana_cost":"{R}","all_parts":[{"id":"P","component":"token","type_line":"T","uri":5}]},{"name":"f2"}]}'
    flat = flat_tables(spark.createDataFrame([(1, line)], "line_no bigint, line string"))
    assert [(r["id"], r["parent_id"], r["oracle_id"]) for r in flat["record"].collect()] == [("r", None, "O")]
    assert [(r["name"], r["parent_id"], r["mana_cost"]) for r in flat["face"].orderBy("node_no").collect()] == [("f1", "r", "{R}"), ("f2", "r", None)]
    assert [(r["id"], r["parent_id"], r["component"], r["type_line"], r["uri"]) for r in flat["part"].collect()] == [("p", "r", "token", "T", "5")]


def test_parts_and_records_without_ids_are_rows(spark):
    held = json.dumps([{"name": "in text", "all_parts": [{"name": "below"}]}])
    lines = [
        '{"id":"R","all_parts":[{"component":"token","name":"no id","all_parts":[{"id":"P"}]},{},{"id":" ","name":"blank"},{"k":{"name":"in map"}}],"prices":{"usd":"1"}}',
        '{"name":"bare","all_parts":{"k":{"id":"Q"},"l":{"name":"no id"}}}', json.dumps({"id": "S", "all_parts": held}), '{"all_parts":{}}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    flat = flat_tables(df)
    number = {(r["line_no"], r["node_no"]): (r["id"], r["name"]) for k in ("record", "part") for r in flat[k].collect()}
    got = [(r["line_no"], r["id"], r["name"], r["parent_id"], number[r["line_no"], r["parent_node"]]) for r in flat["part"].orderBy("line_no", "node_no").collect()]
    assert got == [
        (0, None, "no id", "r", ("r", None)), (0, "p", None, "r", (None, "no id")), (0, None, None, "r", ("r", None)), (0, None, "blank", "r", ("r", None)), (0, None, "in map", "r", ("r", None)),
        (1, "q", None, None, (None, "bare")), (1, None, "no id", None, (None, "bare")), (2, None, "in text", "s", ("s", None)), (2, None, "below", "s", (None, "in text")),
    ]
    assert sorted((r["line_no"], r["id"]) for r in flat["record"].collect() if r["id"]) == [(0, "r"), (2, "s")]
    assert sorted((r["line_no"], r["name"]) for r in flat["record"].where("id is null").collect()) == [(1, "bare"), (3, None)] and len(number) == 13
    assert {tuple(r) for r in part_links(df).collect()} == links_by_recursion(list(enumerate(lines)))


def test_texts_within_texts_without_end_and_records_in_other_texts(spark):
    value = [{"id": "inner"}]
    for i in range(9):
        value = json.dumps(value)
    deep = json.dumps({"id": "R", "all_parts": value})
    note = json.dumps({"id": "S", "note": json.dumps({"id": "T", "oracle_id": "o", "notes": [json.dumps([{"id": "U", "all_parts": [{"id": "V"}]}])]}), "cost": "{2}{R}", "said": '"[x]"'})
    df = spark.createDataFrame([(1, deep), (2, note)], "line_no bigint, line string")
    assert sorted(tuple(r) for r in part_links(df).collect()) == [(1, "r", "inner"), (2, "u", "v")]
    got = {r["id"]: r["parent_id"] for r in flatten_lines(df).where("kind = 'record'").collect()}
    assert got == {"r": None, "s": None, "t": "s", "u": "t"}


def test_text_within_many_texts():
    """Quotes take twice as many backslashes in each layer, so the text itself bounds the layers; no number does."""
    text = '{"id":"P"}'
    for i in range(14):
        text = json.dumps({"id": f"L{i}", "all_parts": text}) if i % 2 else json.dumps([text])
    tables = _flatten(pa.array([json.dumps({"id": "R", "all_parts": text})]), pa.array([1]), ("part",), ())
    assert {i for t in tables for i in t["id"].to_pylist()} == {"p", *(f"l{i}" for i in range(1, 14, 2))}


def test_a_very_long_and_a_very_deep_line(spark):
    parts = ",".join(f'{{"id":"p{i}"}}' for i in range(20_000))
    deep = '{"id":"d","all_parts":[' * 300 + "]}" * 300
    df = spark.createDataFrame([(1, f'{{"id":"r","all_parts":[{parts}]}}'), (2, deep)], "line_no bigint, line string")
    assert flatten_lines(df).where("kind = 'part' and line_no = 1").count() == 20_000
    assert flatten_lines(df).where("kind = 'part' and line_no = 2").count() == 299


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8)


@given(st.lists(st.tuples(values, st.integers(0, 200), st.sampled_from(["", "{", "}", "[", "]", ",", ":", '"', "\\", " ", "1", "\n", "e"]), st.booleans()), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_tape_accepts_what_json_accepts(cases):
    def accepted(text):
        try:
            json.loads(text, parse_constant=lambda _: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    texts = []
    for v, at, new, swap in cases:
        text = json.dumps(v, ensure_ascii=False)
        at %= len(text) + 1
        texts.append(text[:at] + new + text[at + swap :])
    tape = json_tape.read(pa.array(texts))
    assert set(tape.row.tolist()) == {i for i, t in enumerate(texts) if accepted(t)}


# --- lists and hierarchies


def test_list_ranking_with_and_without_contraction(spark):
    random.seed(2)
    order = random.sample(range(500), 400)
    rows = [(a, b, 1, random.choice([-1, 1])) for a, b in zip(order, [*order[1:250], -1, *order[251:], -1], strict=True)]
    sums, length, delta = {}, 0, 0
    for e, after, _, d in reversed(rows):
        length, delta = (1, d) if after < 0 else (length + 1, delta + d)
        sums[e] = (length, delta)
    df = spark.createDataFrame(rows, "element bigint, after bigint, length bigint, delta bigint")
    for one_task in (1000, 60):
        assert {r["element"]: (r["length"], r["delta"]) for r in suffix_sums(df, one_task).collect()} == sums
    assert suffix_sums(df.limit(0)).collect() == []


def test_next_in_order(spark):
    rows = sorted((random.randrange(5), i) for i in range(100))
    got = {(r["a"], r["b"]): (r["next_a"], r["next_b"]) for r in next_in_order(spark.createDataFrame(rows, "a bigint, b bigint"), ["a", "b"]).collect()}
    assert got == dict(zip(rows, [*rows[1:], (None, None)], strict=True))


def test_running_total(spark):
    from quillon.plans.list_ranking import running_total

    rows = [(i * 3, i % 4 + 1) for i in range(200)] + [(None, 5)]
    got = {r["k"]: r["before"] for r in running_total(spark.createDataFrame(rows, "k bigint, n bigint").repartition(5), "k", "n", "before").collect()}
    expected, total = {}, 0
    for k, n in rows:
        expected[k], total = total, total + n
    assert got == expected
    assert running_total(spark.createDataFrame([], "k bigint, n bigint"), "k", "n", "before").collect() == []


def test_join_with_hot_keys(spark):
    from quillon.plans.skew import join_unique

    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 20}" if i % 2 else None, i) for i in range(900)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3), ("none", 4)], "k string, w int")
    expected = sorted(map(tuple, left.join(right, "k").collect()))
    for most in (10_000, 100, 1):
        assert sorted(map(tuple, join_unique(left, right, "k", 900, most).collect())) == expected
    assert join_unique(left.limit(0), right, "k", 900, 1).collect() == []


TAGS = "id string, parents array<string>, v int, steps string"


def ancestors_by_search(rows):
    norm = lambda s: (s or "").strip().lower() or None
    newest = {}
    for i, ps, v, _ in rows:
        if norm(i) and (norm(i) not in newest or newest[norm(i)][0] < v):
            newest[norm(i)] = (v, ps)
    up = {i: {norm(p) for p in ps or []} & set(newest) for i, (_, ps) in newest.items()}
    out = set()
    for i in up:
        seen, front, steps = {}, {i}, 0
        while front:
            steps += 1
            front = {p for x in front for p in up[x]} - set(seen)
            seen |= {p: steps for p in front}
        out |= {(i, a, s) for a, s in seen.items()}
    return out


def test_small_hierarchy(spark):
    rows = [
        ("root", None, 1, ""), ("A ", ["ROOT", "root", None, " ", "unknown"], 1, ""), ("b", ["a"], 2, ""), ("b", ["root"], 1, ""), ("c", ["a", "b"], 1, ""), ("self", ["self"], 1, ""),
        ("x", ["y"], 1, ""), ("y", ["z"], 1, ""), ("z", ["x"], 1, ""), ("tail", ["x"], 1, ""), ("two", ["x", "c"], 1, ""), (None, ["a"], 1, ""), (" ", ["a"], 1, ""), ("alone", [], 1, ""),
    ]
    df = spark.createDataFrame(rows, TAGS)
    assert sorted(tuple(r) for r in ancestors(df, "id", "parents", ["v"]).collect()) == sorted(ancestors_by_search(rows))
    info = {r["id"]: r for r in summary(df, "id", "parents", ["v"]).collect()}
    assert info["b"]["tree_path"] == ["root", "a", "b"] and info["b"]["depth"] == 2 and info["b"]["n_roots"] == 1
    assert info["root"]["n_descendants"] == 4 and info["root"]["depth"] == 0 and info["alone"]["n_ancestors"] == 0
    assert info["x"]["in_cycle"] and info["self"]["in_cycle"] and not info["tail"]["in_cycle"] and info["x"]["depth"] is None


@pytest.mark.parametrize("seed,back", [(1, False), (2, True)])
def test_random_hierarchies(spark, seed, back):
    random.seed(seed)
    n = 120
    rows = [(f"t{i}", [f"t{random.randrange(n if back else max(i, 1))}" for _ in range(random.choice([0, 1, 1, 1, 1, 2]))], 0, "") for i in range(n)]
    got = sorted(tuple(r) for r in ancestors(spark.createDataFrame(rows, TAGS), "id", "parents", ["v"], one_task=100).collect())
    assert got == sorted(ancestors_by_search(rows))


def links_of(rows):
    norm = lambda s: (s or "").strip().lower() or None
    ids = {norm(i) for i, *_ in rows}
    return {norm(i): sorted({norm(p) for p in ps or []} & ids) for i, ps, *_ in rows}


@pytest.mark.parametrize("seed,back", [(3, 0), (4, 8)])
def test_paths_and_roots_go_on_beyond_cuts(spark, seed, back):
    random.seed(seed)
    rows = [(f"t{i}", [f"t{random.randrange(max(i, 1))}" for _ in range(random.choice([1, 1, 1, 2, 3]))] if i > 3 else [], 0, "") for i in range(60)]
    rows += [(f"b{i}", [f"b{(i + 1) % back}"], 0, "") for i in range(back)] + [(f"c{i}", [f"b{i}", f"t{i + 9}"], 0, "") for i in range(back)] + [("low", ["b1"], 0, "")] * (back > 0)
    df, up = spark.createDataFrame(rows, TAGS), links_of(rows)
    info = {r["id"]: r for r in summary(df, "id", "parents", ["v"]).collect()}
    reach = ancestors_by_search(rows) | {(i, i, 0) for i in up if not up[i]}
    expected = {(i, a, s) for i, a, s in reach if not up[a] and (i != a or not s)}
    assert sorted(tuple(r) for r in roots(df, "id", "parents", ["v"]).collect()) == sorted(expected)
    depth = {i: min((s for j, _, s in expected if j == i), default=None) for i in up}

    def path(i):
        if depth[i] is None:
            return None
        return [*path(min(p for p in up[i] if depth[p] == depth[i] - 1)), i] if up[i] else [i]

    assert {i: r["path"] for i, r in info.items()} == {i: path(i) for i in up}
    assert any(r["path"] and r["path"] != r["tree_path"] for r in info.values())

    beyond = defaultdict(list)
    for r in segments(df, "id", "parents", ["v"]).collect():
        assert r["parent_path"] == info[r["parent_id"]]["tree_path"]
        beyond[r["id"]].append(r["parent_path"])

    def spelled(p):
        over = [q for q in beyond[p[0]] if not set(q) & set(p)]
        return [x for q in over for x in spelled([*q, *p])] if beyond[p[0]] else [tuple(p)]

    def walked(p):
        return [x for q in up[p[0]] if q not in p for x in walked([q, *p])] if up[p[0]] else [tuple(p)]

    for i in random.sample(sorted(up), 25):
        assert sorted(spelled(info[i]["tree_path"])) == sorted(walked([i]))


def test_a_star_and_a_chain(spark):
    rows = [("hub", [], 0, "")] + [(f"s{i}", ["hub"], 0, "") for i in range(400)] + [(f"c{i}", [f"c{i - 1}"] if i else [], 0, "") for i in range(80)]
    df = spark.createDataFrame(rows, TAGS)
    got = ancestors(df, "id", "parents", ["v"])
    assert got.count() == 400 + 80 * 79 // 2 and got.agg(F.max("steps")).first()[0] == 79


def test_no_hierarchy(spark):
    assert ancestors(spark.createDataFrame([], TAGS), "id", "parents", ["v"]).collect() == []
    assert ancestors(spark.createDataFrame([(None, None, None, None)], TAGS), "id", "parents", ["v"]).collect() == []
