import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillon.functions.text import collate_text, fold_text, slug_text
from quillon.plans.compile import color_mask, cost_of, pattern_of
from quillon.plans.explain import explain
from quillon.plans.policy import parse_softly, soften, unbalanced
from quillon.plans.query import Pattern, QueryError, balance, date_window, parse, to_json, tokens
from quillon.plans.rewrite import DERIVED, gate, plain_text, rewrite, widens


def tree(q):
    return to_json(rewrite(parse(q)).tree)


@pytest.mark.parametrize(
    "a,b",
    [
        ("t:goblin c:r", "t:goblin and c:r"),
        ("(t:goblin c:r) cmc=1", "t:goblin c:r cmc:1"),
        ("is:tdfc", "layout:transform"),
        ("is:full", "is:fullart"),
        ("has:foil", "is:foil"),
        ("frame:old", "frame:1993 or frame:1997"),
        ("-is:firstprint", "-(-is:reprint)"),
        ("o:/abc/", 'o:"abc"'),
        (r"o:/a\.b/", 'o:"a.b"'),
        ("c:gold", "c>=2"),
        ("produces!=m", "produces=1"),
        ("name:“Gaea’s”", 'name:"Gaea\'s"'),
        ("a , b", "a b"),
    ],
)
def test_same_query(a, b):
    assert tree(a) == tree(b)


def test_or_binds_weaker_than_and():
    assert list(tree("a b or c d")) == ["or"]
    assert tree("a or b or c")["or"].__len__() == 3


def test_minus_is_negation_only_after_a_space():
    assert tree("power -cmc")["and"][1] == {"not": {"namehas": ["cmc", False]}}
    assert tree("power-cmc>1")["compare"][0]["arith"][0] == "-"
    assert tree("power - cmc > 1")["compare"][0]["arith"][0] == "-"


def test_numbers_and_text_share_a_field():
    assert tree("cn>5")["compare"][2] == 5
    assert tree("cn:5a")["compare"][2] == {"text": "5a", "quoted": False}


@pytest.mark.parametrize("q", ["(", ")", "()", "t:", "a or", "or a", "c:xyz", "year:1700", "date:2020-13", "date:2020-02-30", "-(cmc+1)", "!", '"open', "{w", "sort:", "r:"])
def test_unparsable(q):
    with pytest.raises(QueryError):
        parse(q)


@pytest.mark.parametrize("q", ["1", "cmc+1", "cmc-power", "cmc=(t:goblin)"])
def test_values_are_no_conditions(q):
    with pytest.raises(QueryError):
        rewrite(parse(q))


def test_directives_leave_the_tree():
    q = rewrite(parse("unique:art t:elf order:usd (order:cmc or c:g)"))
    assert [(d.name, d.value) for d in q.directives] == [("unique", "art"), ("order", "usd"), ("order", "cmc")]
    assert len(q.warnings) == 1 and to_json(q.tree) == tree("t:elf c:g")


def test_all_derived_terms_expand():
    for key in DERIVED:
        q = rewrite(parse(key))
        assert q.expanded == [key] and not q.warnings or key in ("has:watermark",) or q.expanded, key


def test_unknown_property_warns():
    assert rewrite(parse("is:nonsense")).warnings


def test_gate_adds_and_lifts():
    plain, asked = rewrite(parse("t:elf")), rewrite(parse("t:token"))
    assert "not" in str(to_json(gate(plain, plain.tree)))
    assert to_json(gate(asked, parse("t:token").tree)) == to_json(gate(asked, asked.tree))
    assert "extra" not in str(to_json(gate(asked, parse("t:token").tree)))
    assert gate(rewrite(parse("")), parse("").tree) == parse("").tree
    assert widens(rewrite(parse("lang:ja")).tree) and not widens(plain.tree)


def test_windows():
    assert date_window("2012") == (datetime.date(2012, 1, 1), datetime.date(2012, 12, 31))
    assert date_window("2012-02")[1] == datetime.date(2012, 2, 29)


@pytest.mark.parametrize("a,b", [("t:elf (c:g", "t:elf (c:g)"), ('o:"dra', 'o:"dra"'), ("urza's", "urza's"), ("(('a", "(('a'))")])
def test_balance(a, b):
    assert balance(a) == b
    if a != "(('a":
        parse(balance(a))


def test_balance_refuses_stray_closing():
    with pytest.raises(QueryError):
        balance("a)")


@given(st.text(alphabet="ab/\\.*+?()[]{}|^$ -", max_size=8))
def test_plain_patterns_mean_their_text(p):
    import re

    text = plain_text(p)
    if text is not None:
        assert re.fullmatch(p, text)


@given(st.text(max_size=30))
def test_any_text_parses_or_is_refused(q):
    try:
        explain(rewrite(parse(q)).tree)
    except QueryError:
        pass


def test_lexer_words():
    assert [t.text for t in tokens("40k urza's 2rr a.b 3.5")[:-1]] == ["40k", "urza's", "2rr", "a.b", "3.5"]


def test_text_functions():
    assert fold_text("Jötun Æther Łódź") == "Jotun AEther Lodz"
    assert collate_text("Lim-Dûl's Vault") == "limdulsvault"
    assert slug_text("  Card Draw: 2x!") == "card-draw-2x"


def test_values():
    assert color_mask("wubrg") == 31 and color_mask("azorius") == 3 and color_mask("c") == 32
    assert cost_of("{2}{R}{R/G}") == {"#": 2, "R": 1, "R/G": 1} and cost_of("2RR") == {"#": 2, "R": 2}
    for bad in ("(?=a)", r"(a)\1", "("):
        with pytest.raises(QueryError):
            pattern_of(Pattern(bad))


def test_explanation():
    assert explain(rewrite(parse("t:elf (c:g or cmc<3)")).tree) == 'the type contains "elf" and (the color includes green or the mana value is less than 3)'
    assert explain(rewrite(parse("r:mythic")).tree).endswith("mythic")


@pytest.mark.parametrize(
    "query,softened,warnings",
    [
        ("t:elf c:xyz", "t:elf", 1),
        ("f:nosuch or t:elf", "t:elf", 1),
        ("(c:xyz or lang:zz) t:elf", "t:elf", 2),
        ("t:elf (a or c:xyz)", "t:elf ( a )", 1),
        ("-(c:xyz) b", "b", 1),
        ("goblin cmc:", "goblin name:cmc", 0),
        ("x pow>=", 'x name:"pow>="', 0),
        ('o:"two words" -t:elf', 'o:"two words" -t:elf', 0),
        ("name:/a b/ oracle_id:12", "name:/a b/", 1),
    ],
)
def test_terms_that_cannot_be_honoured_go(query, softened, warnings):
    text, said = soften(query)
    assert " ".join(text.split()) == softened and len(said) == warnings
    parse(text)


def test_nothing_left_is_an_error():
    for q in ("c:xyz", "(t:elf", "t:elf)", "c:xyz or f:nosuch"):
        with pytest.raises(QueryError):
            soften(q)
    assert not unbalanced('o:"(" name:/\\(/') and unbalanced(")(")


@pytest.mark.parametrize("a,b", [("t>elf", "nothing"), ("-cmc>3", "everything"), ("-date>2010", "date>2010"), ("-c>=g", "-c>=g"), ("-r>rare", "-r>rare"), ("-t:elf", "-t:elf"), ("-cmc=3", "-cmc=3")])
def test_strict_comparisons(a, b):
    got = to_json(parse_softly(a).tree)
    assert got == {b: []} if b in ("nothing", "everything") else got == to_json(parse(b).tree)
