"""A query in words."""

from __future__ import annotations

from quillon.plans.fields import COLOR, COLOR_WORDS, COLORS, DATE, FORMAT_LETTERS, LEGALITY, RARITIES, RARITY, RARITY_LETTERS, YEAR
from quillon.plans.query import And, Arith, Compare, Everything, NameHas, NameIs, Not, Nothing, Number, Or, Pattern, Ref, Text

_SAID = {":": "is", "=": "is", "!=": "is not", "<": "is less than", "<=": "is at most", ">": "is more than", ">=": "is at least"}
_COLOR_NAMES = dict(zip(COLORS + "c", ("white", "blue", "black", "red", "green", "colorless"), strict=True))


def _value(v) -> str:
    if isinstance(v, Number):
        return f"{v.value:g}"
    if isinstance(v, Ref):
        return v.field.said
    if isinstance(v, Arith):
        return f"{_value(v.left)} {v.op} {_value(v.right)}"
    return f"/{v.value}/" if isinstance(v, Pattern) else f'"{v.value}"'


def _compare(c: Compare) -> str:
    if not isinstance(c.left, Ref):
        return f"{_value(c.left)} {_SAID[c.op]} {_value(c.right)}"
    f, word = c.left.field, getattr(c.right, "value", None)
    if f.kind == COLOR and isinstance(c.right, Text):
        letters = COLOR_WORDS.get(word.lower(), word.lower())
        named = " and ".join(_COLOR_NAMES[x] for x in COLORS + "c" if x in letters) or word
        said = {":": "is within" if f.how == "identity" else "includes", "=": "is exactly", "!=": "is not exactly", ">=": "includes", "<=": "is within", ">": "includes more than", "<": "is within, without all of,"}
        return f"{f.said} {said[c.op]} {named}"
    if f.kind == COLOR:
        return f"the number of colors of {f.said} {_SAID[c.op]} {_value(c.right)}"
    if f.kind == RARITY:
        rank = RARITIES.get(word.lower(), RARITY_LETTERS.get(word.lower()))
        return f"{f.said} {_SAID[c.op]} {next((k for k, v in RARITIES.items() if v == rank), word)}"
    if f.kind == LEGALITY:
        status = c.left.alias if c.left.alias in ("banned", "restricted") else "legal"
        return f"it is {status} in {FORMAT_LETTERS.get(word.lower(), word.lower())}"
    if f.kind in (DATE, YEAR):
        said = {":": "is in", "=": "is in", "!=": "is not in", "<": "is before", "<=": "is in or before", ">": "is after", ">=": "is in or after"}
        return f"{f.said} {said[c.op]} {word}"
    if f.how in ("line", "name", "artist") and c.op in (":", "="):
        return f"{f.said} {'matches' if isinstance(c.right, Pattern) else 'contains'} {_value(c.right)}"
    return f"{f.said} {_SAID[c.op]} {_value(c.right)}"


def explain(tree, inner: bool = False) -> str:
    """What a tree asks for; empty for everything."""
    if isinstance(tree, Everything):
        return ""
    if isinstance(tree, Nothing):
        return "nothing"
    if isinstance(tree, And):
        return " and ".join(p for p in (explain(x, True) for x in tree.items) if p)
    if isinstance(tree, Or):
        joined = " or ".join(p for p in (explain(x, True) for x in tree.items) if p)
        return f"({joined})" if inner else joined
    if isinstance(tree, Not):
        return f"not ({explain(tree.item)})"
    if isinstance(tree, NameHas):
        return f'the name contains "{tree.text}"'
    if isinstance(tree, NameIs):
        return f'the name is "{tree.text}"'
    return _compare(tree)
