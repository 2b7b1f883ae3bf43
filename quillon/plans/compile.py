"""Trees as Column expressions over the prepared table.

NOT is the complement of a set: below it every leaf is total, false where SQL would leave it unknown.  Above it a filter
takes unknown for false anyway, so there the leaves stay bare comparisons, which reach the scan.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import collate_text, slug_text
from quillon.plans.fields import COLOR, COLOR_WORDS, COLORS, DATE, FORMAT_LETTERS, LEGALITY, MANA, NUMERIC, RARITIES, RARITY, RARITY_LETTERS, YEAR
from quillon.plans.query import And, Arith, Compare, Everything, NameHas, NameIs, Not, Nothing, Number, Or, Pattern, QueryError, Ref, Text, date_window

_OPS = {":": operator.eq, "=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_COLORLESS = 1 << len(COLORS)
_REFUSED = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<")
#: The key of generic mana in a cost; its count is the number in the symbol.
GENERIC = "#"


def color_mask(text: str) -> int:
    """Colours as bits, W lowest; C is a bit of its own."""
    word = text.strip().lower()
    letters = COLOR_WORDS.get(word, word)
    if not letters or not set(letters) <= set(COLORS + "c"):
        raise QueryError(f'Invalid color "{text}"')
    return sum(1 << (COLORS + "c").index(c) for c in set(letters))


def cost_of(text: str) -> Counter:
    """The symbols of a mana cost with their counts; bare letters and numbers are symbols too."""
    out: Counter = Counter()
    for braced, digits, letter in re.findall(r"\{([^}]*)\}|(\d+)|([A-Z])", text.upper()):
        symbol = (braced or digits or letter).strip()
        if symbol.isdigit():
            out[GENERIC] += int(symbol)
        elif symbol:
            out[symbol] += 1
    return out


def pattern_of(p: Pattern) -> str:
    """The pattern for ``rlike``: any letter case of any script, anywhere.

    Refuses what engines that work in linear time refuse, what this one does not know, and repetitions of repetitions,
    which it might not finish.
    """
    if _REFUSED.search(p.value):
        raise QueryError(f"Look-around and back-references are not supported: /{p.value}/")
    if _nested(p.value):
        raise QueryError(f"A repetition within a repetition is not supported: /{p.value}/")
    pattern = "(?iu)" + re.sub(r"\(\?P<", "(?<", p.value)
    context = SparkContext._active_spark_context
    try:
        if context is None:
            re.compile(p.value)
        else:
            context._jvm.java.util.regex.Pattern.compile(pattern)
    except (re.error, Py4JError, PySparkException) as e:
        raise QueryError(f"Invalid pattern /{p.value}/: {str(e).splitlines()[0]}") from None
    return pattern


def _nested(pattern: str) -> bool:
    """Whether a group that repeats something without an end is itself repeated without an end."""
    inside = [False]
    closed = False
    bare = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "x", pattern, flags=re.S)
    for i, c in enumerate(bare):
        endless = c in "*+" and (i == 0 or bare[i - 1] not in "*+") or c == "{" and re.match(r"\{\d+,\}", bare[i:]) is not None
        if endless and closed:
            return True
        if c == "(":
            inside.append(False)
        elif c == ")" and len(inside) > 1:
            closed = inside.pop()
            inside[-1] |= closed
            continue
        elif endless:
            inside[-1] = True
        closed = False
    return False


def _mask_test(m: Column, op: str, wanted: int) -> Column:
    """Colours by bits: ``>=`` holds all of them, ``<=`` no others."""
    both = m.bitwiseAND(F.lit(wanted))
    return {
        ">=": both == wanted,
        "<=": both == m,
        ">": (both == wanted) & (m != wanted),
        "<": (both == m) & (m != wanted),
        "=": m == wanted,
        "!=": m != wanted,
    }[op]


def _colors(c: Compare) -> Column:
    how, column = c.left.field.how, F.col(c.left.field.column)
    if isinstance(c.right, Number):
        test = lambda m: _OPS[c.op](F.bit_count(m), F.lit(c.right.value))
    else:
        wanted = color_mask(c.right.value)
        if how != "mask" and wanted != _COLORLESS:
            wanted &= _COLORLESS - 1
        op = c.op
        if how != "mask" and wanted == _COLORLESS:
            wanted, op = 0, "=" if op == ":" else op
        if op == ":":
            op = "<=" if how == "identity" else ">="
        test = lambda m: _mask_test(m, op, wanted)
    return F.exists(column, test) if how == "face_mask" else test(column)


def _cost(c: Compare) -> Column:
    costs = F.col(c.left.field.column)
    wanted = cost_of(c.right.value)
    if c.right.value.isdigit():
        pips = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda a, x: a + x)
        return F.exists(costs, lambda m: _OPS[">=" if c.op == ":" else c.op](pips(m), F.lit(int(c.right.value))))
    if not wanted:
        raise QueryError(f'Invalid mana cost "{c.right.value}"')
    own = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))
    count = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    holds = lambda m: reduce(operator.and_, (count(m, k) >= n for k, n in wanted.items()))
    within = lambda m: F.forall(F.map_entries(m), lambda e: e["value"] <= F.coalesce(F.try_element_at(own, e["key"]), F.lit(0)))
    tests = {
        ":": holds,
        ">=": holds,
        "<=": within,
        "=": lambda m: holds(m) & within(m),
        "!=": lambda m: ~(holds(m) & within(m)),
        ">": lambda m: holds(m) & ~within(m),
        "<": lambda m: within(m) & ~holds(m),
    }
    return F.exists(costs, tests[c.op])


def devotion_to(text: str) -> tuple[set[str], int]:
    """The colours of a devotion and how many of them; raises QueryError unless they are one colour or one pair."""
    wanted = cost_of(text)
    pairs = {frozenset(k.split("/")) for k in wanted}
    letters = set().union(*pairs)
    if len(pairs) != 1 or not letters or not letters <= set(COLORS.upper()) or len(letters) > 2:
        raise QueryError(f'Devotion is to one color or one pair: "{text}"')
    return letters, sum(wanted.values())


def _devotion(c: Compare) -> Column:
    letters, wanted = devotion_to(c.right.value)
    pips = F.size(F.filter(F.col(c.left.field.column), lambda s: reduce(operator.or_, (F.array_contains(F.split(s, "/"), F.lit(x)) for x in sorted(letters)))))
    return _OPS[">=" if c.op == ":" else c.op](pips, F.lit(wanted)) & F.col(c.left.field.column).isNotNull()


def _numbers(left, op: str, right) -> Column:
    """A comparison of sums; a field with several values holds if any combination of them does."""
    if isinstance(left, Ref) and left.field.how == "number" and isinstance(right, Number):
        return _OPS[op](F.col(left.field.column), F.lit(right.value))
    many: list[Ref] = []

    def collect(v):
        if isinstance(v, Ref) and v.field.how == "any_number":
            many.append(v)
        elif isinstance(v, Arith):
            collect(v.left)
            collect(v.right)

    collect(left)
    collect(right)

    def build(bound: list[Column]) -> Column:
        if len(bound) < len(many):
            return F.exists(F.col(many[len(bound)].field.column), lambda x: build([*bound, x]))
        values = iter(bound)

        def value(v) -> Column:
            if isinstance(v, Number):
                return F.lit(float(v.value))
            if isinstance(v, Ref):
                return next(values) if v.field.how == "any_number" else F.col(v.field.column).cast("double")
            a, b = value(v.left), value(v.right)
            return F.try_divide(a, b) if v.op == "/" else {"+": operator.add, "-": operator.sub, "*": operator.mul}[v.op](a, b)

        x = value(left)
        return _OPS[op](x, value(right))

    return build([])


def _date(c: Compare) -> Column:
    first, last = (F.lit(d) for d in date_window(c.right.value))
    day = F.col(c.left.field.column)
    return {":": day.between(first, last), "=": day.between(first, last), "!=": ~day.between(first, last), "<": day < first, "<=": day <= last, ">": day > last, ">=": day >= first}[c.op]


def _rarity(c: Compare) -> Column:
    word = c.right.value.lower()
    rank = RARITIES.get(word, RARITY_LETTERS.get(word))
    if rank is None:
        raise QueryError(f'Unknown rarity "{c.right.value}"')
    return _OPS[c.op](F.col(c.left.field.column), F.lit(rank))


def _legality(c: Compare) -> Column:
    word = c.right.value.lower()
    status = F.try_element_at(F.col(c.left.field.column), F.lit(FORMAT_LETTERS.get(word, word)))
    if c.op not in (":", "="):
        return F.lit(False)
    return status == c.left.alias if c.left.alias in ("banned", "restricted") else status.isin("legal", "restricted")


def name_has(text: str, quoted: bool) -> Column:
    """Names that contain a text: as written if quoted, else without regard to accents, case and punctuation."""
    return F.contains(F.col("name_lower"), F.lit(text.lower())) if quoted else F.contains(F.col("name_collated"), F.lit(collate_text(text)))


def _text(c: Compare, aliases: dict[str, str]) -> Column:
    how, column, value = c.left.field.how, F.col(c.left.field.column), c.right
    if c.op not in (":", "="):
        return F.lit(False)
    listed = how in ("member", "title_member", "slug", "artist")
    if isinstance(value, Pattern):
        p = pattern_of(value)
        return F.exists(column, lambda x: F.rlike(x, F.lit(p))) if listed else F.rlike(F.col("name_lower") if how == "name" else column, F.lit(p))
    word = value.value.lower()
    if how == "exact":
        return column == value.value
    if how == "name":
        return name_has(value.value, value.quoted)
    if how == "line":
        return F.contains(column, F.lit(word))
    if how == "slug":
        s = slug_text(word)
        return F.array_contains(column, F.lit(aliases.get(s, s)))
    if how == "artist":
        needle = collate_text(word)
        return F.exists(column, lambda x: F.contains(x, F.lit(needle)))
    if how == "lang" and word == "any":
        return F.lit(True)
    return F.array_contains(column, F.lit(word)) if listed else column == word


def leaf(x, aliases: dict[str, str]) -> Column:
    if isinstance(x, (Everything, Nothing)):
        return F.lit(isinstance(x, Everything))
    if isinstance(x, NameHas):
        return name_has(x.text, x.quoted)
    if isinstance(x, NameIs):
        return F.col("name_collated") == collate_text(x.text)
    if not isinstance(x, Compare):
        raise QueryError("This is no condition")
    kind = x.left.field.kind if isinstance(x.left, Ref) else NUMERIC
    if kind == NUMERIC:
        return _numbers(x.left, x.op, x.right)
    by_kind = {COLOR: _colors, DATE: _date, YEAR: _date, RARITY: _rarity, LEGALITY: _legality}
    if kind == MANA:
        return (_devotion if x.left.field.how == "devotion" else _cost)(x)
    return by_kind[kind](x) if kind in by_kind else _text(x, aliases)


def condition(tree, aliases: dict[str, str] | None = None, denied: bool = False) -> Column:
    """The filter of a rewritten tree, to be used as a filter: unknown is as good as false.

    ``aliases`` maps slugs of tags to the slugs they stand for; ``denied`` says that the tree stands below a NOT.
    """
    if isinstance(tree, And):
        return reduce(operator.and_, (condition(x, aliases, denied) for x in tree.items))
    if isinstance(tree, Or):
        return reduce(operator.or_, (condition(x, aliases, denied) for x in tree.items))
    if isinstance(tree, Not):
        return ~condition(tree.item, aliases, True)
    found = leaf(tree, aliases or {})
    return F.coalesce(found, F.lit(False)) if denied and not isinstance(tree, (Everything, Nothing)) else found
