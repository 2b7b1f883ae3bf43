"""From a query string to a tree: lexer, nodes, parser."""

from __future__ import annotations

import calendar
import datetime
import re
from dataclasses import dataclass, field

from quillon.plans.fields import BY_ALIAS, COLOR, COLOR_WORDS, DATE, DIRECTIVES, Field, LEGALITY, MANA, MANY_COLORS, NUMBER_TWIN, NUMERIC, RARITY, TEXT, YEAR, YEARS


class QueryError(ValueError):
    """A query that cannot be answered; the message is for its author."""


# --- nodes ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Everything:
    pass


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Number:
    value: int | float


@dataclass(frozen=True)
class Text:
    value: str
    quoted: bool = False


@dataclass(frozen=True)
class Pattern:
    value: str


@dataclass(frozen=True)
class Ref:
    field: Field
    alias: str


@dataclass(frozen=True)
class Arith:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Compare:
    left: object
    op: str
    right: object


@dataclass(frozen=True)
class NameHas:
    text: str
    quoted: bool = False


@dataclass(frozen=True)
class NameIs:
    text: str


@dataclass(frozen=True)
class Directive:
    name: str
    value: str


@dataclass
class Query:
    """A parsed query: its filter, directives in order, warnings, and the terms that rewriting replaced."""

    tree: object
    directives: list[Directive] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    expanded: list[str] = field(default_factory=list)


# --- lexer ---------------------------------------------------------------------------------------------------------

_QUOTES = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"'})
_LETTER = r"[^\W\d_]"
_IN_WORD = rf"(?:{_LETTER}|[0-9_.])"
_LEX = re.compile(
    rf"""(?P<skip>[ \t\r\n,]+)
    |(?P<mana>\{{[^}}]*\}})
    |"(?P<dq>(?:\\.|[^"\\])*)"|'(?P<sq>(?:\\.|[^'\\])*)'
    |(?P<op>>=|<=|!=|[:=<>])
    |/(?P<regex>(?:\\.|[^/\\])*)/
    |(?P<number>\d+(?:\.\d+)?(?!{_IN_WORD}))
    |(?P<word>(?:{_LETTER}|_|\d+(?={_IN_WORD}))(?:{_IN_WORD}|,|'(?={_IN_WORD}|\Z))*)
    |(?P<sign>[-+*/()!])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    spaced: bool


END = Token("end", "", True)


def tokens(source: str) -> list[Token]:
    """The tokens of a query, ``end`` last."""
    out, at, spaced = [], 0, False
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise QueryError(f'Failed to lex query: "{source}"')
        at, kind = m.end(), m.lastgroup
        if kind == "skip":
            spaced = True
            continue
        text = m.group(kind)
        if kind in ("dq", "sq"):
            kind, text = "quoted", re.sub(r"\\(.)", r"\1", text, flags=re.S)
        elif kind == "regex":
            text = text.replace("\\/", "/")
        elif kind == "sign":
            kind = text
        out.append(Token(kind, text, spaced))
        spaced = False
    return [*out, END]


# --- parser: operators climb by their power, values are read by rules of their field's kind ---------------------------

#: How strongly operators bind; those of sums all alike, so sums go from left to right.
OR, AND, NOT, COMPARE, SUM = 10, 20, 30, 40, 50


class _Wrong(Exception):
    pass


@dataclass(frozen=True)
class _Number(Ref):
    """A numeric field as written: an operand, or a name if nothing is done with it."""

    word: str


@dataclass(frozen=True)
class _Group:
    """What stood in parentheses."""

    inner: object


def _operand(node):
    """A node as part of a sum or comparison."""
    if isinstance(node, _Group):
        return node.inner
    return Ref(node.field, node.alias) if isinstance(node, _Number) else node


def _condition(node):
    """A node as a condition."""
    if isinstance(node, _Group):
        return node.inner
    return NameHas(node.word) if isinstance(node, _Number) else node


def _digits(text: str) -> int | float:
    return float(text) if "." in text else int(text)


# The values of fields that hold no numbers: which tokens may begin one, which may be attached to it, what it becomes.


def _text(first: Token, text: str):
    return Pattern(text) if first.kind == "regex" else Text(text, first.kind == "quoted")


def _color(first: Token, text: str):
    if first.kind == "number":
        if "." in text:
            raise _Wrong
        return Number(int(text))
    low = text.lower()
    if first.kind == "word" and low not in COLOR_WORDS and low not in MANY_COLORS and not set(low) <= set("wubrgc"):
        raise _Wrong
    return Text(text)


def _date(_: Token, text: str):
    parts = [int(float(x)) for x in text.split("-")] if re.fullmatch(r"\d+(?:-\d+(?:\.\d+)?){0,2}", text) else [0]
    try:
        datetime.date(*parts, *[1] * (3 - len(parts)))
    except ValueError as e:
        raise _Wrong from e
    if not YEARS[0] <= parts[0] <= YEARS[1]:
        raise _Wrong
    return Text("-".join(f"{p:02d}" for p in parts))


_WORDS = frozenset({"word", "number", "*", "-"})
_RULES = {
    TEXT: ({"quoted", "regex", "word", "number", "*"}, _WORDS, _text),
    RARITY: ({"quoted", "word"}, frozenset(), _text),
    LEGALITY: ({"quoted", "word"}, frozenset(), _text),
    MANA: ({"quoted", "mana", "word", "number"}, frozenset({"mana", "word", "number"}), lambda _, text: Text(text.upper())),
    COLOR: ({"quoted", "word", "number"}, frozenset({"-"}), _color),
    DATE: ({"number"}, frozenset({"-"}), _date),
    YEAR: ({"number"}, frozenset(), _date),
}


class _Reader:
    """Tokens read from left to right."""

    def __init__(self, found: list[Token]) -> None:
        self.found, self.at = found, 0

    def next(self, ahead: int = 0) -> Token:
        return self.found[min(self.at + ahead, len(self.found) - 1)]

    def take(self, *kinds: str) -> Token:
        token = self.next()
        if kinds and token.kind not in kinds:
            raise _Wrong
        self.at += 1
        return token

    def attached(self, text: str, kinds: frozenset[str]) -> str:
        """A text with the tokens of these kinds that follow it without a blank; a hyphen only with a word or number."""
        while not (token := self.next()).spaced and token.kind in kinds:
            if token.kind == "-":
                after = self.next(1)
                if after.spaced or after.kind not in ("word", "number"):
                    break
                self.at += 1
                text += "-"
            text += self.take().text
        return text

    def value(self, kind: str):
        """The value of a field of this kind."""
        begins, attaches, become = _RULES[kind]
        first = self.take(*begins)
        text, back = first.text, self.at
        if first.kind not in ("quoted", "regex"):
            text = self.attached(text, attaches)
        if kind == COLOR and self.at > back and text.lower() not in COLOR_WORDS:
            self.at, text = back, first.text
        return become(first, text)

    def numeric(self, token: Token) -> bool:
        """Whether a token can begin an operand of a sum."""
        return token.kind in ("number", "(") or token.kind == "word" and getattr(BY_ALIAS.get(token.text.lower()), "kind", None) == NUMERIC

    def number(self):
        """What stands on the right of a comparison of numbers: a sum, whose first number may have a sign."""
        if self.next().kind == "-" and self.next(1).kind == "number":
            self.take()
            return _operand(self.climb(Number(-_digits(self.take().text)), COMPARE + 1))
        if not self.numeric(self.next()):
            raise _Wrong
        return _operand(self.climb(self.single(), COMPARE + 1))

    def power(self, left) -> int:
        """How strongly what comes next binds to ``left``; 0 if it does not."""
        token, after = self.next(), self.next(1)
        number = isinstance(left, (_Number, _Group, Number, Arith))
        if number and token.kind in ("+", "-", "*", "/") and self.numeric(after) and not (token.kind == "-" and token.spaced and not after.spaced):
            return SUM
        if token.kind == "op":
            if not number:
                raise _Wrong
            return COMPARE
        if token.kind == "word":
            return OR if token.text.lower() == "or" else AND
        return AND if token.kind in ("number", "quoted", "regex", "mana", "(", "!") or token.kind == "-" and token.spaced else 0

    def climb(self, left, least: int):
        """``left`` with all that binds to it at least so strongly."""
        while (power := self.power(left)) >= max(least, 1):
            if power == AND:
                if self.next().text.lower() == "and" and self.next().kind == "word":
                    self.take()
                left = And((_condition(left), _condition(self.tree(AND + 1))))
                continue
            operator = self.take()
            if power == OR:
                left = Or((_condition(left), _condition(self.tree(OR + 1))))
            elif power == SUM:
                left = Arith(operator.kind, _operand(left), _operand(self.single()))
            else:
                left = _operand(left)
                if not isinstance(left, (Ref, Number, Arith)):
                    raise _Wrong
                left = Compare(left, operator.text, self.number())
        return left

    def tree(self, least: int = OR):
        return self.climb(self.single(), least)

    def single(self):
        """One operand or term, with nothing bound to it yet."""
        token = self.take()
        read = _SINGLE.get(token.kind)
        if read is None:
            raise _Wrong
        return read(self, token)

    def group(self, _: Token):
        inner = _condition(self.tree())
        self.take(")")
        return _Group(inner)

    def denied(self, _: Token):
        if self.next().kind == "-":
            raise _Wrong
        item = _condition(self.tree(NOT))
        if isinstance(item, Arith):
            raise _Wrong
        return Not(item)

    def word(self, token: Token):
        low, asks = token.text.lower(), self.next().kind == "op"
        if low in ("and", "or"):
            raise _Wrong
        if low in DIRECTIVES and asks and self.next().text == ":":
            self.take()
            value = self.take("word", "quoted", "number")
            return Directive(low, (value.text if value.kind == "quoted" else self.attached(value.text, frozenset("-"))).lower())
        found = BY_ALIAS.get(low)
        if found is not None and found.kind == NUMERIC:
            return _Number(found, low, token.text)
        if found is None or not asks:
            return NameHas(self.attached(token.text, _WORDS))
        operator = self.take().text
        if low in NUMBER_TWIN and (self.next().kind == "number" or self.next().kind == "-" and self.next(1).kind == "number"):
            return Compare(Ref(NUMBER_TWIN[low], low), operator, self.number())
        return Compare(Ref(found, low), operator, self.value(found.kind))


_SINGLE = {
    "(": _Reader.group,
    "-": _Reader.denied,
    "!": lambda reader, _: NameIs(reader.take("word", "quoted").text),
    "quoted": lambda _, token: NameHas(token.text, True),
    "mana": lambda _, token: NameHas(token.text),
    "number": lambda _, token: Number(_digits(token.text)),
    "*": lambda reader, _: NameHas(reader.attached("*", _WORDS)),
    "word": _Reader.word,
}


def date_window(value: str) -> tuple[datetime.date, datetime.date]:
    """First and last day that a year, month or day names."""
    parts = [int(x) for x in value.split("-")]
    year, month = parts[0], parts[1] if len(parts) > 1 else None
    if len(parts) == 3:
        day = datetime.date(*parts)
        return day, day
    if month:
        return datetime.date(year, month, 1), datetime.date(year, month, calendar.monthrange(year, month)[1])
    return datetime.date(year, 1, 1), datetime.date(year, 12, 31)


def flat(node):
    """And within And, Or within Or, made one."""
    if isinstance(node, (And, Or)):
        kind, items = type(node), []
        for x in map(flat, node.items):
            items += x.items if isinstance(x, kind) else (x,)
        return kind(tuple(items))
    return Not(flat(node.item)) if isinstance(node, Not) else node


def parse(source: str | None) -> Query:
    """The query; an empty one matches everything.  Raises QueryError."""
    if not source or not source.strip():
        return Query(Everything())
    source = source.translate(_QUOTES)
    found = tokens(source)
    try:
        reader = _Reader(found)
        tree = Everything() if reader.next().kind == "end" else _condition(reader.tree())
        reader.take("end")
        return Query(flat(tree))
    except _Wrong:
        raise QueryError(f'Failed to parse query: "{source}"') from None


def balance(source: str) -> str:
    """A half-typed query closed so that it can be parsed: open quotes and parentheses get their ends.

    An apostrophe within a word opens nothing; a closing parenthesis without an opening one is an error.
    """
    depth, quote, at = 0, "", 0
    source = source.translate(_QUOTES)
    while at < len(source):
        c = source[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c == '"' or c == "'" and not (at and re.match(r"[\w.]", source[at - 1])):
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise QueryError("Unbalanced closing parenthesis")
        at += 1
    return source + quote + ")" * depth


def to_json(node) -> dict | list | str | int | float | None:
    """A tree in plain values, for comparing and storing queries."""
    if isinstance(node, (And, Or)):
        return {type(node).__name__.lower(): [to_json(x) for x in node.items]}
    if isinstance(node, Not):
        return {"not": to_json(node.item)}
    if isinstance(node, Compare):
        return {"compare": [to_json(node.left), "=" if node.op == ":" else node.op, to_json(node.right)]}
    if isinstance(node, Arith):
        return {"arith": [node.op, to_json(node.left), to_json(node.right)]}
    if isinstance(node, Ref):
        return {"field": node.alias}
    if isinstance(node, Number):
        return node.value
    if isinstance(node, Text):
        return {"text": node.value, "quoted": node.quoted}
    return {type(node).__name__.lower(): list(vars(node).values())}
