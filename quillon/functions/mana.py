"""Mana costs: put in order and valued."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillon.plans.fields import COLORS
from quillon.plans.query import QueryError

_SYMBOL = re.compile(r"\{([^{}]*)\}|([0-9]+)|([A-Za-z½∞])")
_HALF = r"(?:[0-9]+|[WUBRGP])"
_KNOWN = re.compile(rf"[0-9]+|[XYZWUBRGCS]|{_HALF}/{_HALF}|H[WUBRG]")
_WHEEL = COLORS.upper()


@dataclass(frozen=True)
class Cost:
    """A cost in canonical form: its text, colours in order, value, and whether it has none, one or several colours."""

    cost: str
    colors: tuple[str, ...]
    cmc: float
    colorless: bool
    monocolored: bool
    multicolored: bool


def _value(symbol: str) -> float:
    """What a symbol adds to the cost's value: a two-part one its dearer part, half a symbol half, a variable nothing."""
    if symbol in ("X", "Y", "Z"):
        return 0.0
    if symbol.startswith("H"):
        return 0.5
    return max(float(p) if p.isdigit() else 1.0 for p in symbol.split("/"))


def wheel_order(colors: set[str]) -> tuple[str, ...]:
    """Colours as costs name them: neighbours round the wheel in its direction, others by every second place."""
    for step in (1, 2):
        for start in range(len(_WHEEL)):
            walk = tuple(_WHEEL[(start + i * step) % len(_WHEEL)] for i in range(len(colors)))
            if set(walk) == colors:
                return walk
    return tuple(c for c in _WHEEL if c in colors)


def _colors(symbol: str) -> set[str]:
    return {c for c in symbol.removeprefix("H").split("/") if c in _WHEEL}


def parse_cost(text: str) -> Cost:
    """A cost from braces, digits and letters in any order; raises QueryError for what is no symbol.

    Variables come first, then the sum of generic mana, then symbols of colours by the order of the cost's colours, then
    colourless ones; nothing at all costs zero.
    """
    left = re.sub(r"\s+", "", text)
    found = [(braced or plain or letter).upper() for braced, plain, letter in _SYMBOL.findall(left)]
    unknown = [s for s in found if not _KNOWN.fullmatch(s)] or ([_SYMBOL.sub("", left)] if _SYMBOL.sub("", left) else [])
    if unknown:
        raise QueryError(f'"{unknown[0]}" is no mana symbol')
    order = wheel_order(set().union(*map(_colors, found))) if found else ()
    generic = sum(int(s) for s in found if s.isdigit())
    variables = sorted(s for s in found if s in ("X", "Y", "Z"))
    colored = sorted((s for s in found if _colors(s)), key=lambda s: min(map(order.index, _colors(s))))
    others = [s for s in found if not s.isdigit() and s not in ("X", "Y", "Z") and not _colors(s)]
    parts = [*variables, *([str(generic)] if generic else []), *colored, *others] or ["0"]
    return Cost("".join(f"{{{s}}}" for s in parts), order, sum(map(_value, found)), not order, len(order) == 1, len(order) > 1)
