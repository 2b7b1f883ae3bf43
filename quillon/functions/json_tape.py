"""JSON texts of a whole Arrow string column as flat node arrays.

Nothing is parsed row by row.  Quotes, escapes, brackets and separators are found over the column's byte buffer with
numpy; the enclosing container of every token comes from its depth and a search among the opening brackets one level
up; the grammar is checked on pairs of neighbouring tokens.  The result lists every JSON value as a node with its row,
its parent node, its key and its byte range.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE, _OTHER, _TEXT = 1, 0, 9
_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COLON, _COMMA, _STRING, _SCALAR = 2, 3, 4, 5, 6, 7, 8, 0
_CLASS = np.zeros(256, np.uint8)
for _c, _k in ((b" \t\n\r", _SPACE), (b"{", _OPEN_O), (b"}", _CLOSE_O), (b"[", _OPEN_A), (b"]", _CLOSE_A), (b":", _COLON), (b",", _COMMA)):
    _CLASS[list(_c)] = _k
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_LITERAL = re.compile(r"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\Z")

OBJECT, ARRAY, STRING, SCALAR = _OPEN_O, _OPEN_A, _STRING, _SCALAR


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The strings at byte ranges of ``data``."""
    length = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    take = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[take])))


def unescape(raw: pa.StringArray) -> pa.Array:
    """The values of JSON string bodies; only different bodies with a backslash are decoded one by one."""
    escaped = pc.match_substring(raw, "\\")
    if not pc.any(escaped).as_py():
        return raw
    encoded = raw.dictionary_encode()
    words = [json.loads(f'"{w}"', strict=False).encode("utf-8", "replace").decode() if "\\" in w else w for w in encoded.dictionary.to_pylist()]
    return pa.array(words, pa.string()).take(encoded.indices)


@dataclass
class Tape:
    """Nodes in document order; ``parent`` is -1 for a row's own value, ``key`` an index into ``keys`` or -1."""

    data: np.ndarray
    row: np.ndarray
    kind: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    key: np.ndarray
    keys: list[str]
    start: np.ndarray
    end: np.ndarray

    def key_code(self, name: str) -> int:
        return self.keys.index(name) if name in self.keys else -2

    def text(self, nodes: np.ndarray) -> pa.Array:
        """The strings, or the source text of numbers; null for other nodes, JSON null, and -1."""
        ok = nodes >= 0
        n = np.where(ok, nodes, 0)
        if not len(self.kind):
            return pa.nulls(len(nodes), pa.string())
        string = ok & (self.kind[n] == STRING)
        first = self.data[self.start[n]]
        number = ok & (self.kind[n] == SCALAR) & ((first == ord("-")) | ((first >= ord("0")) & (first <= ord("9"))))
        have = string | number
        shift = string.astype(np.int64)[have]
        raw = slices(self.data, self.start[n[have]] + shift, self.end[n[have]] - shift)
        index = np.cumsum(have) - 1
        return unescape(raw).take(pa.array(index, mask=~have))

    def inherit(self, own: np.ndarray) -> np.ndarray:
        """True at the nodes for which ``own`` is true and everything below them."""
        out = own.copy()
        for nodes in self.by_level()[1:]:
            out[nodes] |= out[self.parent[nodes]]
        return out

    def nearest(self, chosen: np.ndarray) -> np.ndarray:
        """For each node the closest node above it that is chosen, or -1."""
        out = np.full(len(chosen), -1)
        for nodes in self.by_level()[1:]:
            up = self.parent[nodes]
            out[nodes] = np.where(chosen[up], up, out[up])
        return out

    def by_level(self) -> list[np.ndarray]:
        order = np.argsort(self.level, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.level[order])) + 1) if len(order) else []

    def child(self, key: str) -> np.ndarray:
        """For each node its member of that name (the last one), or -1."""
        out = np.full(len(self.kind), -1)
        members = np.flatnonzero(self.key == self.key_code(key))
        out[self.parent[members]] = members
        return out


def read(texts: pa.Array) -> Tape:
    """The nodes of the texts that are one complete JSON value each; other texts, and nulls, have no nodes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ended = pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, body = ended.buffers()
    bounds = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if len(ended) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    first, n = bounds[:-1], len(ended)
    bad = np.zeros(n, bool)
    row_at = lambda position: np.searchsorted(bounds, position, "right") - 1

    # quotes that open and close strings, and escapes
    slash = np.flatnonzero(data == ord("\\"))
    run = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
    in_run = slash - np.repeat(slash[run], np.diff(np.append(run, len(slash))))
    starters = slash[in_run % 2 == 0]
    escaped = np.zeros(len(data) + 6, bool)
    escaped[starters + 1] = True
    quotes = np.flatnonzero((data == ord('"')) & ~escaped[: len(data)])
    per_row = np.bincount(row_at(quotes), minlength=n)
    bad |= per_row % 2 == 1
    quotes = quotes[~bad[row_at(quotes)]]
    opening, closing = quotes[::2], quotes[1::2]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[opening] += 1
    edge[closing + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    padded = np.concatenate([data, np.zeros(6, np.uint8)])
    after = padded[starters + 1]
    wrong = ~_ESCAPES[after] | ((after == ord("u")) & ~(_HEX[padded[starters + 2]] & _HEX[padded[starters + 3]] & _HEX[padded[starters + 4]] & _HEX[padded[starters + 5]]))
    bad[row_at(starters[wrong])] = True
    bad[row_at(np.flatnonzero(inside & (data < 32)))] = True

    # tokens
    cls = _CLASS[data]
    cls[inside] = _TEXT
    cls[opening] = _STRING
    scalar = cls == _OTHER
    starts_scalar = scalar & ~np.concatenate([[False], scalar[:-1]])
    at = np.flatnonzero(starts_scalar | ((cls >= _OPEN_O) & (cls <= _STRING)))
    kind, row = cls[at], row_at(at)
    end = at + 1
    string_end = np.zeros(len(data), np.int64) if len(opening) else np.zeros(0, np.int64)
    if len(opening):
        string_end[opening] = closing + 1
        end = np.where(kind == _STRING, string_end[at], end)
    breaks = np.flatnonzero(~scalar)
    end = np.where(kind == _SCALAR, breaks[np.minimum(np.searchsorted(breaks, at), max(len(breaks) - 1, 0))] if len(breaks) else end, end)

    # literals, each different one once
    literal = np.flatnonzero(kind == _SCALAR)
    encoded = slices(data, at[literal], end[literal]).dictionary_encode()
    fine = np.array([bool(_LITERAL.match(w)) for w in encoded.dictionary.to_pylist()], bool)
    bad[row[literal[~fine[encoded.indices.to_numpy(zero_copy_only=False)]]]] = True

    # depth; rows whose brackets do not balance go
    opens, closes = (kind == _OPEN_O) | (kind == _OPEN_A), (kind == _CLOSE_O) | (kind == _CLOSE_A)
    step = opens.astype(np.int64) - closes
    total = np.cumsum(step)
    before_row = np.concatenate([[0], total])[np.searchsorted(row, np.arange(n))] if len(at) else np.zeros(n, np.int64)
    depth = total - before_row[row]
    bad[row[depth < 0]] = True
    bad[np.bincount(row, weights=step, minlength=n) != 0] = True
    keep = ~bad[row]
    at, kind, row, end, opens, closes, depth = (x[keep] for x in (at, kind, row, end, opens, closes, depth))
    level = depth - opens
    m = len(at)

    # enclosing container, and the opening bracket of each closing one
    container, opener = np.full(m, -1), np.full(m, -1)
    order = np.argsort(level, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if m else []
    above = np.zeros(0, np.int64)
    for tokens in groups:
        if len(above):
            container[tokens] = above[np.searchsorted(above, tokens) - 1]
        above = tokens[opens[tokens]]
        shut = tokens[closes[tokens]]
        if len(shut):
            opener[shut] = above[np.searchsorted(above, shut) - 1]

    # grammar on neighbouring tokens
    new_row = np.concatenate([[True], row[1:] != row[:-1]]) if m else np.zeros(0, bool)
    prev = np.where(new_row, 255, np.concatenate([[0], kind[:-1]])) if m else np.zeros(0, np.int64)
    top = container < 0
    holder = np.where(top, 0, kind[np.maximum(container, 0)]) if m else np.zeros(0, np.int64)
    in_object, in_array = holder == _OPEN_O, holder == _OPEN_A
    is_key = (kind == _STRING) & in_object & ((prev == _OPEN_O) | (prev == _COMMA))
    value = (opens | (kind == _SCALAR) | (kind == _STRING)) & ~is_key
    prev_key = np.concatenate([[False], is_key[:-1]]) & ~new_row if m else new_row
    prev_value = ((prev == _SCALAR) | (prev == _STRING) | (prev == _CLOSE_O) | (prev == _CLOSE_A)) & ~prev_key
    ok = np.where(value, (top & new_row) | (in_array & ((prev == _OPEN_A) | (prev == _COMMA))) | (in_object & (prev == _COLON)), is_key)
    ok = np.where(kind == _COLON, in_object & prev_key, ok)
    ok = np.where(kind == _COMMA, ~top & prev_value, ok)
    pair = kind[np.maximum(opener, 0)] if m else kind
    ok = np.where(kind == _CLOSE_O, (pair == _OPEN_O) & ((prev == _OPEN_O) | prev_value), ok)
    ok = np.where(kind == _CLOSE_A, (pair == _OPEN_A) & ((prev == _OPEN_A) | prev_value), ok)
    bad[row[~ok.astype(bool)]] = True

    nodes = np.flatnonzero(value & ~bad[row])
    node_of = np.full(m + 1, -1)
    node_of[nodes] = np.arange(len(nodes))
    close_end = end.copy()
    close_end[opener[closes]] = end[closes]
    named = in_object[nodes]
    key_tokens = nodes[named] - 2
    names = slices(data, at[key_tokens] + 1, end[key_tokens] - 1).dictionary_encode()
    decoded = unescape(names.dictionary).to_pylist()
    unique = list(dict.fromkeys(decoded))
    recode = np.array([unique.index(w) for w in decoded], np.int64)
    key = np.full(len(nodes), -1)
    if len(key_tokens):
        key[named] = recode[names.indices.to_numpy(zero_copy_only=False)]
    return Tape(data, row[nodes], kind[nodes], node_of[container[nodes]], level[nodes], key, unique, at[nodes], close_end[nodes])
