"""Texts of test items that leaked, fully or partly, into a corpus: pigeonhole edit matching.

An item is cut into passages of ``window`` consecutive words (the whole item if it has fewer), and each passage into one
piece more than it may have edits of a character; a passage that occurs with at most so many edits thus leaves one of its
pieces untouched.  All pieces are looked up exactly, in one sweep of the
document by an Aho-Corasick automaton.  From a hit the exact match is followed to both sides as far as it goes; unless the
next few characters rule every passage out, the passages around it are verified by Myers' bit-parallel distance.

Documents are read where they lie, once, without a shuffle.  Items are written to the shared folder in blocks of bounded
size, from which every executor gets them as files; a task keeps a bounded piece of its documents and works the blocks
off one after the other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import words
from quillon.runtime import materialise, ship_code, ship_files

#: Bytes of item text that one block, and with it one automaton, may hold.
BLOCK_BYTES = 4 << 20
#: Characters of documents that a task holds while it works off several blocks, and automata that a worker keeps.
HELD_CHARACTERS, KEPT_BLOCKS = 64 << 20, 2
#: Characters of a passage for each of the pieces that its edits demand: a shorter passage may have fewer edits.
LEAST_PIECE = 8
#: Characters beyond an exact match that are looked at before a passage is verified.
LOOK = 24
_kept: dict[tuple, "_Matcher"] = {}


def myers(pattern: str, text: str) -> int:
    """The least number of edits that turn ``pattern`` into some substring of ``text`` (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = at.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(across | plus) & full
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        best = min(best, score)
    return best


def distances(pattern: str, text: str, ends: list[int], most: int) -> list[int | None]:
    """For each of the rising ``ends`` the least number of edits between that much of ``pattern`` and some beginning of
    ``text``; None if there are more than ``most``.

    Myers' recurrence with both beginnings fixed: a column's differences are two words of bits, so any of its distances
    is the column's number plus the bits below it.
    """
    out: list[int | None] = [e if e <= most else None for e in ends]
    if not ends:
        return out
    m = ends[-1]
    at: dict[str, int] = {}
    for i, c in enumerate(pattern[:m]):
        at[c] = at.get(c, 0) | 1 << i
    full, plus, minus = (1 << m) - 1, (1 << m) - 1, 0
    first = 0
    for j, c in enumerate(text[: m + most], 1):
        eq = at.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(across | plus) & full) << 1 & full | 1
        down = (plus & across) << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        while first < len(ends) and ends[first] < j - most:
            first += 1
        for k in range(first, len(ends)):
            e = ends[k]
            if e > j + most:
                break
            below = (1 << e) - 1
            d = j + (plus & below).bit_count() - (minus & below).bit_count()
            if d <= most and (out[k] is None or d < out[k]):
                out[k] = d
    return out


def reach(pattern: str, text: str, most: int) -> list[int]:
    """For 0 to ``most`` edits how much of ``pattern`` some beginning of ``text`` can meet with no more than these."""
    n, m = len(pattern), len(text)
    far: dict[int, int] = {}
    out = []
    for edits in range(most + 1):
        after = {}
        for d in range(-edits, edits + 1):
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1) if edits else 0
            i = min(i, n, m - d)
            while i < n and i + d < m and i + d >= 0 and pattern[i] == text[i + d]:
                i += 1
            after[d] = i
        far = after
        out.append(max(far.values()))
    return out


def _common(a: str, i: int, b: str, j: int) -> int:
    """How many characters of ``a`` from ``i`` on and of ``b`` from ``j`` on are the same."""
    lo, hi = 0, min(len(a) - i, len(b) - j)
    step = 16
    while lo < hi:
        size = min(step, hi - lo)
        if a[i + lo : i + lo + size] == b[j + lo : j + lo + size]:
            lo += size
            step *= 2
        elif size == 1:
            break
        else:
            hi, step = lo + size - 1, max(1, size // 2)
    return lo


class _Text:
    """One text of an item: its body (words with one blank around each), the body backwards, where its passages begin and
    end, their numbers within the item, and how many edits each may have."""

    def __init__(self, item: int, w: list[str], window: int, errors: int, numbers: dict[str, int]) -> None:
        self.item = item
        self.body = f" {' '.join(w)} "
        self.back, self.size = self.body[::-1], len(self.body)
        starts = [0]
        for word in w:
            starts.append(starts[-1] + len(word) + 1)
        n = min(window, len(w))
        self.starts = starts[: len(w) - n + 1]
        self.ends = [e + 1 for e in starts[n:]]
        self.number, self.budget = [], []
        for s, e in zip(self.starts, self.ends, strict=True):
            passage = self.body[s:e]
            self.number.append(numbers.setdefault(passage, len(numbers)))
            self.budget.append(max(0, min(errors, len(passage) // LEAST_PIECE - 1)))
        size = window // (errors + 1)
        self.pieces: list[tuple[int, int]] = []
        if len(w) >= window and size:
            # a passage's pieces are runs of so many words one after the other; passages that overlap share most of theirs
            self.pieces = [(starts[i], starts[i + size]) for i in range(len(w) - size + 1)]
        else:
            for s, e, b in zip(self.starts, self.ends, self.budget, strict=True):
                cuts = [s + (e - s) * i // (b + 1) for i in range(b + 2)]
                self.pieces += zip(cuts, cuts[1:], strict=False)


class _Matcher:
    def __init__(self, items: list[tuple[int, str]], window: int, errors: int) -> None:
        self.errors = errors
        self.texts: list[_Text] = []
        numbers: dict[int, dict[str, int]] = {}
        pieces: dict[str, set[tuple[int, int]]] = {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            own = _Text(item, w, window, errors, numbers.setdefault(item, {}))
            for lo, hi in own.pieces:
                pieces.setdefault(own.body[lo:hi], set()).add((len(self.texts), lo))
            self.texts.append(own)
        self.count = {item: len(passages) for item, passages in numbers.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), sorted(places)))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def found(self, body: str) -> dict[int, dict[int, int]]:
        """item -> passage -> edits, for the passages that a body of words with one blank around each holds."""
        out: dict[int, dict[int, int]] = {}
        if self.empty or len(body) < 3:
            return out
        seen: dict[tuple[int, int], int] = {}
        back = ""
        for last, (length, places) in self.automaton.iter(body):
            begin = last - length + 1
            for number, offset in places:
                # an exact match is followed once, from its first piece on
                if seen.get((number, begin - offset), -1) >= offset + length:
                    continue
                text = self.texts[number]
                hi = offset + length + _common(text.body, offset + length, body, last + 1)
                seen[number, begin - offset] = hi
                back = back or body[::-1]
                lo = offset - _common(text.back, text.size - offset, back, len(back) - begin)
                self._around(text, lo, hi, begin - offset, body, back, out)
        return out

    def _around(self, text: _Text, lo: int, hi: int, shift: int, body: str, back: str, out: dict[int, dict[int, int]]) -> None:
        """The passages that share something with the exact match of ``text`` from ``lo`` to ``hi``, ``shift`` further on in
        the document, and have few enough edits."""
        most = self.errors
        right = reach(text.body[hi : hi + LOOK], body[hi + shift : hi + shift + LOOK + most], most)
        left = reach(text.back[text.size - lo : text.size - lo + LOOK], back[len(back) - lo - shift : len(back) - lo - shift + LOOK + most], most)
        for e in range(most + 1):
            # the first passage that begins within reach is the one that ends first
            i = 0 if left[e] >= LOOK else bisect_left(text.starts, lo - left[e])
            if i < len(text.starts) and (right[most - e] >= LOOK or text.ends[i] <= hi + right[most - e]):
                break
        else:
            return
        first, past = bisect_right(text.ends, lo), bisect_left(text.starts, hi)
        beyond = [e - hi for e in text.ends[first:past] if e > hi]
        before = [lo - s for s in reversed(text.starts[first:past]) if s < lo]
        after = distances(text.body[hi:], body[hi + shift : hi + shift + text.size + most], beyond, most)
        before = distances(text.back[text.size - lo :], back[len(back) - lo - shift : len(back) - lo - shift + text.size + most], before, most)
        held = past - first
        after = [0] * (held - len(after)) + after
        before = before[::-1] + [0] * (held - len(before))
        own = out.get(text.item)
        for i, a, b in zip(range(first, past), before, after, strict=True):
            if a is not None and b is not None and a + b <= text.budget[i]:
                if own is None:
                    own = out.setdefault(text.item, {})
                n = text.number[i]
                own[n] = min(a + b, own.get(n, a + b))


def _matcher(name: str, window: int, errors: int) -> _Matcher:
    key = (name, window, errors)
    if key not in _kept:  # once a Python worker, unless there are many blocks
        while len(_kept) >= KEPT_BLOCKS:
            _kept.pop(next(iter(_kept)))
        table = pq.read_table(SparkFiles.get(name))
        _kept[key] = _Matcher(sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)), window, errors)
    return _kept[key]


_KINDS = {"doc_id": pa.int64(), "item_id": pa.int64(), "passages": pa.int32(), "exact_passages": pa.int32(), "of_passages": pa.int32(), "edits": pa.int32()}


def _run(names: list[str], window: int, errors: int):
    def sweep(held: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        for name in names:
            matcher = _matcher(name, window, errors)
            rows = [
                (doc, item, len(hits), sum(not e for e in hits.values()), matcher.count[item], min(hits.values()))
                for doc, body in held
                for item, hits in matcher.found(body).items()
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], list(_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = HELD_CHARACTERS if len(names) > KEPT_BLOCKS else 0
        held: list[tuple[int, str]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = f" {' '.join(words(text.as_py()))} "
                held.append((doc, body))
                size += len(body)
                if most and size > most:
                    yield from sweep(held)
                    held, size = [], 0
            if not most:
                yield from sweep(held)
                held = []
        if held:
            yield from sweep(held)

    return run


def find_leaks(documents: DataFrame, items: DataFrame, window: int = 12, errors: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, passages, exact_passages, of_passages, edits): the documents that hold passages of items, with how
    many of the item's different passages they hold, how many of them without an edit, of how many, and the fewest edits
    of one of them.

    ``documents`` has ``doc_id, text``; ``items`` has ``item_id, text``.  Both texts are compared as words (see
    ``words``).  A passage may have ``errors`` edits of a character, a short one fewer: one less than it has
    ``LEAST_PIECE`` characters, so that a single short word has to be met as it is.

    Null or wordless texts hold and are nothing.  A passage counts once however often it occurs; a repeated row of
    documents gives its rows again, repeated items count once, and several texts of one item count together.  Empty
    tables give no rows.  Whole texts are read.  Other columns are never read.
    """
    if window < 1 or errors < 0:
        raise ValueError("window must be at least 1, errors at least 0")
    spark = documents.sparkSession
    ship_code(spark)
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    distinct = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    _, path = materialise(distinct.repartition(blocks, F.xxhash64("item_id")), "items")
    names = ship_files(spark, path)
    return texts.mapInArrow(_run(names, window, errors), ", ".join(f"{c} {'bigint' if k == pa.int64() else 'int'}" for c, k in _KINDS.items()))
