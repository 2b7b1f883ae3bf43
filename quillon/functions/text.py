"""Text functions as built-in column expressions, so that filters stay inside generated code."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters that no decomposition reaches, with what they stand for.
LIGATURES = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "Ð": "D", "đ": "d", "ð": "d", "Þ": "Th", "þ": "th",
    "Ħ": "H", "ħ": "h", "Ŋ": "NG", "ŋ": "ng", "Ŧ": "T", "ŧ": "t", "ı": "i", "ĸ": "k",
}


def _folded(c: str) -> str:
    """A character after NFKD, without combining marks, ligatures spelled out; Hangul syllables stay whole."""
    if "가" <= c <= "힣":
        return c
    return "".join(LIGATURES.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other, and these; those that fold to several; the ones that vanish come last in the
    first text, without a counterpart."""
    source, target, gone, several = [], [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(code)
        base = _folded(c)
        if base == c:
            continue
        if not base:
            gone.append(c)
        elif len(base) == 1:
            source.append(c)
            target.append(base)
        else:
            several[c] = base
    return "".join(source + gone), "".join(target), several


def _ranges(characters: str) -> str:
    """Characters as the ranges of a pattern's class."""
    codes, out = sorted(map(ord, characters)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in out)


def fold_accents(c: Column) -> Column:
    """Text after NFKD without combining marks and ligatures, letter case kept; Hangul syllables stay whole."""
    source, target, several = _tables()
    # most texts are plain and left alone; the few characters that become several are looked up only in texts with one
    spelled = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    letters = F.regexp_extract_all(c, F.lit("([\\s\\S])"), 1)
    some = F.rlike(c, F.lit(f"[{_ranges(''.join(several))}]"))
    long = F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(spelled, x), x)), "")
    return F.when(F.rlike(c, F.lit("[^\\x00-\\x7f]")), F.translate(F.when(some, long).otherwise(c), source, target)).otherwise(c)


def fold_text(s: str) -> str:
    """The same for a Python string."""
    return s if s.isascii() else "".join(map(_folded, s))


def collate(c: Column) -> Column:
    """What names are compared by: no accents, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(fold_accents(c)), r"[^\p{L}\p{N}]+", "")


def collate_text(s: str) -> str:
    return "".join(c for c in fold_text(s).lower() if unicodedata.category(c)[0] in "LN")


def slug(c: Column) -> Column:
    """Lower case; every run of other than a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_text(s: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "-", s.lower()).strip("-")


def title_words(c: Column) -> Column:
    """Every letter that follows no letter in upper case, the others in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def trigrams(c: Column) -> Column:
    """The distinct three-character pieces of a text, two blanks before it and one after."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def natural_key(number: Column) -> Column:
    """A collector number as (letters before, number, rest), so that 9 sorts before 10 and 10a after 10."""
    part = lambda i: F.regexp_extract(number, r"^(\D*)(\d*)([\s\S]*)$", i)
    return F.struct(F.lower(part(1)).alias("prefix"), part(2).try_cast("bigint").alias("number"), F.lower(part(3)).alias("suffix"))
