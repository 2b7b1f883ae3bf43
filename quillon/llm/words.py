"""The words of a text, comparable across spellings."""

from __future__ import annotations

import re
import unicodedata


class _Kept(dict):
    """What becomes of a character: dropped if a nonspacing mark or format character, else itself."""

    def __missing__(self, code: int) -> int | None:
        kept = None if unicodedata.category(chr(code)) in ("Mn", "Cf") else code
        self[code] = kept
        return kept


_KEPT = _Kept()
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits (numerals of any script), after NFKD without nonspacing marks and format
    characters, in lower case; of null none."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_KEPT)
    return _WORD.findall(text.lower())
