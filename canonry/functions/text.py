"""Text folding and blank handling as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java regex class of all Unicode white space, with the zero-width and BOM characters that act as blanks.
BLANK = r"[\s\p{Z}\x{200B}\x{FEFF}]"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Characters that decompose to one ASCII letter or digit, and those; then the marks to remove. By rule, not by list."""
    source, target = [], []
    for code in range(0xA1, min(0x10000, sys.maxunicode)):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        base = unicodedata.normalize("NFKD", char) if 0xFF00 <= code <= 0xFF5E else unicodedata.normalize("NFD", char)
        letters = [c for c in base if not unicodedata.combining(c)]
        if len(letters) == 1 and letters[0].isascii() and letters[0].isalnum():
            source.append(char)
            target.append(letters[0].lower())
    # characters beyond the length of the target are removed: the combining marks of the Unicode blocks for them
    marks = [chr(c) for a, b in ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)) for c in range(a, b + 1)]
    return "".join(source) + "đĐ" + "".join(marks), "".join(target) + "dd"


def fold(col: Column | str) -> Column:
    """Lower case without accents, in any Unicode form, with đ as d. Null stays null."""
    source, target = _fold_table()
    col = F.col(col) if isinstance(col, str) else col
    return F.translate(F.lower(col), source, target)


def squeeze(col: Column | str) -> Column:
    """Without outer blanks and with one space for every inner run of blanks of any kind."""
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(col, BLANK + "+", " "))


def known(col: Column | str, *sentinels: str) -> Column:
    """`col`, or null where it is blank or one of `sentinels`, regardless of case and outer blanks."""
    col = F.col(col) if isinstance(col, str) else col
    bare = F.lower(squeeze(col))
    return F.when((bare != "") & ~bare.isin([s.lower() for s in sentinels]), col)


def letters_digits(col: Column | str) -> Column:
    """Folded text with everything but letters and digits removed; null where nothing remains."""
    return F.nullif(F.regexp_replace(fold(col), r"[^\p{L}\p{N}]+", ""), F.lit(""))
