"""Text functions that Spark lacks, as expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one base letter with marks, and those letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folds()


def unaccented(text: Column) -> Column:
    """Latin letters without their marks, and no free-standing marks."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{Mn}+", "")


def by_kind(text: Column, ascii_: Callable[[Column], Column], other: Callable[[Column], Column]) -> Column:
    """What the two functions make of a text, null as empty: texts of ASCII alone have no accents and shorter classes of letters."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), ascii_(text)).otherwise(other(text))


def folded(text: Column) -> Column:
    """Lower-case, without accents."""
    return by_kind(text, F.lower, lambda t: unaccented(F.lower(t)))


def spaced(text: Column) -> Column:
    """The words of `tokens`, one space before each and one at the end, so that " a b " is in it where these words follow each other."""
    around = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    return by_kind(text, lambda t: F.regexp_replace(around(F.lower(t)), "[^a-z0-9]+", " "), lambda t: F.regexp_replace(around(unaccented(F.lower(t))), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-case, without accents. Null text has none."""
    # split at one literal character: a pattern would be compiled again for each row
    return F.array_remove(F.split(spaced(text), " "), "")
