"""Text expressions shared by cleaning, header and assignment operators."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character Unicode treats as white space, plus the four ASCII information separators.
WHITESPACE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())


def _accent_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letter, then the combining marks to delete."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(mark) <= 0x36F for mark in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return "".join(source) + marks, "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip(value: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.when(_tight(value), value).otherwise(F.trim(value, F.lit(WHITESPACE)))


def _tight(value: Column) -> Column:
    """Whether a text begins and ends with a visible ASCII character, told without a look at what lies between."""
    last = F.substring(value.cast("binary"), -1, 1)
    return F.ascii(value).between(33, 126) & last.between(F.lit(b"!"), F.lit(b"~"))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def clean_cell(value: Column) -> Column:
    return F.when(_tight(value), value).otherwise(blank_to_null(F.trim(value, F.lit(WHITESPACE))))


def strip_accents(value: Column) -> Column:
    return F.translate(value, _ACCENTED, _PLAIN)


def normalize_text(value: Column) -> Column:
    """Accent-free lower case text with only ``[A-Za-z0-9_]`` and white space left, trimmed."""
    plain = F.lower(strip_accents(value))
    return strip(F.regexp_replace(plain, r"(?U)[^A-Za-z0-9_\s]", ""))


def tokenize(value: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(value), r"[^\p{L}\p{N}]+"), lambda token: token != "")


def any_of(words: list[str]) -> str:
    """A regular expression that finds any of ``words``."""
    return "|".join(w.replace(".", r"\.") for w in words)


def normalize_document_id(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"(?U)[\s.\-]", ""))
