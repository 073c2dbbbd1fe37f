"""Recognise numbers, dates and booleans written as text, the same way on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_TIME = r"([ T]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?Z?)?"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}" + _TIME + "$"
LOCAL_DATE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}" + _TIME + "$"

#: Most bytes of a date text and of a boolean spelling, with room for a line end; a longer text need not be looked at.
_DATE_BYTES, _BOOLEAN_BYTES = (8, 40), 8

# Spellings of a boolean.
TRUE_WORDS = ["true", "1", "yes", "si", "sí"]
FALSE_WORDS = ["false", "0", "no"]


def as_number(value: Column) -> Column:
    """Double, or null. Literals such as ``NaN``, ``inf`` or ``12d`` are not numbers here."""
    first = F.ascii(value)
    # +, -, . or a digit, before a pattern is tried; 47 is the slash
    maybe = first.between(43, 57) & (first != 44) & (first != 47)
    return F.when(maybe & value.rlike(NUMBER), value.try_cast("double"))


def _ordered_date(value: Column, order: str) -> Column:
    text = F.regexp_replace(value, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}).*$", order)
    return text.try_cast("date")


def as_day(value: Column, day_first: bool = True) -> Column:
    """Calendar day of a date or timestamp text; ISO order, or day/month (else month/day) first."""
    orders = ["$3-$2-$1", "$3-$1-$2"] if day_first else ["$3-$1-$2", "$3-$2-$1"]
    # a digit first, a separator within the first five characters, and not too long, before a pattern is tried
    maybe = F.octet_length(value).between(*_DATE_BYTES) & F.ascii(value).between(48, 57)
    parted = lambda sign: F.instr(value, sign).between(2, 5)
    return F.when(maybe & (parted("-") | parted("/")), F.when(
        value.rlike(ISO_DATE), F.regexp_extract(value, r"^\d{4}-\d{1,2}-\d{1,2}", 0).try_cast("date")
    ).when(value.rlike(LOCAL_DATE), F.coalesce(*[_ordered_date(value, o) for o in orders])))


def as_epoch(value: Column, day_first: bool = True) -> Column:
    """Seconds since 1970-01-01 of a date text, read as UTC."""
    clock = F.split(F.regexp_extract(value, r"[ T]([\d:.]+)Z?$", 1), ":")
    part = lambda i: F.coalesce(F.get(clock, F.lit(i)).try_cast("double"), F.lit(0.0))
    seconds = part(0) * 3600 + part(1) * 60 + part(2)
    timed = F.when(F.contains(value, F.lit(":")), seconds).otherwise(F.lit(0.0))
    return F.unix_date(as_day(value, day_first)) * F.lit(86400.0) + timed


def is_boolean(value: Column) -> Column:
    long = F.octet_length(value) > _BOOLEAN_BYTES
    return F.when(long, False).otherwise(F.lower(value).isin(TRUE_WORDS + FALSE_WORDS))


def as_boolean_text(value: Column) -> Column:
    """``"true"`` / ``"false"`` for boolean spellings, other text lower-cased, null kept."""
    low = F.lower(value)
    return F.when(low.isin(TRUE_WORDS), "true").when(low.isin(FALSE_WORDS), "false").otherwise(low)
