"""Personal numbers, dates and addresses replaced by keyed pseudonyms of the same format (Feistel networks).

Everything is a DataFrame expression. A pseudonym is a permutation of all values of its format, so equal values
stay equal across documents, different ones stay different, and who holds the key can turn it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.text import packed

#: Half rounds of each network.
ROUNDS = 10
#: Dates of these many days from here on can be told apart and are permuted among themselves (to 2100-06-16).
FIRST_DATE, DATE_RADICES = "1900-01-01", (256, 286)

# Groups that repeat without bound are possessive: the others are matched by recursion, which a long text exhausts.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|(?:\d{4} ){3}\d{1,4}|(?:\d{4}-){3}\d{1,4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-])",
}
ANY = "|".join(PATTERNS.values())


def _hash(key: str, kind: str, step: Column, other: Column) -> Column:
    """60 bits of the keyed round function."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _steps(reverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1)) if reverse else F.sequence(F.lit(1), F.lit(ROUNDS))


def feistel(a: Column, b: Column, radix_a: Column, radix_b: Column, key: str, kind: str, reverse: bool = False) -> Column:
    """Permute the pair ``(a, b)``, ``0 <= a < radix_a`` and ``0 <= b < radix_b``: a struct ``a, b``."""
    sign = -1 if reverse else 1

    def half(pair: Column, step: Column) -> Column:
        new_a = F.pmod(pair["a"] + sign * (_hash(key, kind, step, pair["b"]) % radix_a), radix_a)
        new_b = F.pmod(pair["b"] + sign * (_hash(key, kind, step, pair["a"]) % radix_b), radix_b)
        odd = step % 2 == 1
        return F.struct(F.when(odd, new_a).otherwise(pair["a"]).alias("a"), F.when(odd, pair["b"]).otherwise(new_b).alias("b"))

    return F.aggregate(_steps(reverse), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), half)


def _shift_characters(text: Column, stream: Column, sign: int) -> Column:
    """Move letters and digits within their class by two hex digits of ``stream`` each; other characters stay."""

    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(stream, (i % 60) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
        code = F.ascii(c)
        out = c
        for first, size in ((48, 10), (65, 26), (97, 26)):
            inside = (code >= first) & (code < first + size)
            out = F.when(inside, F.char(F.pmod(code - first + by, F.lit(size)) + first)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def feistel_text(text: Column, key: str, kind: str, reverse: bool = False) -> Column:
    """Permute letters and digits of a text within their classes; length and other characters stay."""
    sign, cut = (-1 if reverse else 1), F.floor(F.length(text) / 2).cast("int")

    def half(pair: Column, step: Column) -> Column:
        def stream(other: Column) -> Column:
            return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), other), 512)

        def shifted(moving: Column, other: Column) -> Column:
            return _let(stream(other), lambda key_stream: _shift_characters(moving, key_stream, sign))

        odd = step % 2 == 1
        return F.struct(
            F.when(odd, shifted(pair["a"], pair["b"])).otherwise(pair["a"]).alias("a"),
            F.when(odd, pair["b"]).otherwise(shifted(pair["b"], pair["a"])).alias("b"),
        )

    start = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1).alias("b"))
    done = F.aggregate(_steps(reverse), start, half)
    return F.concat(done["a"], done["b"])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def _number(text: Column, start: int | Column, size: int | Column) -> Column:
    return F.substr(text, F.lit(start), F.lit(size)).cast("bigint")


def _padded(value: Column, width: int | Column) -> Column:
    if isinstance(width, int):
        return F.lpad(value.cast("string"), width, "0")
    text = value.cast("string")
    return F.concat(F.repeat(F.lit("0"), width - F.length(text)), text)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order by ``digits``."""
    places = F.sequence(F.lit(1), F.length(form))
    return F.array_join(
        F.transform(
            places,
            lambda i: F.when(
                F.substr(form, i, F.lit(1)).rlike(r"\d"),
                F.substr(digits, F.length(_digits(F.substr(form, F.lit(1), i))), F.lit(1)),
            ).otherwise(F.substr(form, i, F.lit(1))),
        ),
        "",
    )


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes ``payload`` and it a valid card number."""

    def weighed(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), weighed), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _card(value: Column, key: str, reverse: bool) -> Column:
    def permuted(digits: Column) -> Column:
        payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
        left = F.floor(F.length(payload) / 2).cast("int")
        right = F.length(payload) - left
        pair = feistel(
            _number(payload, 1, left), F.substr(payload, left + 1, right).cast("bigint"),
            F.pow(F.lit(10.0), left).cast("bigint"), F.pow(F.lit(10.0), right).cast("bigint"), key, "card", reverse,
        )
        new = _let(pair, lambda p: F.concat(_padded(p["a"], left), _padded(p["b"], right)))
        full = _let(new, lambda n: F.concat(n, luhn_digit(n)))
        return F.when(luhn_digit(payload) == F.right(digits, F.lit(1)), _refilled(value, full)).otherwise(value)

    return _let(_digits(value), permuted)


def _ip(value: Column, key: str, reverse: bool) -> Column:
    def permuted(part: Column) -> Column:
        n = [part[i].cast("bigint") for i in range(4)]
        pair = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "ip", reverse)
        return _let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for s in ("a", "b") for x in (F.floor(p[s] / 256), p[s] % 256)]))

    return _let(F.split(value, r"\."), permuted)


def _phone(value: Column, key: str, reverse: bool) -> Column:
    def permuted(digits: Column) -> Column:
        ten = F.right(digits, F.lit(10))
        front = F.substr(digits, F.lit(1), F.length(digits) - 10)
        area = _number(ten, 1, 3)
        # area codes from 200 on stay such codes
        base = F.when(area >= 200, F.lit(200)).otherwise(F.lit(0))
        radix = F.when(area >= 200, F.lit(800)).otherwise(F.lit(200))
        pair = feistel(area - base, _number(ten, 4, 7), radix, F.lit(10_000_000), key, "phone", reverse)
        new = _let(pair, lambda p: F.concat(front, _padded(p["a"] + base, 3), _padded(p["b"], 7)))
        return _refilled(value, new)

    return _let(_digits(value), permuted)


def _ssn(value: Column, key: str, reverse: bool) -> Column:
    area, group, serial = _number(value, 1, 3), _number(value, 5, 2), _number(value, 8, 4)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", reverse)

    def written(p: Column) -> Column:
        new_area = F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1)
        return F.concat_ws("-", _padded(new_area, 3), _padded(F.floor(p["b"] / 9999) + 1, 2), _padded(p["b"] % 9999 + 1, 4))

    return F.when(valid, _let(pair, written)).otherwise(value)


def _date_as(value: Column, shape: str, form: str, key: str, reverse: bool) -> tuple[Column, Column]:
    """Whether ``value`` is a date written as ``form``, and its pseudonym."""
    a, b = DATE_RADICES
    first = F.lit(FIRST_DATE).cast("date")
    day = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(form))), first)
    known = value.rlike(shape) & day.isNotNull() & (day >= 0) & (day < a * b)
    pair = feistel(F.floor(day / b), day % b, F.lit(a), F.lit(b), key, "date", reverse)
    return known, _let(pair, lambda p: F.date_format(F.date_add(first, (p["a"] * b + p["b"]).cast("int")), form))


def _date(value: Column, key: str, reverse: bool) -> Column:
    out = value
    for shape, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "dd/MM/yyyy")):
        known, new = _date_as(value, shape, form, key, reverse)
        out = F.when(known, new).otherwise(out)
    return out


def _email(value: Column, key: str, reverse: bool) -> Column:
    at = F.instr(value, "@")
    return F.concat(feistel_text(F.substr(value, F.lit(1), at - 1), key, "email", reverse), F.substr(value, at))


_MAKERS = {"email": _email, "ip": _ip, "phone": _phone, "card": _card, "ssn": _ssn, "date": _date}


def _kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(value: Column, key: str, reverse: bool = False) -> Column:
    """The pseudonym of one found value; a number or date that is not valid stays as it is."""

    def by_kind(kind: Column) -> Column:
        out = value
        for name, make in _MAKERS.items():
            out = F.when(kind == name, make(value, key, reverse)).otherwise(out)
        return out

    return _let(_kind(value), by_kind)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", keep: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """The ``keep`` columns (all by default) as struct ``row``, and ``text, n_found, n_replaced``.

    Found are IPv4 addresses, North American telephone numbers, card numbers (13 to 19 digits, plain, in
    fours or 4-6-5) with a valid check digit, social security numbers in valid ranges, calendar dates from 1900 to mid
    2100 (``2024-05-31``, ``31.05.2024``, ``31/05/2024``), and the local part of e-mail addresses. Each is replaced
    by another valid value of its format, wherever it stands by the same one; what looks alike but is not
    valid is counted as found and stays. ``reverse`` turns pseudonyms back. Null text stays null with zero
    found. No row moves, and a text is rebuilt from its own parts.
    """
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(packed(docs.columns if keep is None else keep), text.alias("text"))
    pattern = F.lit(ANY)
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", pattern, F.lit(0)))
    values = source.withColumn("found", found)
    new = F.when(F.size("found") > 0, F.transform("found", lambda v: pseudonym(v, key, reverse)))
    replaced = values.withColumn("new", new)
    parts = F.zip_with(F.split("text", ANY, -1), "new", lambda part, value: F.concat(part, F.coalesce(value, F.lit(""))))
    changed = F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda moved: moved)
    touched = F.col("new").isNotNull()
    return replaced.select(
        "row",
        F.when(touched, F.array_join(parts, "")).otherwise(F.col("text")).alias("text"),
        F.when(touched, F.size("found")).otherwise(F.lit(0)).alias("n_found"),
        F.when(touched, F.size(changed)).otherwise(F.lit(0)).alias("n_replaced"),
    )
