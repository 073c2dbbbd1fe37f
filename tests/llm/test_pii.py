import hashlib
import re
from datetime import date, datetime, timedelta

from llm.conftest import sample
from pyspark.sql import functions as F

from tabprep.llm.pii import ANY, PATTERNS, feistel, luhn_digit, pseudonym, pseudonymise

TEXTS = [
    "Mail bob.42@mail8.example.com, from 42.144.35.254. Call +1 (988) 555-2485 or 743-555-3824.",
    "Card 4737097684299439 or 4737-0976-8429-9439 or 4737 0976 8429 9439, not 4737097684299438.",
    "Born 2024-02-29, 31.05.2024 or 31/05/2024; not 30.02.2024, 2024-13-01 or 1850-01-01.",
    "Number 123-45-6789, never 666-45-6789 or 000-12-3456.",
    "4465758382889437 4465758382889437 x@y.zz bob.42@mail8.example.com",
    "256.1.1.1 and 1.2.3.4.5 and version 2.0 and 12345",
    "no digits at all",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_round_trip_and_formats(spark):
    docs = sample(spark, TEXTS)
    made = pseudonymise(docs, "key").select("row.doc_id", "text", "n_found", "n_replaced").orderBy("doc_id").collect()
    back = pseudonymise(spark.createDataFrame([(r["doc_id"], r["text"]) for r in made], "doc_id long, text string"), "key", reverse=True)
    assert [r["text"] for r in back.orderBy("row.doc_id").collect()] == TEXTS
    assert [r["n_replaced"] for r in made] == [4, 3, 3, 1, 4, 0, 0]
    texts = [r["text"] for r in made]
    for before, after in zip(TEXTS, texts):
        assert re.sub(r"\d+", "9", re.sub(r"[a-z]+", "a", before)) == re.sub(r"\d+", "9", re.sub(r"[a-z]+", "a", after))
    cards = re.findall(r"\d{16}|\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}", texts[1])[:3]
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and luhn(re.sub(r"\D", "", cards[0])) and "4737097684299438" in texts[1]
    days = re.search(r"Born (\S+), (\S+) or (\S+);", texts[2]).groups()
    date.fromisoformat(days[0])
    assert days[1].replace(".", "/") == days[2] and "30.02.2024" in texts[2] and "1850-01-01" in texts[2]
    assert all(int(o) < 256 for o in re.search(r"from (\S+)\. ", texts[0])[1].split("."))
    assert texts[4].split()[0] == texts[4].split()[1] and texts[4].split()[3] == texts[0].split()[1].rstrip(",")
    for secret in ("bob.42@", "42.144.35.254", "555-2485", "4737097684299439", "2024-02-29", "123-45-6789"):
        assert not any(secret in t for t in texts)


def test_another_key_gives_another_pseudonym(spark):
    docs = sample(spark, TEXTS[:1])
    assert pseudonymise(docs, "a").first()["text"] != pseudonymise(docs, "b").first()["text"]


def test_the_network_permutes(spark):
    pairs = spark.range(7 * 13).select(F.floor(F.col("id") / 13).alias("a"), (F.col("id") % 13).alias("b"))
    out = pairs.select(feistel(F.col("a"), F.col("b"), F.lit(7), F.lit(13), "k", "t").alias("p")).select("p.*").collect()
    assert sorted((r["a"], r["b"]) for r in out) == [(a, b) for a in range(7) for b in range(13)]


def test_values_of_a_format_stay_apart(spark):
    values = [f"{d:%Y-%m-%d}" for d in (date(2000, 1, 1), date(1900, 1, 1), date(2100, 6, 16), date(2024, 2, 29))]
    values += [f"10.0.{i}.{j}" for i in range(8) for j in range(8)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = [r[0] for r in df.select(pseudonym(F.col("v"), "k")).collect()]
    assert len(set(out)) == len(values) and all(date.fromisoformat(v) for v in out[:4])


def test_check_digit(spark):
    df = spark.createDataFrame([("7992739871",), ("411111111111111",)], "p string")
    assert [r[0] for r in df.select(luhn_digit(F.col("p"))).collect()] == ["3", "1"]


def test_odd_rows(odd, none):
    got = pseudonymise(odd, "k").collect()
    assert [r["text"] for r in got] == [r["text"] for r in odd.collect()] and [tuple(r["row"]) for r in got] == [tuple(r) for r in odd.collect()]
    assert pseudonymise(none, "k").count() == 0
    plan = pseudonymise(odd, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- the same in plain Python ----------------------------------------------------------------------


def network(a, b, size_a, size_b, key, kind):
    """Ten half rounds, the left half first."""
    for step in range(1, 11):
        other = b if step % 2 else a
        h = int(hashlib.sha256(f"{key}|{kind}|{step}|{other}".encode()).hexdigest()[:15], 16)
        a, b = ((a + h) % size_a, b) if step % 2 else (a, (b + h) % size_b)
    return a, b


def moved(half, stream):
    out = ""
    for i, c in enumerate(half):
        by = int(stream[i % 60 * 2 : i % 60 * 2 + 2], 16)
        for first, size in (("0", 10), ("A", 26), ("a", 26)):
            if ord(first) <= ord(c) < ord(first) + size:
                c = chr((ord(c) - ord(first) + by) % size + ord(first))
                break
        out += c
    return out


def plain_mail(value, key):
    name, at, host = value.partition("@")
    a, b = name[: len(name) // 2], name[len(name) // 2 :]
    for step in range(1, 11):
        stream = hashlib.sha512(f"{key}|email|{step}|{b if step % 2 else a}".encode()).hexdigest()
        a, b = (moved(a, stream), b) if step % 2 else (a, moved(b, stream))
    return a + b + at + host


def refill(form, digits):
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def plain_card(value, key):
    digits = re.sub(r"\D", "", value)
    if not luhn(digits):
        return value
    payload, left = digits[:-1], (len(digits) - 1) // 2
    right = len(payload) - left
    a, b = network(int(payload[:left]), int(payload[left:]), 10**left, 10**right, key, "card")
    new = f"{a:0{left}d}{b:0{right}d}"
    return refill(value, new + next(c for c in "0123456789" if luhn(new + c)))


def plain_ip(value, key):
    n = [int(x) for x in value.split(".")]
    a, b = network(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def plain_phone(value, key):
    digits = re.sub(r"\D", "", value)
    front, area, rest = digits[:-10], int(digits[-10:-7]), int(digits[-7:])
    base, size = (200, 800) if area >= 200 else (0, 200)
    a, b = network(area - base, rest, size, 10**7, key, "phone")
    return refill(value, f"{front}{a + base:03d}{b:07d}")


def plain_ssn(value, key):
    area, group, serial = (int(x) for x in value.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return value
    areas = [x for x in range(1, 900) if x != 666]
    a, b = network(areas.index(area), (group - 1) * 9999 + serial - 1, len(areas), 99 * 9999, key, "ssn")
    return f"{areas[a]:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def plain_date(value, key):
    form = "%Y-%m-%d" if value[4] == "-" else "%d.%m.%Y" if value[2] == "." else "%d/%m/%Y"
    try:
        day = (datetime.strptime(value, form).date() - date(1900, 1, 1)).days
    except ValueError:
        return value
    if not 0 <= day < 256 * 286:
        return value
    a, b = network(day // 286, day % 286, 256, 286, key, "date")
    return f"{date(1900, 1, 1) + timedelta(a * 286 + b):{form}}"


def brute(value, key):
    for kind, make in (("email", plain_mail), ("ip", plain_ip), ("phone", plain_phone), ("card", plain_card), ("ssn", plain_ssn), ("date", plain_date)):
        if re.fullmatch(PATTERNS[kind], value):
            return make(value, key)


def test_documents_against_plain_python(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(10_000 + i, t) for i, t in enumerate([*TEXTS, "Amex 3782 822463 10005 and 3714-496353-98431, not 3782 822463 10006"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonymise(df, "key").select("row.doc_id", "text", "n_found", "n_replaced").collect()}
    hits = 0
    for i, text in docs:
        found = [m[0] for m in re.finditer(ANY, text)]
        assert got[i]["text"] == re.sub(ANY, lambda m: brute(m[0], "key"), text)
        assert (got[i]["n_found"], got[i]["n_replaced"]) == (len(found), sum(brute(v, "key") != v for v in found))
        hits += len(found)
    assert hits > 40 and got[10_007]["n_replaced"] == 2


def test_very_long_runs_of_labels_digits_and_signs(spark):
    n = 100_000
    texts = ["mail a@b" + ".c" * n, "x@" * n, "a." * n + "b@c.de", "1" * n, "1." * n, "1-" * n, "12/" * n, "@" * n, "a@b" + "." * n, "4737 " * n, "a" * n + "@b.cd", "(" * n, "1@1.1" * n]
    got = pseudonymise(sample(spark, texts), "k").orderBy("row.doc_id").collect()
    assert [len(r["text"]) for r in got] == list(map(len, texts))
    assert got[0]["n_found"] == 1 and got[0]["text"].endswith("@b" + ".c" * n) and not got[0]["text"].startswith("mail a@")
    assert got[8]["n_found"] == 0 and got[3]["text"] == texts[3] and got[10]["n_replaced"] == 1
