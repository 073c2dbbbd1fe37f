"""What headers mean: column types, point-of-sale, location and identity columns, titles.

Input is a header catalogue ``(sheet_id, col_idx, header)`` of any number of sheets. Classification
is a projection; everything per sheet is one grouped pass with map-side partial results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions import lexicon as lx
from tabprep.functions.text import any_of, tokenize
from tabprep.operators.scale import attach
from tabprep.sources.tables import Sheets


def _hits(tokens: Column, words: list[str]) -> Column:
    """Tokens containing any of ``words``."""
    return F.filter(tokens, lambda t: t.rlike(any_of(words)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Each level is named inside the expression, not by a projection: were a filter on the result
    pushed below a chain of projections, every level would be copied into the next.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_ALL_WORDS = [w for words in lx.SIGNALS.values() for w in words]


def signals(tokens: Column) -> Column:
    """Inputs of the scorer: hits per word list, then the length penalty."""
    length = F.length(F.array_join(tokens, ""))
    penalty = F.greatest(length - lx.FREE_LENGTH, F.lit(0)) / lx.LENGTH_UNIT
    # few tokens hold any word at all; only those are looked at once per list
    return let(
        _hits(tokens, _ALL_WORDS),
        lambda some: F.array(*[F.size(_hits(some, words)).cast("double") for words in lx.SIGNALS.values()], penalty),
    )


def lexical_features(headers: DataFrame) -> DataFrame:
    """``tokens`` and one count per signal: tokens containing a word of its list; length penalty."""
    tokens = tokenize(F.col("header"))
    counted = headers.withColumn("tokens", tokens).withColumn("_f", let(tokens, signals))
    names = [f"{name}_signal" for name in lx.SIGNALS] + ["length_penalty"]
    return counted.select(
        *headers.columns, "tokens", *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


def _layer(weights: list[list[float]], bias: list[float], inputs: Column) -> list[Column]:
    return [
        reduce(lambda a, b: a + b, [F.lit(w) * F.get(inputs, F.lit(i)) for i, w in enumerate(row)], F.lit(0.0)) + F.lit(b)
        for row, b in zip(weights, bias)
    ]


def six_digits(p: Column) -> Column:
    """Round to six significant digits; exact powers of ten keep the quotient correctly rounded."""
    scale = F.pow(F.lit(10.0), F.lit(5.0) - F.floor(F.log10(p)))
    return F.when(p > 0, F.round(p * scale) / scale).otherwise(F.lit(0.0))


def type_probabilities(header: Column) -> Column:
    """Probability per scored type as an array of doubles: two layers and a softmax."""

    def hidden(x: Column) -> Column:
        return F.array(*[F.greatest(h, F.lit(0.0)) for h in _layer(lx.HIDDEN_WEIGHTS, lx.HIDDEN_BIAS, x)])

    def logits(h: Column) -> Column:
        return F.array(*_layer(lx.OUTPUT_WEIGHTS, lx.OUTPUT_BIAS, h))

    def exponents(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        return let(total, lambda t: F.transform(e, lambda v: six_digits(v / t)))

    return let(
        tokenize(header),
        lambda t: let(signals(t), lambda x: let(hidden(x), lambda h: let(logits(h), lambda z: let(exponents(z), shares)))),
    )


def score_types(headers: DataFrame) -> DataFrame:
    """Add ``scores``: probability per type from the header scorer."""
    kinds = F.array(*[F.lit(t) for t in lx.SCORED_TYPES])
    pairs = F.zip_with(kinds, type_probabilities(F.col("header")), lambda t, p: F.struct(t.alias("type"), p.alias("score")))
    return headers.withColumn("scores", pairs)


def special_type(header: Column) -> Column:
    """``photo`` or ``address`` if the header holds such a word, else null.

    The words consist of letters only, so one lies inside a token exactly if it lies in the header.
    """
    low = F.lower(header)
    return F.when(low.rlike(any_of(lx.PHOTO_WORDS)), "photo").when(low.rlike(any_of(lx.ADDRESS_WORDS)), "address")


def classify_columns(headers: DataFrame) -> DataFrame:
    """Type, confidence and supporting tokens of every header; the first best type wins a tie."""
    header = F.col("header")
    kinds = F.array(*[F.lit(t) for t in lx.SCORED_TYPES])

    def best(p: Column) -> Column:
        top = F.array_max(p)
        return F.struct(F.get(kinds, (F.array_position(p, top) - 1).cast("int")).alias("type"), top.alias("confidence"))

    special = special_type(header)
    fixed = lambda kind, confidence: F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))
    verdict = (
        F.when(special == "photo", fixed("photo", lx.PHOTO_CONFIDENCE))
        .when(special == "address", fixed("address", lx.ADDRESS_CONFIDENCE))
        .otherwise(let(type_probabilities(header), best))
    )
    tokens = tokenize(header)
    evidence = (
        F.when(special == "photo", _hits(tokens, lx.PHOTO_WORDS))
        .when(special == "address", _hits(tokens, lx.ADDRESS_WORDS))
        .otherwise(tokens)
    )
    return headers.withColumn("_v", verdict).select(
        *headers.columns, F.col("_v.type").alias("type"), F.col("_v.confidence").alias("confidence"), evidence.alias("evidence")
    )


def keyword_score(header: Column, keywords: list[str], whole_token: bool = False) -> Column:
    """0 without a hit, else by strength. Keywords match inside words unless ``whole_token``."""
    low = F.lower(header)
    if whole_token:
        padded = F.concat(F.lit(" "), F.array_join(tokenize(header), " "), F.lit(" "))
        holds = lambda k: padded.contains(f" {k} ")
    else:
        holds = low.contains
    hits = reduce(lambda a, b: a + b, [holds(k).cast("int") for k in keywords])
    return (
        F.when(hits == 0, 0.0)
        .when(holds("pos") | holds("tpv"), lx.POS_SCORE)
        .when(hits >= 2, lx.MANY_SCORE)
        .otherwise(lx.ONE_SCORE)
    )


def keyword_best(headers: DataFrame, families: dict[str, list[str]], whole_token: bool = False) -> DataFrame:
    """Per sheet and keyword family the best header and its score; ties to the first column."""
    scored = headers.select(
        "*", *[keyword_score(F.col("header"), words, whole_token).alias(f"_{name}") for name, words in families.items()]
    )
    picks = []
    for name in families:
        rank = F.when(F.col(f"_{name}") > 0, F.struct(F.col(f"_{name}"), -F.col("col_idx")))
        picks += [
            F.max_by("header", rank).alias(f"{name}_column"),
            F.coalesce(F.max(f"_{name}"), F.lit(0.0)).alias(f"{name}_score"),
        ]
    return scored.groupBy("sheet_id").agg(*picks)


def identity_column(headers: DataFrame) -> DataFrame:
    """First header of each sheet naming an identity document or technician, null if none."""
    hit = F.lower("header").rlike(any_of(lx.IDENTITY_KEYWORDS))
    return headers.groupBy("sheet_id").agg(F.min_by("header", F.when(hit, F.col("col_idx"))).alias("identity_column"))


def detect_pos(classified: DataFrame, whole_token: bool = False) -> DataFrame:
    """Point-of-sale column per sheet from ``(sheet_id, col_idx, header, type)``."""
    score = keyword_score(F.col("header"), lx.POS_KEYWORDS, whole_token)
    scored = classified.withColumn("_score", score)
    rank = F.when(F.col("_score") > 0, F.struct("_score", -F.col("col_idx")))
    best = scored.groupBy("sheet_id").agg(F.max_by(F.struct("header", "type", "_score"), rank).alias("_b"))
    column, found = F.col("_b.header"), F.col("_b").isNotNull()
    sample = F.concat(F.lit("{{"), column, F.lit("}}"))
    upper = F.concat(F.lit("POS-"), F.upper(column))
    return best.select(
        "sheet_id",
        column.alias("pos_column"),
        F.when(found, F.round(F.least(F.lit(0.95), F.col("_b._score") + 0.05), 2))
        .otherwise(F.lit(lx.NO_POS_CONFIDENCE))
        .alias("pos_confidence"),
        F.when(found, F.array(sample, F.concat(sample, F.lit("-alt"))))
        .otherwise(F.array(F.lit("<POS requerido>")))
        .alias("sample_values"),
        F.when(found, F.array(upper, F.concat(upper, F.lit("-SITE"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("normalized_samples"),
        (~found).alias("missing_required"),
        F.when(~found, F.array(F.lit("pos-not-found")))
        .when(F.col("_b.type") != "number", F.array(F.lit("pos-not-numeric")))
        .otherwise(F.array().cast("array<string>"))
        .alias("warnings"),
    )


def validate_geo(headers: DataFrame, pos: DataFrame, whole_token: bool = False) -> DataFrame:
    """Address and coordinate columns, confidence, verdict and issue codes per sheet."""
    best = keyword_best(headers, lx.LOCATION_KEYWORDS, whole_token).join(
        pos.select("sheet_id", "missing_required"), "sheet_id"
    )
    address, lat, lon = (F.col(f"{n}_column") for n in lx.LOCATION_KEYWORDS)
    confidence = F.greatest("address_score", "latitude_score", "longitude_score", F.lit(lx.LEAST_GEO_CONFIDENCE))
    return best.select(
        "sheet_id",
        address.alias("address_column"),
        lat.alias("latitude_column"),
        lon.alias("longitude_column"),
        F.round(confidence, 2).alias("geo_confidence"),
        (address.isNotNull() & ~F.col("missing_required")).alias("geo_ok"),
        F.array_compact(
            F.array(
                F.when(address.isNull(), "address-missing"),
                F.when(lat.isNull() | lon.isNull(), "coordinates-missing"),
                F.when(F.col("missing_required"), "pos-required"),
            )
        ).alias("issues"),
    )


def title_hint(pos: DataFrame) -> DataFrame:
    """Title template of the tickets of each sheet."""
    before, after = lx.TITLE_WITH_POS.split("%s")
    return pos.select(
        "sheet_id",
        F.coalesce(F.concat(F.lit(before), "pos_column", F.lit(after)), F.lit(lx.TITLE_WITHOUT_POS)).alias("title_template"),
    )


def render_titles(sheets: Sheets, hints: DataFrame) -> DataFrame:
    """Fill the ``{{header}}`` places of each row's title template with its cells."""
    labels = sheets.headers.groupBy("sheet_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda s: s["header"]).alias("_labels")
    )
    side = hints.select("sheet_id", "title_template").join(labels, "sheet_id")
    filled = F.aggregate(
        F.arrays_zip("_labels", "cells"),
        F.col("title_template"),
        lambda text, p: F.replace(text, F.concat(F.lit("{{"), p["_labels"], F.lit("}}")), F.coalesce(p["cells"], F.lit(""))),
    )
    return attach(sheets.rows, side, ["sheet_id"], how="inner").select("sheet_id", "row_idx", filled.alias("title"))
