"""Reproducible splits, class balance, imputation and classification quality, drift."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.operators.scale import CHUNK_ROWS, attach, chunked, scan_sum


def stable_unit(*keys: Column, seed: int = 0) -> Column:
    """Number in [0, 1) that depends on the key values only, in any engine and any run."""
    text = F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def split(df: DataFrame, key: str, train: float = 0.8, seed: int = 0) -> DataFrame:
    """Add ``part``: the same row always falls on the same side."""
    return df.withColumn("part", F.when(stable_unit(F.col(key), seed=seed) < train, "train").otherwise("test"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = rows / (classes × rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # one row per class, then one row in all
    total = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weights = counts.select(label, (F.lit(total.n or 0) / (F.lit(total.k) * F.col("_n"))).alias("weight"))
    return attach(df, weights, [label])


def oversample(df: DataFrame, label: str) -> DataFrame:
    """Repeat rows of rare classes up to the size of the largest, spread evenly by whole copies."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    copies = counts.select(label, F.greatest(F.floor(F.lit(most) / F.col("_n")), F.lit(1)).cast("int").alias("_copies"))
    repeated = attach(df, copies, [label]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.drop("_copies")


def masked_imputation_error(numbers: DataFrame, keys: Sequence[str], row: str, value: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Hide a stable share of the values, impute each by its group mean, and score the hidden ones."""
    hidden = stable_unit(F.col(row), seed=seed) < share
    known = numbers.filter(F.col(value).isNotNull()).withColumn("_hidden", hidden)
    means = known.groupBy(*keys).agg(F.avg(F.when(~F.col("_hidden"), F.col(value))).alias("_guess"))
    scored = attach(known.filter("_hidden"), means, list(keys), how="inner")
    gap = F.col(value) - F.col("_guess")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hidden"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse")
    )


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of every class that occurs as label or prediction."""
    cells = confusion(df, label, predicted)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col(label).cast("string").alias("cls"), F.lit(True).alias("is_label"), F.col("n"), (F.col(label) == F.col(predicted)).alias("hit")),
                F.struct(F.col(predicted).cast("string").alias("cls"), F.lit(False).alias("is_label"), F.col("n"), (F.col(label) == F.col(predicted)).alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    counts = sides.groupBy("cls").agg(
        F.sum(F.when(F.col("is_label") & F.col("hit"), F.col("n")).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col("is_label"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("is_label"), F.col("n")).otherwise(0)).alias("_said"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.select(
        F.col("cls").alias("class"),
        "support",
        ratio(F.col("_tp"), F.col("_said")).alias("precision"),
        ratio(F.col("_tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("_tp"), F.col("_said") + F.col("support")).alias("f1"),
    )


# Cumulative probabilities of a Poisson(1) draw of 0, 1, 2, …
POISSON_STEPS = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


def bootstrap_mean(df: DataFrame, key: str, value: str, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Confidence interval of the mean by Poisson bootstrap.

    Every row draws its weight in every replicate from a hash, so rows never move: only one sum
    per replicate and task is shuffled.
    """
    # ``stable_unit`` is 13 hex digits over 16 ** 13, which compare like numbers; of the hashed text, what belongs to the
    # row and what belongs to the replicate are made once each
    row, ends = F.concat_ws(":", F.col(key).cast("string"), F.lit("")), F.array(*[F.lit(f"{r}:{seed}") for r in range(1, replicates + 1)])
    digits = F.substring(F.md5(F.concat("_row", "_end")), 1, 13)
    weight = F.lit(len(POISSON_STEPS))
    for k, s in reversed(list(enumerate(POISSON_STEPS))):
        weight = F.when(F.col("_u") < f"{math.ceil(s * 16**13):013x}", F.lit(k)).otherwise(weight)
    drawn = df.filter(F.col(value).isNotNull()).select(row.alias("_row"), F.col(value)).select("*", F.posexplode(ends).alias("_r", "_end"))
    weighed = drawn.withColumn("_u", digits).withColumn("_w", weight)
    means = weighed.groupBy("_r").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("_m"))
    tail = (1 - level) / 2
    # ``replicates`` rows are left
    return means.agg(
        F.avg("_m").alias("mean"), F.expr(f"percentile(_m, {tail})").alias("low"), F.expr(f"percentile(_m, {1 - tail})").alias("high")
    )


def ks_distance(samples: DataFrame, metric: str, value: str, sample: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Largest gap between the distribution functions of sample ``a`` and sample ``b`` per metric.

    ``samples(<metric>, <value>, <sample>)`` with ``sample`` "a" or "b". Values are counted first;
    the running sums are taken inside slices of the value range and carried between them.
    """
    count = lambda s: F.count_if(F.col(sample) == s)
    counts = samples.filter(F.col(value).isNotNull()).groupBy(metric, F.col(value).cast("double").alias("_v")).agg(
        count("a").alias("_a"), count("b").alias("_b")
    )
    sizes = counts.groupBy(metric).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    sliced = chunked(counts, "_v", chunk_rows)
    running = scan_sum(sliced, [metric], "_chunk", ["_v"], F.col("_a"), "_ca")
    running = scan_sum(running, [metric], "_chunk", ["_v"], F.col("_b"), "_cb")
    joined = attach(running, sizes, [metric], how="inner")
    gap = F.abs(F.col("_ca") / F.col("_na") - F.col("_cb") / F.col("_nb"))
    return joined.groupBy(metric).agg(F.max(gap).alias("distance"), F.first("_na").alias("size_a"), F.first("_nb").alias("size_b"))


def online_quality(rows: DataFrame, keys: Sequence[str], undetermined: Column, imputed: dict[str, Column], limits: dict[str, float]) -> DataFrame:
    """Shares per group and the names of those above their limit."""
    shares = {"undetermined": undetermined, **imputed}
    rated = rows.groupBy(*keys).agg(
        *[F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)).alias(f"{name}_rate") for name, c in shares.items()],
        F.count(F.lit(1)).alias("n"),
    )
    over = [F.when(F.col(f"{name}_rate") > limit, F.lit(name)) for name, limit in limits.items()]
    return rated.withColumn("alerts", F.array_compact(F.array(*over)))
