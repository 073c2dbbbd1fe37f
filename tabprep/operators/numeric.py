"""Outlier bounds, capping, imputation and scaling of numeric columns.

``numbers(sheet_id, row_idx, col_idx, number)`` carries one row per numeric cell, nulls included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.operators.profile import COLUMN
from tabprep.operators.quantiles import linear, order_statistics
from tabprep.operators.scale import attach
from tabprep.session import materialize

# Fixed value: reach of the whiskers in interquartile ranges.
WHISKER = 1.5


def clip(x: Column, lower: Column, upper: Column) -> Column:
    """Clamp to the bounds; a null stays null (``least``/``greatest`` would turn it into a bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lower), upper))


def iqr_bounds(numbers: DataFrame, weight: str | None = None) -> DataFrame:
    """Exact ``q1, q3, lower, upper`` per column, and ``median`` of the values capped to the bounds.

    Capping keeps the order of values, so the capped median follows from the uncapped neighbours.
    """
    stats = order_statistics(numbers, COLUMN, "number", [0.25, 0.5, 0.75], weight)
    at = lambda p, c: F.max(F.when(F.col("prob") == p, F.col(c)))
    flat = stats.groupBy(*COLUMN).agg(
        *[at(p, c).alias(f"{c}_{i}") for i, p in enumerate([0.25, 0.5, 0.75]) for c in ("low", "high", "fraction")]
    )
    q = lambda i: linear(F.col(f"low_{i}"), F.col(f"high_{i}"), F.col(f"fraction_{i}"))
    quartiles = flat.withColumn("q1", q(0)).withColumn("q3", q(2))
    spread = F.col("q3") - F.col("q1")
    bounded = quartiles.withColumn("lower", F.col("q1") - WHISKER * spread).withColumn(
        "upper", F.col("q3") + WHISKER * spread
    )
    capped = lambda c: clip(F.col(c), F.col("lower"), F.col("upper"))
    return bounded.select(
        *COLUMN, "q1", "q3", "lower", "upper", linear(capped("low_1"), capped("high_1"), F.col("fraction_1")).alias("median")
    )


def iqr_cap(numbers: DataFrame, bounds: DataFrame) -> DataFrame:
    """Winsorise; the big side is not shuffled."""
    joined = attach(numbers, bounds.select(*COLUMN, "lower", "upper"), COLUMN, stored=False)
    return joined.withColumn("number", clip(F.col("number"), F.col("lower"), F.col("upper"))).drop("lower", "upper")


def outlier_summary(numbers: DataFrame, bounds: DataFrame, weight: str | None = None) -> DataFrame:
    """Bounds and how many present values lie outside them."""
    joined = attach(numbers, bounds.select(*COLUMN, "lower", "upper"), COLUMN, how="inner")
    outside = (F.col("number") < F.col("lower")) | (F.col("number") > F.col("upper"))
    w = F.col(weight) if weight else F.lit(1)
    counted = joined.groupBy(*COLUMN).agg(F.sum(F.when(outside, w).otherwise(F.lit(0))).alias("capped_values"))
    return bounds.join(counted, COLUMN).select(
        *COLUMN, F.col("lower").alias("lower_cap"), F.col("upper").alias("upper_cap"), "capped_values"
    )


def moments(numbers: DataFrame, bounds: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean and population deviation of the capped, median-imputed column."""
    joined = attach(numbers, bounds.select(*COLUMN, "lower", "upper", "median"), COLUMN, how="inner")
    w = (F.col(weight) if weight else F.lit(1)).cast("double")
    filled = joined.select(
        *COLUMN,
        w.alias("_w"),
        F.coalesce(clip(F.col("number"), F.col("lower"), F.col("upper")), F.col("median")).alias("_x"),
        F.col("median").alias("_m"),
    )
    # sums are taken around the median, which keeps the squares small
    off = F.col("_x") - F.col("_m")
    sums = filled.groupBy(*COLUMN).agg(
        F.sum("_w").alias("_n"),
        F.sum(F.col("_w") * off).alias("_s"),
        F.sum(F.col("_w") * off * off).alias("_ss"),
        F.first("_m").alias("_m"),
    )
    shift = F.col("_s") / F.col("_n")
    variance = F.greatest(F.col("_ss") / F.col("_n") - shift * shift, F.lit(0.0))
    return sums.select(*COLUMN, (F.col("_m") + shift).alias("mean"), F.sqrt(variance).alias("deviation"))


def numeric_parameters(numbers: DataFrame, weight: str | None = None) -> DataFrame:
    """Everything a numeric column needs: bounds, median, mean, deviation. One row per column."""
    bounds = materialize(iqr_bounds(numbers, weight), "bounds")
    return materialize(bounds.join(moments(numbers, bounds, weight), COLUMN), "numeric")


def zscore(x: Column) -> Column:
    """Standard score of ``x`` with columns ``mean`` and ``deviation``; a constant column gives 0."""
    return (x - F.col("mean")) / F.when(F.col("deviation") == 0, F.lit(1.0)).otherwise(F.col("deviation"))


def prepare_numbers(numbers: DataFrame, parameters: DataFrame) -> DataFrame:
    """Cap, impute with the median and standardise each numeric cell."""
    joined = attach(numbers, parameters, COLUMN, how="inner", stored=True)
    imputed = F.coalesce(clip(F.col("number"), F.col("lower"), F.col("upper")), F.col("median"))
    return joined.select("sheet_id", "row_idx", "col_idx", zscore(imputed).alias("value"))


def minmax(numbers: DataFrame) -> DataFrame:
    """Rescale every column to [0, 1]; a constant column becomes 0."""
    edges = numbers.groupBy(*COLUMN).agg(F.min("number").alias("_lo"), F.max("number").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(F.col("number").isNotNull(), F.when(span == 0, F.lit(0.0)).otherwise((F.col("number") - F.col("_lo")) / span))
    return attach(numbers, edges, COLUMN).withColumn("number", scaled).drop("_lo", "_hi")


def impute_mean(numbers: DataFrame) -> DataFrame:
    means = numbers.groupBy(*COLUMN).agg(F.avg("number").alias("_mean"))
    return attach(numbers, means, COLUMN).withColumn("number", F.coalesce("number", "_mean")).drop("_mean")


def impute_median(numbers: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cap, then fill nulls with the capped median."""
    joined = attach(numbers, bounds.select(*COLUMN, "lower", "upper", "median"), COLUMN)
    filled = F.coalesce(clip(F.col("number"), F.col("lower"), F.col("upper")), F.col("median"))
    return joined.withColumn("number", filled).drop("lower", "upper", "median")
