"""Column profiles, types and typed values; texts are counted by digest and moved only where their value is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.parse import as_boolean_text, as_day, as_epoch, as_number, is_boolean
from tabprep.operators.scale import attach
from tabprep.session import materialize
from tabprep.sources.tables import Sheets, to_cells

COLUMN = ["sheet_id", "col_idx"]


def value_histogram(sheets: Sheets) -> DataFrame:
    """``(sheet_id, col_idx, value, n)``. The value is part of the key, so a long column spreads."""
    return to_cells(sheets).groupBy(*COLUMN, "value").agg(F.count(F.lit(1)).alias("n"))


def value_marks(sheets: Sheets, day_first: bool = True) -> DataFrame:
    """Number of cells per column and distinct value, told by 128 bits of hash, with what the value parses as.

    Fixed-width keys move, not texts. ``filled`` is null for blank cells.
    """
    value = F.col("value")
    parsed = to_cells(sheets).select(
        *COLUMN,
        F.xxhash64(value).alias("_h1"),
        F.xxhash64(F.lit(1), value, F.length(value)).alias("_h2"),
        F.when(value.isNotNull(), True).alias("filled"),
        as_number(value).isNotNull().alias("numeric"),
        as_day(value, day_first).isNotNull().alias("dates"),
        F.coalesce(is_boolean(value), F.lit(False)).alias("booleans"),
    )
    return parsed.groupBy(*COLUMN, "_h1", "_h2", "filled", "numeric", "dates", "booleans").agg(F.count(F.lit(1)).alias("n"))


def histogram_marks(histogram: DataFrame, day_first: bool = True) -> DataFrame:
    """``value_marks`` of a stored histogram."""
    value = F.col("value")
    return histogram.select(
        *COLUMN, "n",
        F.when(value.isNotNull(), True).alias("filled"),
        as_number(value).isNotNull().alias("numeric"),
        as_day(value, day_first).isNotNull().alias("dates"),
        F.coalesce(is_boolean(value), F.lit(False)).alias("booleans"),
    )


def column_counts(marks: DataFrame) -> DataFrame:
    """Per column: rows, filled, numeric, date, boolean and distinct counts, from ``value_marks``."""
    weigh = lambda hit: F.sum(F.when(F.col(hit), F.col("n")).otherwise(F.lit(0))).alias(hit)
    return marks.groupBy(*COLUMN).agg(
        F.sum("n").alias("rows"),
        *[weigh(c) for c in ("filled", "numeric", "dates", "booleans")],
        F.count("filled").alias("distinct_values"),
    )


def column_counts_approx(sheets: Sheets, rsd: float = 0.02, day_first: bool = True) -> DataFrame:
    """As ``column_counts`` in a single pass with an approximate distinct count: cells never move."""
    value = F.col("value")
    return to_cells(sheets).groupBy(*COLUMN).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("filled"),
        F.count_if(as_number(value).isNotNull()).alias("numeric"),
        F.count_if(as_day(value, day_first).isNotNull()).alias("dates"),
        F.count_if(F.coalesce(is_boolean(value), F.lit(False))).alias("booleans"),
        F.approx_count_distinct("value", rsd).alias("distinct_values"),
    )


def profile(headers: DataFrame, counts: DataFrame) -> DataFrame:
    """Pattern ratios over filled cells; an empty column has 0.0 everywhere."""
    over_filled = lambda c: F.when(F.col("filled") > 0, F.col(c) / F.col("filled")).otherwise(0.0)
    return headers.join(counts, COLUMN, "left").select(
        *COLUMN,
        "header",
        over_filled("numeric").alias("numeric_ratio"),
        over_filled("dates").alias("date_ratio"),
        over_filled("booleans").alias("boolean_ratio"),
        over_filled("distinct_values").alias("unique_ratio"),
    )


def infer_types(headers: DataFrame, counts: DataFrame) -> DataFrame:
    """``kind`` (date, numeric, categorical) and ``boolean_like`` from shares of all rows."""
    share = lambda c: F.coalesce(F.col(c) / F.col("rows"), F.lit(0.0))
    numeric, dates, booleans = share("numeric"), share("dates"), share("booleans")
    kind = (
        F.when((dates > 0.55) & (numeric < 0.5), "date")
        .when((numeric > 0.55) | ((numeric > 0.35) & (F.col("distinct_values") > 3)), "numeric")
        .otherwise("categorical")
    )
    return headers.join(counts, COLUMN, "left").select(
        *COLUMN, "header", kind.alias("kind"), ((kind == "categorical") & (booleans > 0.65)).alias("boolean_like")
    )


def coerce(cells: DataFrame, types: DataFrame, day_first: bool = True) -> DataFrame:
    """Typed cells: ``number`` for numeric and date columns, ``text`` for categorical ones."""
    typed = attach(cells, types.select(*COLUMN, "kind", "boolean_like"), COLUMN, how="inner")
    return typed.select(
        "sheet_id", "row_idx", "col_idx", "kind", *typed_value(F.col("value"), day_first)
    )


def coerce_histogram(histogram: DataFrame, types: DataFrame, day_first: bool = True) -> DataFrame:
    """``coerce`` on distinct values, weight ``n`` kept."""
    typed = attach(histogram, types.select(*COLUMN, "kind", "boolean_like"), COLUMN, how="inner")
    return typed.select(*COLUMN, "kind", "n", *typed_value(F.col("value"), day_first))


def typed_value(value: Column, day_first: bool = True) -> list[Column]:
    number = F.when(F.col("kind") == "date", as_epoch(value, day_first)).when(
        F.col("kind") == "numeric", as_number(value)
    )
    text = F.when(
        F.col("kind") == "categorical", F.when(F.col("boolean_like"), as_boolean_text(value)).otherwise(value)
    )
    return [number.alias("number"), text.alias("text")]


def missingness(headers: DataFrame, typed_histogram: DataFrame) -> DataFrame:
    """Share of null cells after coercion, so unparsable numbers and dates count."""
    gone = F.col("number").isNull() & F.col("text").isNull()
    shares = typed_histogram.groupBy(*COLUMN).agg(
        (F.sum(F.when(gone, F.col("n")).otherwise(F.lit(0))) / F.sum("n")).alias("missingness")
    )
    return headers.join(shares, COLUMN, "left").select(*COLUMN, "header", "missingness")


def top_missing(missing: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` emptiest columns of each sheet, ties in column order."""
    order = Window.partitionBy("sheet_id").orderBy(F.desc("missingness"), "col_idx")
    return missing.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def stored_histogram(sheets: Sheets) -> DataFrame:
    return materialize(value_histogram(sheets), "histogram")
