"""Mode imputation, one-hot, ordinal and hashed encoding, and the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.operators.numeric import numeric_parameters, prepare_numbers
from tabprep.operators.profile import COLUMN
from tabprep.operators.scale import attach, positions
from tabprep.session import materialize


#: Categories with more characters than this are named, and joined on, by their MD5.
NAMED_CHARS = 64


def category_key(category: Column) -> Column:
    """The category itself, or a digest of it if it is long: whole texts are neither moved nor made names."""
    return F.when(F.length(category) > NAMED_CHARS, F.concat(F.lit("md5:"), F.md5(category))).otherwise(category)


def modes(histogram: DataFrame, value: str = "text") -> DataFrame:
    """Most frequent value per column, ties to the smallest; ``histogram`` has a weight ``n``."""
    counts = histogram.filter(F.col(value).isNotNull()).groupBy(*COLUMN, value).agg(F.sum("n").alias("_c"))
    return counts.groupBy(*COLUMN).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias("mode"))


def impute_mode(cells: DataFrame, mode: DataFrame, value: str = "text") -> DataFrame:
    return attach(cells, mode, COLUMN).withColumn(value, F.coalesce(value, "mode")).drop("mode")


def vocabulary(histogram: DataFrame, value: str = "text") -> DataFrame:
    """Sorted distinct values of each column with their 0-based place; any cardinality."""
    distinct = histogram.filter(F.col(value).isNotNull()).select(*COLUMN, F.col(value).alias("category")).distinct()
    return positions(distinct, COLUMN, ["category"])


def one_hot(cells: DataFrame, vocab: DataFrame, value: str = "text") -> DataFrame:
    """Sparse one-hot with the first category dropped: ``(…, category, place)``, one row per hit.

    A value outside the vocabulary, or the dropped first one, gives no row, i.e. all zeros.
    """
    known = vocab.filter(F.col("pos") > 0).withColumnRenamed("category", value)
    return attach(cells, known, [*COLUMN, value], how="inner").withColumn("place", F.col("pos") - 1).drop("pos")


def one_hot_columns(df: DataFrame, column: str, categories: Sequence[str]) -> list[Column]:
    """Dense indicator columns for a short known list; the first sorted category is dropped."""
    return [
        F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0)).alias(f"{column}_{c}")
        for c in sorted(categories)[1:]
    ]


def ordinal_encode(value: Column, order: Sequence[str]) -> Column:
    """0-based place of ``value`` in the given order, null if absent."""
    pairs = [x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), value)


def hash_encode(value: Column, buckets: int) -> Column:
    """Bucket of a category by 60 bits of its MD5, the same in any engine."""
    return (F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def feature_names(types: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(sheet_id, col_idx, category, feature_idx, name)``: numeric block, then categorical block.

    ``category`` is the ``category_key`` of the value.
    """
    sizes = vocab.groupBy(*COLUMN).agg((F.max("pos")).alias("_width"))
    blocks = types.join(sizes, COLUMN, "left").withColumn(
        "_width", F.when(F.col("kind") == "categorical", F.coalesce("_width", F.lit(0))).otherwise(F.lit(1))
    )
    order = Window.partitionBy("sheet_id").orderBy(F.col("kind") == "categorical", "col_idx")
    starts = blocks.withColumn(
        "start", F.coalesce(F.sum("_width").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    starts = materialize(starts.select(*COLUMN, "header", "kind", "start"), "starts")
    numeric = starts.filter("kind <> 'categorical'").select(
        *COLUMN,
        F.lit(None).cast("string").alias("category"),
        F.col("start").alias("feature_idx"),
        F.concat(F.lit("numeric__"), "header").alias("name"),
    )
    hot = attach(vocab.filter("pos > 0"), starts, COLUMN, how="inner", stored=True).select(
        *COLUMN,
        category_key(F.col("category")).alias("category"),
        (F.col("start") + F.col("pos") - 1).alias("feature_idx"),
        F.concat(F.lit("categorical__"), "header", F.lit("_"), category_key(F.col("category"))).alias("name"),
    )
    return numeric.unionByName(hot)


def feature_matrix(cells: DataFrame, typed_histogram: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sparse matrix ``(sheet_id, row_idx, feature_idx, value)`` and its feature names.

    Zeros of the one-hot block are not stored, so a column with millions of categories costs one
    entry per row. Parameters are one row per column; the cells are only joined, never regrouped.
    """
    histogram = materialize(typed_histogram, "typed")
    kinds = F.col("kind") == "categorical"
    parameters = numeric_parameters(histogram.filter(~kinds), weight="n")
    mode = materialize(modes(histogram.filter(kinds)), "modes")
    vocab = materialize(vocabulary(histogram.filter(kinds)), "vocab")
    names = materialize(feature_names(types, vocab), "names")
    numbers = prepare_numbers(cells.filter(~kinds).select("sheet_id", "row_idx", "col_idx", "number"), parameters)
    places = names.select(*COLUMN, "category", "feature_idx")
    block = attach(numbers, places.filter("category is null").drop("category"), COLUMN, how="inner").select(
        "sheet_id", "row_idx", "feature_idx", "value"
    )
    filled = attach(
        cells.filter(kinds).select("sheet_id", "row_idx", "col_idx", "text"), mode, COLUMN, stored=True
    ).select("sheet_id", "row_idx", "col_idx", category_key(F.coalesce("text", "mode")).alias("category"))
    hot = attach(filled, places.filter("category is not null"), [*COLUMN, "category"], how="inner").select(
        "sheet_id", "row_idx", "feature_idx", F.lit(1.0).alias("value")
    )
    return block.unionByName(hot), names


def dense_preview(matrix: DataFrame, names: DataFrame, head: DataFrame) -> DataFrame:
    """Dense vectors of the few rows in ``head(sheet_id, row_idx, preview_idx)``, for display only."""
    widths = names.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("dims"))
    shown = materialize(head.join(widths, "sheet_id"), "head")
    entries = attach(matrix, shown, ["sheet_id", "row_idx"], how="inner", stored=True)
    packed = entries.groupBy("sheet_id", "row_idx", "preview_idx", "dims").agg(
        F.map_from_entries(F.collect_list(F.struct("feature_idx", "value"))).alias("_m")
    )
    dense = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("dims") - 1), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))
    )
    return packed.select("sheet_id", "preview_idx", dense.alias("features"))
