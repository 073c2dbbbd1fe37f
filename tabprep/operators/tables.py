"""Merged cells, hierarchies, canonical schema, structural features and mixed formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.operators.scale import CHUNK_ROWS, attach, chunked, scan_last
from tabprep.sources.tables import Sheets


def fill_merged(cells: DataFrame, axis: str = "rows", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Give the cells of merged ranges the value shown for the range.

    ``cells(sheet_id, row_idx, col_idx, value, merged)``; ``axis="rows"`` fills downwards within a
    column, ``"columns"`` to the right within a row. Cells outside merged ranges stay as they are.
    """
    if axis == "columns":
        # a row holds at most 16,384 cells
        right = Window.partitionBy("sheet_id", "row_idx").orderBy("col_idx")
        shown = cells.withColumn("_shown", F.last("value", ignorenulls=True).over(right))
    else:
        shown = scan_last(chunked(cells, "row_idx", chunk_rows), ["sheet_id", "col_idx"], "_chunk", ["row_idx"], F.col("value"), "_shown").drop("_chunk")
    return shown.withColumn("value", F.coalesce("value", F.when(F.col("merged"), F.col("_shown")))).drop("_shown")


def flatten_levels(rows: DataFrame, levels: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Repeat every level label downwards until it, or a higher level, changes.

    ``rows(sheet_id, row_idx, <levels>, …)``: one column per level, outermost first.
    """
    out = chunked(rows, "row_idx", chunk_rows)
    for i, level in enumerate(levels):
        mark = F.when(F.col(level).isNotNull(), F.struct(F.col("row_idx").alias("at"), F.col(level).alias("label")))
        out = scan_last(out, ["sheet_id"], "_chunk", ["row_idx"], mark, f"_l{i}")
    for i, level in enumerate(levels):
        higher = [F.coalesce(F.col(f"_l{j}.at"), F.lit(-1)) for j in range(i)]
        newest = F.lit(-1) if not higher else higher[0] if len(higher) == 1 else F.greatest(*higher)
        out = out.withColumn(level, F.when(F.col(f"_l{i}.at") >= newest, F.col(f"_l{i}.label")))
    return out.drop("_chunk", *[f"_l{i}" for i in range(len(levels))])


def header_dictionary(headers: DataFrame) -> DataFrame:
    """Every header of the corpus with the number of sheets that have it."""
    return headers.groupBy("header").agg(F.countDistinct("sheet_id").alias("sheets"))


def canonical_rows(sheets: Sheets, columns: Sequence[str]) -> DataFrame:
    """All sheets as one table with the given columns; a column a sheet lacks is null."""
    labels = sheets.headers.groupBy("sheet_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda s: s["header"]).alias("_labels")
    )
    rows = attach(sheets.rows, labels, ["sheet_id"], how="inner")
    place = lambda h: F.array_position("_labels", h)
    return rows.select(
        "sheet_id",
        "row_idx",
        *[F.when(place(h) > 0, F.get("cells", (place(h) - 1).cast("int"))).alias(h) for h in columns],
    )


def structural_features(rows: DataFrame, is_subtotal: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Position features of each row of ``rows(sheet_id, row_idx, table_start, cells, …)``.

    Relative row, distance to the header row and to the nearest subtotal above, filled share.
    """
    ends = rows.groupBy("sheet_id").agg(F.max("row_idx").alias("_last"))
    placed = attach(chunked(rows, "row_idx", chunk_rows), ends, ["sheet_id"])
    seen = scan_last(placed, ["sheet_id"], "_chunk", ["row_idx"], F.when(is_subtotal, F.col("row_idx")), "_subtotal")
    filled = F.size(F.filter("cells", lambda c: c.isNotNull()))
    return seen.select(
        *rows.columns,
        F.when(F.col("_last") > 0, F.col("row_idx") / F.col("_last")).otherwise(0.0).alias("row_rel"),
        (F.col("row_idx") - F.col("table_start")).alias("dist_to_header"),
        (F.col("row_idx") - F.col("_subtotal")).alias("dist_to_subtotal"),
        (filled / F.size("cells")).alias("filled_share"),
        F.xxhash64("sheet_id").alias("sheet_name_hash"),
    )


# Fixed patterns: money with a currency mark, decimal comma, date written as text.
DECIMAL_COMMA = r"^[+-]?\d{1,3}(\.\d{3})*,\d+$|^[+-]?\d+,\d+$"
CURRENCIES = {"USD": r"^(US\$|\$|USD)\s*[\d.,]+$", "EUR": r"^€\s*[\d.,]+$|^[\d.,]+\s*(€|EUR)$", "CLP": r"^CLP\s*[\d.,]+$"}
TEXT_DATE = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$|^\d{4}-\d{1,2}-\d{1,2}$"


def format_class(value: Column) -> Column:
    """date-text, money:<currency>, decimal-comma, number or text."""
    out = F.when(value.rlike(TEXT_DATE), "date-text")
    for name, pattern in CURRENCIES.items():
        out = out.when(value.rlike(pattern), f"money:{name}")
    return out.when(value.rlike(DECIMAL_COMMA), "decimal-comma").when(value.rlike(r"^[+-]?\d+(\.\d+)?$"), "number").otherwise("text")


def cell_features(cells: DataFrame) -> DataFrame:
    """Position and style features of decoded cells, as ``read_workbooks`` returns them.

    ``row_rel`` and ``col_rel`` are shares of the sheet's last row and column; the fill colour is hashed.
    """
    found = cells.filter(F.col("row_idx").isNotNull())
    ends = found.groupBy("path", "sheet").agg(F.max("row_idx").alias("_rows"), F.max("col_idx").alias("_cols"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return attach(found, ends, ["path", "sheet"]).select(
        "path", "sheet", "row_idx", "col_idx",
        share("row_idx", "_rows").alias("row_rel"), share("col_idx", "_cols").alias("col_rel"),
        F.coalesce("bold", F.lit(False)).alias("style_bold"), F.xxhash64("fill").alias("style_fill_hash"),
        F.coalesce("bordered", F.lit(False)).alias("style_border"), F.coalesce("number_family", F.lit("general")).alias("num_format_family"),
        F.xxhash64("sheet").alias("sheet_name_hash"), F.xxhash64("path").alias("file_id"),
    )


def mixed_formats(histogram: DataFrame) -> DataFrame:
    """Share of each format class per column and whether the column mixes currencies or decimals."""
    classes = histogram.filter(F.col("value").isNotNull()).withColumn("format", format_class(F.col("value"))).groupBy(
        "sheet_id", "col_idx", "format"
    ).agg(F.sum("n").alias("n"))
    column = Window.partitionBy("sheet_id", "col_idx")
    money = F.sum(F.col("format").startswith("money:").cast("int")).over(column)
    commas = F.max((F.col("format") == "decimal-comma").cast("int")).over(column)
    points = F.max((F.col("format") == "number").cast("int")).over(column)
    return classes.select(
        "sheet_id", "col_idx", "format", (F.col("n") / F.sum("n").over(column)).alias("share"),
        ((money > 1) | ((commas == 1) & (points == 1))).alias("mixed"),
    )


def normalize_decimal_comma(value: Column) -> Column:
    """``1.234,56`` becomes ``1234.56``; other text is untouched."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\.", ""), ",", ".")
    return F.when(value.rlike(DECIMAL_COMMA), plain).otherwise(value)
