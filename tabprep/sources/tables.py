"""Bring tables into the sheet model and back.

A sheet corpus is two tables: ``rows(sheet_id, row_idx, cells ARRAY<STRING>)`` and
``headers(sheet_id, col_idx, header)``. One array per row keeps row-wise rules free of shuffles;
``to_cells`` unfolds it where a column-wise view is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprep.session import materialize

HEADERS_DDL = "sheet_id string, col_idx int, header string"


@dataclass(frozen=True)
class Sheets:
    rows: DataFrame
    headers: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession


def as_sheet(df: DataFrame, sheet_id: str | Column, row_idx: str | Column | None = None,
             columns: Sequence[str] | None = None) -> Sheets:
    """View a table as sheet rows: every column cast to string.

    ``row_idx`` is a column giving the source order. Without it rows are numbered in the order they are scanned and stored
    with their numbers, which a later scan might give otherwise.
    """
    columns = list(columns or df.columns)
    name = F.lit(sheet_id) if isinstance(sheet_id, str) else sheet_id
    index = F.monotonically_increasing_id() if row_idx is None else row_idx
    index = F.col(index) if isinstance(index, str) else index
    rows = df.select(
        name.alias("sheet_id"),
        index.cast("long").alias("row_idx"),
        F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"),
    )
    if row_idx is None:
        rows = materialize(rows, "numbered")
    if isinstance(sheet_id, str):
        one = df.sparkSession.range(1)  # stays in the JVM, unlike a list sent from Python
        labels = F.array(*[F.lit(c) for c in columns])
        headers = one.select(name.alias("sheet_id"), F.posexplode(labels).alias("col_idx", "header"))
    else:
        labels = F.array(*[F.lit(c) for c in columns])
        headers = df.select(name.alias("sheet_id")).distinct().select(
            "sheet_id", F.posexplode(labels).alias("col_idx", "header")
        )
    return Sheets(rows, headers)


def union_sheets(sheets: Sequence[Sheets]) -> Sheets:
    return Sheets(
        reduce(DataFrame.unionByName, [s.rows for s in sheets]),
        reduce(DataFrame.unionByName, [s.headers for s in sheets]),
    )


def to_cells(sheets: Sheets | DataFrame) -> DataFrame:
    """One row per cell: ``(sheet_id, row_idx, col_idx, value)``; a narrow transformation."""
    rows = sheets.rows if isinstance(sheets, Sheets) else sheets
    return rows.select("sheet_id", "row_idx", F.posexplode("cells").alias("col_idx", "value"))


def from_cells(cells: DataFrame, headers: DataFrame) -> Sheets:
    """Fold cells into rows; absent cells become null. A row has at most one cell per header."""
    width = headers.groupBy("sheet_id").agg((F.max("col_idx") + 1).alias("_width"))
    folded = cells.groupBy("sheet_id", "row_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("_map")
    )
    from tabprep.operators.scale import attach

    rows = attach(folded, width, ["sheet_id"], how="inner").select(
        "sheet_id",
        "row_idx",
        F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.col("_map")[i]).alias("cells"),
    )
    return Sheets(rows, headers)


def to_wide(sheets: Sheets, sheet_id: str, headers: Sequence[str]) -> DataFrame:
    """One string column per header of a single sheet; ``headers`` are its labels in order."""
    return sheets.rows.filter(F.col("sheet_id") == sheet_id).select(
        "row_idx", *[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(headers)]
    )


def select_sheets(sheets: Sheets, names: Sequence[str] | None) -> Sheets:
    if not names:
        return sheets
    keep = F.col("sheet_id").isin(list(names))
    return Sheets(sheets.rows.filter(keep), sheets.headers.filter(keep))


def missing_sheets(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested sheet names that no source provides, sorted."""
    return (
        requested.select("sheet_id").distinct()
        .join(available.select("sheet_id").distinct(), "sheet_id", "left_anti")
        .orderBy("sheet_id")
    )


def require_sheets(sheets: Sheets, names: Sequence[str]) -> Sheets:
    """``select_sheets`` that fails on unknown names and on an empty result."""
    spark = sheets.spark
    wanted = spark.createDataFrame([(n,) for n in names], "sheet_id string")
    absent = [r.sheet_id for r in missing_sheets(wanted, sheets.headers).collect()] if names else []
    if absent:
        raise ValueError("Sheet(s) not found: " + ", ".join(absent))
    chosen = select_sheets(sheets, names)
    if chosen.headers.isEmpty():
        raise ValueError("No sheets found in workbook")
    return chosen


def cap_rows(sheets: Sheets, max_rows: int) -> tuple[Sheets, DataFrame]:
    """Keep the first ``max_rows`` of each sheet and report which sheets were longer.

    This is a preview feature; nothing else in the library caps rows.
    """
    from tabprep.operators.scale import first_rows

    first = first_rows(sheets.rows, max_rows).drop("preview_idx")
    report = sheets.rows.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("source_rows"))
    report = report.withColumn("truncated", F.col("source_rows") > max_rows)
    return Sheets(first, sheets.headers), report


def preview_rows(sheets: Sheets, n: int = 50) -> DataFrame:
    """First ``n`` rows of every sheet, nulls shown as empty text."""
    from tabprep.operators.scale import first_rows

    shown = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    return first_rows(sheets.rows, n).withColumn("cells", shown)


def sheet_summary(sheets: Sheets, sample_rows: int = 50, max_rows: int | None = None) -> DataFrame:
    """Per sheet: rows, sample size, number of columns, truncated flag from the source row count."""
    counted = sheets.rows.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("total_rows"))
    columns = sheets.headers.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("columns"))
    limit = F.lit(max_rows) if max_rows is not None else F.lit(None).cast("long")
    return columns.join(counted, "sheet_id", "left").select(
        "sheet_id",
        "columns",
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.least(F.coalesce("total_rows", F.lit(0)), F.lit(sample_rows)).alias("sample_row_count"),
        F.coalesce(F.col("total_rows") > limit, F.lit(False)).alias("truncated"),
    )


def workbook_summary(sheet_rows: DataFrame) -> DataFrame:
    """From ``(workbook_id, sheet_id, total_rows)``: number of sheets and estimated rows."""
    return sheet_rows.groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("total_sheets"), F.sum("total_rows").alias("total_rows_estimate")
    )


def navigation(sheets: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Current, previous and next sheet per workbook.

    ``sheets(workbook_id, sheet_ord, sheet_id)``; ``requested(workbook_id, sheet_id)`` names the
    current sheet, an unknown or absent request means the first one.
    """
    order = Window.partitionBy("workbook_id").orderBy("sheet_ord")
    linked = sheets.select(
        "workbook_id",
        "sheet_ord",
        "sheet_id",
        F.lag("sheet_id").over(order).alias("previous"),
        F.lead("sheet_id").over(order).alias("next"),
    )
    if requested is None:
        linked = linked.withColumn("_hit", F.lit(False))
    else:
        wanted = requested.select("workbook_id", "sheet_id", F.lit(True).alias("_hit"))
        linked = linked.join(wanted, ["workbook_id", "sheet_id"], "left")
    rank = F.struct(F.when(F.col("_hit"), 0).otherwise(1), F.col("sheet_ord"))
    pick = F.min_by(F.struct("sheet_id", "previous", "next"), rank)
    return linked.groupBy("workbook_id").agg(pick.alias("_s"), F.count(F.lit(1)).alias("available")).select(
        "workbook_id", F.col("_s.sheet_id").alias("current"), "_s.previous", "_s.next", "available"
    )
