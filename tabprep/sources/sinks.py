"""Exports: normalised rows and blocked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.sources.tables import Sheets


def normalize_export(sheets: Sheets, path: str, fmt: str = "json") -> None:
    """Rows as text with nulls shown as empty strings, one folder per sheet."""
    (
        sheets.rows.withColumn("cells", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))))
        .write.partitionBy("sheet_id")
        .format(fmt)
        .save(path)
    )


def export_metadata(sheets: Sheets, max_rows: int | None = None) -> DataFrame:
    """``(sheet_id, total_rows, truncated)`` to go with an export."""
    counted = sheets.rows.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("total_rows"))
    over = F.col("total_rows") > max_rows if max_rows is not None else F.lit(False)
    return counted.withColumn("truncated", over)


def write_errors(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Blocked rows with their reasons; ``rows(…, status, reasons ARRAY<STRING>)``."""
    blocked = rows.filter(F.col("status") == "ERROR").withColumn("reasons", F.concat_ws("; ", "reasons"))
    writer = blocked.write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
