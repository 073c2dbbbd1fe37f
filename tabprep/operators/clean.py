"""Header, cell, column and row cleaning of a whole corpus of sheets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.text import clean_cell, strip
from tabprep.operators.scale import attach
from tabprep.session import materialize
from tabprep.sources.tables import Sheets, to_cells

# Least share of filled cells for a column and for a row.
MIN_COLUMN_COVERAGE = 0.12
MIN_ROW_SIGNAL = 0.18


def normalize_headers(headers: DataFrame) -> DataFrame:
    """Trim labels, name blanks ``col_{i+1}`` and number repeats ``label__k`` by position.

    A sheet has at most 16,384 columns, so its header row is a bounded group. The fold renumbers
    until the label is free, also when a repeat meets a literal ``label__k``.
    """
    label = strip(F.coalesce("header", F.lit("")))
    named = headers.select(
        "sheet_id",
        "col_idx",
        F.when(label == "", F.concat(F.lit("col_"), F.col("col_idx") + 1)).otherwise(label).alias("label"),
    )
    repeat = Window.partitionBy("sheet_id", "label").orderBy("col_idx")
    first = named.withColumn("_k", F.row_number().over(repeat) - 1)
    renamed = first.withColumn(
        "header", F.when(F.col("_k") == 0, F.col("label")).otherwise(F.concat_ws("__", "label", "_k"))
    )
    clash = Window.partitionBy("sheet_id", "header")
    checked = renamed.withColumn(
        "_clash", (F.count(F.lit(1)).over(clash) > 1).cast("int")
    ).withColumn("_any", F.max("_clash").over(Window.partitionBy("sheet_id")))
    simple = checked.filter("_any = 0").select("sheet_id", "col_idx", "header")
    return simple.unionByName(_renumber(checked.filter("_any = 1")))


def _renumber(clashing: DataFrame) -> DataFrame:
    """Rebuild the header rows in which a generated name meets a literal one."""
    ordered = F.array_sort(F.collect_list(F.struct("col_idx", "label")))

    def place(taken, item):
        free = lambda k: F.concat_ws("__", item["label"], k.cast("string"))
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), free)
        open_names = F.filter(tries, lambda name: ~F.array_contains(taken, name))
        name = F.when(~F.array_contains(taken, item["label"]), item["label"]).otherwise(F.get(open_names, F.lit(0)))
        return F.concat(taken, F.array(name))

    start = F.array().cast("array<string>")
    grouped = clashing.groupBy("sheet_id").agg(ordered.alias("cols"))
    named = grouped.select("sheet_id", "cols", F.aggregate("cols", start, place).alias("names"))
    return named.select("sheet_id", F.explode(F.arrays_zip("cols", "names")).alias("p")).select(
        "sheet_id", F.col("p.cols.col_idx").alias("col_idx"), F.col("p.names").alias("header")
    )


def strip_cells(sheets: Sheets) -> Sheets:
    """Strip every cell and turn blanks into nulls."""
    return Sheets(sheets.rows.withColumn("cells", F.transform("cells", clean_cell)), sheets.headers)


def coverage(sheets: Sheets) -> DataFrame:
    """Share of filled cells per column, ``(sheet_id, col_idx, header, n, filled, coverage)``.

    One row per column leaves a task, however the gaps lie.
    """
    return _coverage(sheets.headers, to_cells(sheets).select("sheet_id", "col_idx", F.col("value").isNotNull().alias("mark")))


def _coverage(headers: DataFrame, marks: DataFrame) -> DataFrame:
    counts = marks.groupBy("sheet_id", "col_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("mark").alias("filled"))
    return headers.join(counts, ["sheet_id", "col_idx"], "left").select(
        "sheet_id",
        "col_idx",
        "header",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("filled", F.lit(0)).alias("filled"),
        (F.col("filled") / F.col("n")).alias("coverage"),
    )


def kept_columns(covered: DataFrame, min_coverage: float = MIN_COLUMN_COVERAGE) -> DataFrame:
    """Per sheet the positions of surviving columns; all of them if none reaches the bound."""
    everything = F.array_sort(F.collect_list("col_idx"))
    dense = F.array_sort(F.collect_list(F.when(F.col("coverage") >= min_coverage, F.col("col_idx"))))
    return covered.groupBy("sheet_id").agg(everything.alias("_all"), dense.alias("_dense")).select(
        "sheet_id",
        F.when(F.size("_dense") > 0, F.col("_dense")).otherwise(F.col("_all")).alias("kept"),
        F.size("_all").alias("source_columns"),
    )


def prune_columns(sheets: Sheets, kept: DataFrame, tidy: Callable[[Column], Column] = lambda cell: cell) -> Sheets:
    """Kept columns only, each of their cells passed through ``tidy``."""
    rows = attach(sheets.rows, kept.select("sheet_id", "kept"), ["sheet_id"], how="inner", stored=True)
    rows = rows.select(
        "sheet_id", "row_idx", F.transform("kept", lambda i: tidy(F.get(F.col("cells"), i))).alias("cells")
    )
    places = kept.select("sheet_id", F.posexplode("kept").alias("pos", "col_idx"))
    headers = sheets.headers.join(places, ["sheet_id", "col_idx"]).select(
        "sheet_id", F.col("pos").alias("col_idx"), "header"
    )
    return Sheets(rows, headers)


def row_signal():
    """Share of filled cells of a row."""
    return F.size(F.filter("cells", lambda c: c.isNotNull())) / F.size("cells")


def prune_rows(sheets: Sheets, min_signal: float = MIN_ROW_SIGNAL) -> Sheets:
    return Sheets(sheets.rows.filter(row_signal() >= min_signal), sheets.headers)


@dataclass(frozen=True)
class CleanResult:
    sheets: Sheets
    coverage: DataFrame
    report: DataFrame


def clean(
    sheets: Sheets,
    min_coverage: float = MIN_COLUMN_COVERAGE,
    min_signal: float = MIN_ROW_SIGNAL,
) -> CleanResult:
    """Headers, cells, columns and rows in one go.

    Rows are read once for the coverage, cell by cell, and once more to drop columns, when only cells that stay are
    stripped; the outcome is stored with the verdict on each row, so whatever follows reads clean rows. They are never shuffled.
    """
    raw = Sheets(sheets.rows, normalize_headers(sheets.headers))
    marks = to_cells(raw).select("sheet_id", "col_idx", clean_cell(F.col("value")).isNotNull().alias("mark"))
    covered = materialize(_coverage(raw.headers, marks), "coverage")
    kept = materialize(kept_columns(covered, min_coverage), "kept")
    pruned = prune_columns(raw, kept, clean_cell)
    judged = materialize(pruned.rows.withColumn("_dense", F.coalesce(row_signal() >= min_signal, F.lit(False))), "cleaned")
    cleaned = Sheets(judged.filter("_dense").drop("_dense"), materialize(pruned.headers, "headers"))
    drops = judged.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("source_rows"), F.count_if("_dense").alias("total_rows"))
    report = kept.join(drops, "sheet_id", "left").select(
        "sheet_id",
        F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce(F.col("source_rows") - F.col("total_rows"), F.lit(0)).alias("dropped_rows"),
        (F.col("source_columns") - F.size("kept")).alias("dropped_columns"),
    )
    return CleanResult(cleaned, covered, report)


def renumber_rows(sheets: Sheets) -> Sheets:
    """Give the rows of each sheet the gapless positions 0, 1, 2, … in source order."""
    from tabprep.operators.scale import positions

    rows = positions(sheets.rows, ["sheet_id"], ["row_idx"]).select(
        "sheet_id", F.col("pos").alias("row_idx"), "cells"
    )
    return Sheets(rows, sheets.headers)
