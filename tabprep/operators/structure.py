"""Tables, anchors, formulas, formats and fingerprints of sheets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.operators.scale import CHUNK_ROWS, attach, chunked, positions, scan_last
from tabprep.session import materialize
from tabprep.sources.tables import Sheets


#: Characters of a fingerprint that are kept as text, and what stands between its parts.
LONGEST_PRINT, _SEPARATOR = 8192, "::"


def column_letters(col_idx: Column) -> Column:
    """Spreadsheet letters of a 0-based column, up to three of them (18,278 columns); more is an error."""
    n = col_idx.cast("int") + 1
    letter = lambda x: F.chr((F.lit(65) + x).cast("long"))
    last = letter(F.pmod(n - 1, F.lit(26)))
    two = n - 27
    middle = letter(F.pmod(F.floor(two / 26), F.lit(26)))
    first = letter(F.floor((n - 703) / 676))
    return F.when(n <= 26, last).when(n <= 702, F.concat(middle, last)).when(n <= 18_278, F.concat(first, middle, last)).when(
        n > 18_278, F.raise_error(F.lit("column beyond ZZZ"))
    )


def a1(row_idx: Column, col_idx: Column) -> Column:
    return F.concat(column_letters(col_idx), (row_idx + 1).cast("string"))


def _filled(cells: Column) -> Column:
    return F.filter(
        F.transform(cells, lambda c, i: F.when(c.isNotNull(), i)), lambda i: i.isNotNull()
    )


def table_rows(sheets: Sheets, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Non-blank rows labelled with the first row of their table; blank rows separate tables.

    The previous filled row is carried across chunks of the source position, so one endless sheet
    is scanned by many tasks.
    """
    filled = sheets.rows.withColumn("_places", _filled(F.col("cells"))).filter(F.size("_places") > 0)
    filled = chunked(filled, "row_idx", chunk_rows)
    seen = scan_last(filled, ["sheet_id"], "_chunk", ["row_idx"], F.col("row_idx"), "_prev", inclusive=False)
    starts = F.when(F.col("_prev").isNull() | (F.col("_prev") < F.col("row_idx") - 1), F.col("row_idx"))
    labelled = scan_last(seen, ["sheet_id"], "_chunk", ["row_idx"], starts, "table_start")
    return labelled.select("sheet_id", "table_start", "row_idx", "cells", "_places")


def detect_tables(sheets: Sheets, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per table: header cells, extent, A1 ranges and confidence.

    The first row of a block is its header. Confidence blends how much of the header row and of
    the data area is filled (60/40).
    """
    rows = table_rows(sheets, chunk_rows)
    grouped = rows.groupBy("sheet_id", "table_start").agg(
        F.max("row_idx").alias("last_row"),
        F.min(F.array_min("_places")).alias("first_col"),
        F.max(F.array_max("_places")).alias("last_col"),
        F.min_by("cells", "row_idx").alias("header_cells"),
        F.sum(F.when(F.col("row_idx") > F.col("table_start"), F.size("_places")).otherwise(0)).alias("_data"),
        F.sum(F.when(F.col("row_idx") == F.col("table_start"), F.size("_places")).otherwise(0)).alias("_head"),
    )
    width = F.col("last_col") - F.col("first_col") + 1
    height = F.col("last_row") - F.col("table_start")
    head_share = F.col("_head") / width
    data_share = F.when(height > 0, F.col("_data") / (width * height)).otherwise(0.0)
    cell = lambda r, c: a1(F.col(r) if isinstance(r, str) else r, F.col(c))
    span = lambda r1, r2: F.concat_ws(":", cell(r1, "first_col"), cell(r2, "last_col"))
    return grouped.select(
        "sheet_id",
        "table_start",
        "last_row",
        "first_col",
        "last_col",
        "header_cells",
        height.alias("data_rows"),
        span("table_start", "table_start").alias("header_range"),
        F.when(height > 0, span(F.col("table_start") + 1, "last_row")).alias("data_range"),
        F.round(0.6 * head_share + 0.4 * data_share, 4).alias("confidence"),
    )


def table_columns(tables: DataFrame) -> DataFrame:
    """One row per labelled header cell of each table, with the range of its data."""
    cells = tables.select(
        "sheet_id", "table_start", "last_row", "data_rows", F.posexplode("header_cells").alias("col_idx", "header")
    ).filter(F.col("header").isNotNull())
    rng = F.concat_ws(
        ":", a1(F.col("table_start") + 1, F.col("col_idx")), a1(F.col("last_row"), F.col("col_idx"))
    )
    return cells.select("sheet_id", "table_start", "col_idx", "header", F.when(F.col("data_rows") > 0, rng).alias("data_range"))


def anchors(columns: DataFrame) -> DataFrame:
    """Distinct header labels of a sheet with the first cell they appear in."""
    first = F.min(F.struct("table_start", "col_idx"))
    return columns.groupBy("sheet_id", F.col("header").alias("label")).agg(first.alias("_at")).select(
        "sheet_id", "label", a1(F.col("_at.table_start"), F.col("_at.col_idx")).alias("cell")
    )


def occurrence_index(cells: DataFrame, what: str) -> DataFrame:
    """Distinct formulas (or formats) with their number of occurrences and first and last cell.

    ``cells(sheet_id, row_idx, col_idx, <what>)``. The cells themselves stay rows (see
    ``occurrences``): a formula may fill a third of a corpus, no list could hold that.
    """
    spot = F.struct("row_idx", "col_idx")
    grouped = cells.filter(F.col(what).isNotNull()).groupBy("sheet_id", what).agg(
        F.count(F.lit(1)).alias("occurrences"), F.min(spot).alias("_a"), F.max(spot).alias("_b")
    )
    at = lambda s: a1(F.col(f"{s}.row_idx"), F.col(f"{s}.col_idx"))
    return grouped.select("sheet_id", what, "occurrences", at("_a").alias("first_cell"), at("_b").alias("last_cell"))


def occurrences(cells: DataFrame, what: str) -> DataFrame:
    """Every cell holding a formula (or format), one row each, in A1 notation."""
    return cells.filter(F.col(what).isNotNull()).select("sheet_id", what, a1(F.col("row_idx"), F.col("col_idx")).alias("cell"))


def signature(items: DataFrame, column: str, out: str) -> DataFrame:
    """Order-free hash of a sheet's distinct labels or formulas, in constant memory.

    The two halves of each MD5 are summed as decimals, which does not depend on row order.
    """
    distinct = items.select("sheet_id", column).distinct()
    half = lambda at: F.sum(F.conv(F.substring(F.md5(column), at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return distinct.groupBy("sheet_id").agg(
        F.sha2(F.concat_ws(":", F.coalesce(half(1), F.lit("0")), F.coalesce(half(17), F.lit("0")), F.count(F.lit(1)).cast("string")), 256).alias(out)
    )


def fingerprints(columns: DataFrame, marks: DataFrame, longest: int = LONGEST_PRINT) -> DataFrame:
    """``anchor :: formula :: sorted lower-case headers of each table``, the first ``longest`` characters, and ``tables_hash``.

    ``columns(sheet_id, table_start, header)``, ``marks(sheet_id, anchor_hash, formula_fingerprint)``. Known prefixes
    must not be longer than ``longest``. ``tables_hash`` tells all tables of a sheet in their order: hashes salted with
    the table's place are summed with map-side partials, whatever the number of tables; a sheet without a table has none.
    Only the few first tables that reach into the text are put together, at most one for every two of its characters.
    """
    labels = columns.groupBy("sheet_id", "table_start").agg(
        F.array_join(F.array_sort(F.collect_list(F.lower("header"))), "|").alias("_labels")
    )
    placed = materialize(positions(labels.filter(F.col("sheet_id").isNotNull()), ["sheet_id"], ["table_start"], out="_place"), "tables")
    salted = F.md5(F.concat_ws(":", F.col("_place").cast("string"), "_labels"))
    half = lambda at: F.sum(F.conv(F.substring(salted, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    hashes = placed.groupBy("sheet_id").agg(
        F.sha2(F.concat_ws(":", half(1), half(17), F.count(F.lit(1)).cast("string")), 256).alias("tables_hash")
    )
    reaching = placed.filter(F.col("_place") <= longest // len(_SEPARATOR)).select("sheet_id", "_place", F.left("_labels", F.lit(longest)).alias("_labels"))
    texts = reaching.groupBy("sheet_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_labels"))), lambda t: t["_labels"]), _SEPARATOR).alias("_tables")
    )
    known = marks.join(hashes, "sheet_id", "left").join(texts, "sheet_id", "left")
    text = F.concat_ws(_SEPARATOR, F.coalesce("anchor_hash", F.lit("unknown-anchor")), F.coalesce("formula_fingerprint", F.lit("unknown-formula")), "_tables")
    return known.select("sheet_id", F.left(text, F.lit(longest)).alias("fingerprint"), "tables_hash")


def match_fingerprints(prints: DataFrame, known: DataFrame) -> DataFrame:
    """First known entry (lowest ``ord``) whose ``prefix`` starts the fingerprint.

    ``known(ord, prefix, template_id, template_version_id)``; a null prefix starts nothing, an empty one everything.
    Distinct fingerprints and prefixes are sorted together once, by ranges. All texts between a prefix and one that it
    starts have it as a prefix too, so a task goes through its range with the chain of prefixes that are open, each inside
    the one before; those that are open where its range begins are looked up for the first text of the range only. One row
    per fingerprint crosses the shuffle, however many prefixes and lengths there are.
    """
    entry = F.struct("ord", "template_id", "template_version_id")
    prefixes = known.filter(F.col("prefix").isNotNull()).groupBy(F.col("prefix").alias("text")).agg(F.min(entry).alias("entry"))
    prefixes = materialize(prefixes.select("text", F.lit(0).alias("kind"), "entry"), "known")
    asked = prints.filter(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias("text")).distinct()
    none = F.lit(None).cast(prefixes.schema["entry"].dataType)
    ordered = prefixes.unionByName(asked.select("text", F.lit(1).alias("kind"), none.alias("entry"))).orderBy("text", "kind")
    ordered = materialize(ordered.withColumn("_mid", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("_mid", 33)).drop("_mid")

    firsts = ordered.groupBy("part").agg(F.min("text").alias("_first"))
    cuts = firsts.select("part", F.explode(F.sequence(F.lit(0), F.length("_first"))).alias("_n"), "_first").select(
        "part", F.left("_first", F.col("_n")).alias("text")
    )
    # a range's own prefixes are met again in it, which does no harm
    open_before = cuts.join(prefixes, "text").select("text", "kind", "entry", "part")
    ranges = ordered.unionByName(open_before).repartition("part").sortWithinPartitions("part", "text", "kind")
    found = ranges.select("part", "text", "kind", "entry.*").mapInPandas(_open_prefixes, "fingerprint string, ord long, template_id string, template_version_id string")
    best = attach(prints.select("sheet_id", "fingerprint"), found.drop("ord"), ["fingerprint"])
    return best.select("sheet_id", "fingerprint", "template_id", "template_version_id")


def _open_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fingerprints with the best entry among the prefixes that are open where they stand in the order."""
    at, chain = None, []  # of (prefix, best entry of the chain up to it)
    for batch in batches:
        found = []
        for part, text, kind, *own in batch.itertuples(index=False, name=None):
            if part != at:
                at, chain = part, []
            while chain and not text.startswith(chain[-1][0]):
                chain.pop()
            if kind == 0:
                chain.append((text, min(own, chain[-1][1], key=lambda e: e[0]) if chain else own))
            elif chain:
                found.append((text, *chain[-1][1]))
        yield pd.DataFrame(found, columns=["fingerprint", "ord", "template_id", "template_version_id"])
