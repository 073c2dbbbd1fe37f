"""Read corpora of spreadsheet files: one decode per file inside the tasks, cells out.

Supports the zipped XML formats (``.xlsx``, ``.xlsm``). Spark lists and distributes the files;
the decoder below streams one sheet at a time and holds only the shared strings of one file.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprep.session import materialize
from tabprep.sources.tables import Sheets

# File suffixes, and texts taken for a missing cell.
SUFFIXES = (".xls", ".xlsx", ".xlsm", ".xlsb")
READABLE = (".xlsx", ".xlsm")
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
#: Rows that a task puts together from their cells.
ROWS_PER_TASK = 500_000

CELLS_DDL = (
    "path string, sheet_ord int, sheet string, row_idx long, col_idx int, value string, "
    "formula string, style_id string, merged string, bold boolean, fill string, bordered boolean, number_family string, error string"
)


def discover(spark: SparkSession, paths: Sequence[str], suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Files at ``paths`` (directories one level deep): path, name, length and whether supported."""
    found = spark.read.format("binaryFile").load(list(paths)).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    pattern = "(" + "|".join(re.escape(s) for s in suffixes) + ")$"
    return found.select(
        "path", name.alias("name"), "length", F.lower(name).rlike(pattern).alias("supported")
    ).orderBy("name", "path")


def read_workbooks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Cells of every sheet of every readable workbook; a damaged file gives one row with ``error``."""
    return decode_workbooks(spark.read.format("binaryFile").load(list(paths)))


def decode_workbooks(files: DataFrame) -> DataFrame:
    """``read_workbooks`` for contents that are at hand: ``files(path, content)``, one file per row.

    Whatever is wrong with a file ends that file only: what was read before stays, and a row with ``error`` follows.
    """
    files = files.select("path", "content")
    readable = files.filter(F.lower("path").rlike("(" + "|".join(re.escape(s) for s in READABLE) + ")$"))
    return readable.mapInPandas(_decode, CELLS_DDL)


def workbook_sheets(cells: DataFrame, missing: Sequence[str] = MISSING_TEXTS) -> Sheets:
    """Cells as a sheet corpus: the first filled row of a sheet is its header row.

    ``sheet_id`` is ``path#sheet``. Texts that mean "missing" become null. Blank rows below the header are rows
    of nulls. Sheets without a cell have neither rows nor headers; ``workbook_inventory`` lists them.
    """
    named = cells.filter(F.col("error").isNull() & F.col("row_idx").isNotNull()).select(
        F.concat_ws("#", "path", "sheet").alias("sheet_id"), "row_idx", "col_idx", "value"
    )
    first = named.groupBy("sheet_id").agg(
        F.min("row_idx").alias("_first"), F.max("row_idx").alias("_last"), (F.max("col_idx") + 1).alias("_width")
    )
    from tabprep.operators.scale import attach

    extent = materialize(first, "extent")
    skeleton = extent.select(
        "sheet_id", F.explode(F.sequence("_first", "_last")).alias("row_idx"), F.lit(None).cast("int").alias("col_idx"), F.lit(None).cast("string").alias("value")
    )
    placed = attach(named.unionByName(skeleton), extent.drop("_last"), ["sheet_id"], how="inner", stored=True)
    # moved before they are grouped: cells compress so well that a task that reads files may meet any number of rows
    rows = extent.agg(F.sum(F.col("_last") - F.col("_first") + 1)).first()[0] or 0
    tasks = max(extent.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    placed = placed.repartition(tasks, "sheet_id", "row_idx")
    packed = placed.groupBy("sheet_id", "row_idx", "_first", "_width").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("col_idx").isNotNull(), F.struct("col_idx", "value")))).alias("_m")
    )
    row = F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.col("_m")[i])
    rows = packed.select("sheet_id", "row_idx", "_first", row.alias("cells"))
    headers = rows.filter(F.col("row_idx") == F.col("_first")).select(
        "sheet_id", F.posexplode("cells").alias("col_idx", "header")
    )
    known = F.transform("cells", lambda c: F.when(~c.isin(list(missing)), c))
    data = rows.filter(F.col("row_idx") > F.col("_first")).select(
        "sheet_id", (F.col("row_idx") - F.col("_first") - 1).alias("row_idx"), known.alias("cells")
    )
    return Sheets(data, headers)


def workbook_inventory(cells: DataFrame) -> DataFrame:
    """Every sheet of every readable file: ``sheet_id, columns, total_rows`` (below the header), zero for empty sheets."""
    found = cells.filter(F.col("error").isNull()).groupBy(F.concat_ws("#", "path", "sheet").alias("sheet_id")).agg(
        F.coalesce(F.max("col_idx") + 1, F.lit(0)).alias("columns"),
        F.coalesce(F.max("row_idx") - F.min("row_idx"), F.lit(0)).alias("total_rows"),
    )
    return found


def workbook_index(cells: DataFrame) -> DataFrame:
    """``workbook_id, sheet_ord, sheet_id`` in workbook order, for ``navigation``."""
    listed = cells.filter(F.col("error").isNull()).select("path", "sheet_ord", "sheet").distinct()
    order = Window.partitionBy("path").orderBy("sheet_ord")
    return listed.select(
        F.col("path").alias("workbook_id"),
        (F.row_number().over(order) - 1).alias("sheet_ord"),
        F.concat_ws("#", "path", "sheet").alias("sheet_id"),
    )


# --- decoding one file -----------------------------------------------------------------------------

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_EPOCH, _EPOCH_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)
# Built-in number formats that show a date or time.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_BATCH = 20_000


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in CELLS_DDL.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows: list[tuple] = []
            try:
                for cell in _cells(bytes(content)):
                    rows.append((path, *cell, None))
                    if len(rows) >= _BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except Exception as error:  # noqa: BLE001 - one odd file must not end the corpus
                rows.append((path, *[None] * 12, f"{type(error).__name__}: {error}"))
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"sheet_ord": "Int32", "row_idx": "Int64", "col_idx": "Int32"})


@dataclass
class Book:
    """An open workbook: its archive, what its sheets share, and (name, part) of each sheet."""

    archive: zipfile.ZipFile
    strings: list[str] | None
    looks: list[tuple]
    epoch: datetime.datetime
    sheets: list[tuple[str, str | None]]

    def shared(self) -> list[str]:
        """The texts that cells refer to, read when the first cell does."""
        if self.strings is None:
            self.strings = _shared_strings(self.archive) if "xl/sharedStrings.xml" in self.archive.namelist() else []
        return self.strings


@contextmanager
def open_book(file) -> Iterator[Book]:
    """The workbook in a seekable file; only its lists of sheets and styles are read."""
    with zipfile.ZipFile(file) as archive:
        looks = _styles(archive) if "xl/styles.xml" in archive.namelist() else []
        targets = {
            rel.get("Id"): rel.get("Target").lstrip("/").removeprefix("xl/")
            for rel in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        }
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        settings = book.find(f"{_NS}workbookPr")
        epoch = _EPOCH_1904 if settings is not None and settings.get("date1904") in ("1", "true") else _EPOCH
        sheets = [(sheet.get("name"), f"xl/{targets[sheet.get(_REL)]}") for sheet in book.iter(f"{_NS}sheet")]
        yield Book(archive, None, looks, epoch, sheets)


def sheet_records(book: Book, order: int) -> Iterator[tuple]:
    """(sheet_ord, sheet, row_idx, col_idx, value, formula, style_id, merged, bold, fill, bordered, number_family) of a sheet."""
    name, part = book.sheets[order]
    dates = {i for i, look in enumerate(book.looks) if look[3] == "date"}
    ranges = iter(sorted(_merged_ranges(book.archive, part)))
    coming, active, empty = next(ranges, None), [], True
    for row_idx, col_idx, value, formula, style in _sheet_cells(book, part, dates):
        empty = False
        # rows come in order: only ranges that reach the current row are looked at
        while coming and coming[0] <= row_idx:
            active.append(coming)
            coming = next(ranges, None)
        inside = None
        if active:
            active = [m for m in active if row_idx <= m[2]]
            inside = next((m[4] for m in active if m[1] <= col_idx <= m[3]), None)
        look = book.looks[int(style)] if style is not None and int(style) < len(book.looks) else _PLAIN
        yield order, name, row_idx, col_idx, value, formula, style, inside, *look
    if empty:
        yield order, name, *[None] * 10


def _cells(content: bytes) -> Iterator[tuple]:
    """``sheet_records`` of all sheets of one workbook."""
    with open_book(io.BytesIO(content)) as book:
        for order in range(len(book.sheets)):
            yield from sheet_records(book, order)


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    items = []
    with archive.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == f"{_NS}si":
                items.append(_unescaped("".join(t.text or "" for t in node.iter(f"{_NS}t"))))
                node.clear()
    return items


_PLAIN = (False, None, False, "general")


def _styles(archive: zipfile.ZipFile) -> list[tuple]:
    """(bold, fill colour, bordered, number format family) of every cell style."""
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_NS}numFmt")}
    listed = lambda name: list(root.iterfind(f"{_NS}{name}/*"))
    bold = [font.find(f"{_NS}b") is not None for font in listed("fonts")]
    fills = [next((c.get("rgb") or c.get("theme") for c in fill.iter(f"{_NS}fgColor")), None) for fill in listed("fills")]
    bordered = [any(side.get("style") for side in border) for border in listed("borders")]

    def of(values: list, place: str | None, other):
        return values[int(place)] if place is not None and int(place) < len(values) else other

    return [
        (of(bold, xf.get("fontId"), False), of(fills, xf.get("fillId"), None), of(bordered, xf.get("borderId"), False), _family(int(xf.get("numFmtId", 0)), codes))
        for xf in listed("cellXfs")
    ]


def _family(number: int, codes: dict[int, str]) -> str:
    """date, percent, scientific, fraction, text, number or general."""
    code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", codes.get(number, "").lower())
    if number in _DATE_FORMATS or re.search(r"[ymdhs]", code):
        return "date"
    if number in (9, 10) or "%" in code:
        return "percent"
    if number in (11, 48) or "e+" in code:
        return "scientific"
    if number in (12, 13) or "?/" in code:
        return "fraction"
    if number == 49 or code == "@":
        return "text"
    return "general" if number == 0 or code == "general" else "number"


def _place(ref: str) -> tuple[int, int]:
    letters = ref.rstrip("0123456789")
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(ref[len(letters):]) - 1, col - 1


#: What begins the list of merged ranges, whatever prefix its name has.
_MERGES, _LONGEST_MERGES = re.compile(rb"<(?:[\w.-]+:)?mergeCells?[\s>/]"), 128


def _merged_ranges(archive: zipfile.ZipFile, part: str) -> list[tuple]:
    """Merged ranges, which follow the cells: sheets without any are searched as bytes only."""
    ranges, tail = [], b""
    with archive.open(part) as stream:
        while chunk := stream.read(1 << 20):
            if _MERGES.search(tail + chunk):
                break
            tail = chunk[-_LONGEST_MERGES:]
        else:
            return ranges
    with archive.open(part) as stream:
        for node in _children(stream, f"{_NS}mergeCell"):
            start, _, end = node.get("ref").partition(":")
            ranges.append((*_place(start), *_place(end or start), node.get("ref")))
    return ranges


def _children(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind as they are completed; what was given out or is a row is emptied.

    Only ends are told, as each event costs as much as a cell: an empty element stays for every row, some 80 bytes.
    """
    row = f"{_NS}row"
    for _, node in ElementTree.iterparse(stream, events=("end",)):
        kind = node.tag
        if kind == tag:
            yield node
            node.clear()
        elif kind == row:
            node.clear()


def _sheet_cells(book: Book, part: str, dates: set[int]) -> Iterator[tuple]:
    """Rows and cells may leave out their reference; they then follow the one before. Cells of a shared formula all show its text."""
    shared: dict[str, str] = {}
    row_idx = -1
    with book.archive.open(part) as stream:
        for node in _children(stream, f"{_NS}row"):
            row_idx, col_idx = int(node.get("r")) - 1 if node.get("r") else row_idx + 1, -1
            for cell in node.iter(f"{_NS}c"):
                row_idx, col_idx = _place(cell.get("r")) if cell.get("r") else (row_idx, col_idx + 1)
                made = cell.find(f"{_NS}f")
                formula = None if made is None else made.text
                if made is not None and made.get("t") == "shared":
                    formula = shared.setdefault(made.get("si"), formula) if formula else shared.get(made.get("si"))
                style = cell.get("s")
                value = _text(cell, book, style is not None and int(style) in dates)
                yield row_idx, col_idx, value, f"={formula}" if formula else None, style


#: A character that XML cannot hold is written as its code between underscores.
_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _unescaped(text: str) -> str:
    """Escaped characters as themselves; two that make up one character of a higher plane become that character."""
    if "_x" not in text:
        return text
    plain = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    return plain.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _text(cell: ElementTree.Element, book: Book, is_date: bool) -> str | None:
    kind, raw = cell.get("t", "n"), cell.findtext(f"{_NS}v")
    if kind == "inlineStr":
        return _unescaped("".join(t.text or "" for t in cell.iter(f"{_NS}t")))
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return book.shared()[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "str":
        return _unescaped(raw)
    if kind == "d":
        return raw
    number = float(raw)
    if is_date:
        return str(book.epoch + datetime.timedelta(seconds=round(number * 86400)))
    return str(int(number)) if number.is_integer() else repr(number)
