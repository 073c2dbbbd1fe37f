"""``spark.read.format("sheets")``: workbooks as a data source that reads only the sheets and rows a query asks for.

Every sheet is a partition of its own. Filters on path, sheet, order, row and column reach the reader: sheets that
cannot hold a wanted cell are not planned, cells that are not wanted are not made, and reading a sheet ends at the last wanted
row. Rows are streamed out of the zipped file, of which only the parts needed are read.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
)

from tabprep.sources.workbook import CELLS_DDL, READABLE, Book, open_book, sheet_records

FORMAT = "sheets"
#: Cells per Arrow batch, and files whose lists of sheets are read at a time while a query is planned.
BATCH_CELLS = 20_000
PLANNERS = 32

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_COLUMNS = [tuple(part.split()) for part in CELLS_DDL.split(", ")]
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in _COLUMNS])
_PLACE = {name: i for i, (name, _) in enumerate(_COLUMNS)}
#: What is known of a cell while it is planned, and before its text is made.
_PLANNED, _READ = ("path", "sheet_ord", "sheet"), ("row_idx", "col_idx")

_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


def _holds(wanted: Filter, value: Any) -> bool:
    """Whether a filter is true for a value; an unknown outcome is not true."""
    if isinstance(wanted, IsNull):
        return value is None
    if isinstance(wanted, IsNotNull):
        return value is not None
    if isinstance(wanted, EqualNullSafe):
        return value == wanted.value
    return value is not None and wanted.value is not None and _TESTS[type(wanted)](value, wanted.value)


def _passes(wanted: Filter, value: Any) -> bool:
    if isinstance(wanted, Not):
        return value is not None and not _holds(wanted.child, value)
    return _holds(wanted, value)


def _column(wanted: Filter) -> str | None:
    """The column of a filter that the reader can apply exactly."""
    inner = wanted.child if isinstance(wanted, Not) else wanted
    if type(inner) not in (*_TESTS, IsNull, IsNotNull, EqualNullSafe) or isinstance(inner, Not):
        return None
    if isinstance(wanted, Not) and isinstance(inner, (IsNull, IsNotNull, EqualNullSafe)):
        return None
    name = inner.attribute[0] if len(inner.attribute) == 1 else None
    return name if name in _PLANNED + _READ else None


@dataclass
class SheetPart(InputPartition):
    """One sheet of one file, or what is wrong with the file."""

    path: str
    order: int | None = None
    sheet: str | None = None
    error: str | None = None

    def __post_init__(self):
        super().__init__(self.path)


def filesystem_of(path: str) -> tuple[fs.FileSystem, str]:
    """Where ``path`` lies: any store that Arrow knows by its URI (``file:``, ``hdfs:``, ``s3:``, ``gs:`` …), or a plain path."""
    if re.match(r"\w[\w+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


class _File(io.RawIOBase):
    """A file of Arrow's as one of Python's: a place before its beginning is an ``OSError``, which the zip reader expects."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + (0, self.file.tell(), self.file.size())[whence]
        if place < 0:
            raise OSError("before the beginning")
        return self.file.seek(place)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        found = self.file.read(len(buffer))
        buffer[: len(found)] = found
        return len(found)


@contextmanager
def open_workbook(path: str) -> Iterator[Book]:
    store, inner = filesystem_of(path)
    with store.open_input_file(inner) as file, open_book(io.BufferedReader(_File(file), 1 << 16)) as book:
        yield book


def list_workbooks(path: str, recursive: bool = False) -> list[str]:
    """Readable workbooks at ``path``, a file or folder, one level deep unless ``recursive``, by name."""
    store, inner = filesystem_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else ""
    found = [f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=recursive)) if f.type == fs.FileType.File]
    return [prefix + f for f in sorted(found) if f.lower().endswith(READABLE)]


def _failure(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


class SheetsReader(DataSourceReader):
    def __init__(self, paths: list[str], recursive: bool, threads: int):
        self.paths, self.recursive, self.threads = paths, recursive, threads
        self.planned: list[Filter] = []
        self.read_filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for wanted in filters:
            name = _column(wanted)
            if name in _PLANNED:
                self.planned.append(wanted)
            elif name in _READ:
                self.read_filters.append(wanted)
            else:
                yield wanted

    def _wanted(self, part: SheetPart) -> bool:
        known = {"path": part.path, "sheet_ord": part.order, "sheet": part.sheet}
        return all(_passes(f, known[_column(f)]) for f in self.planned)

    def _sheets(self, path: str) -> list[SheetPart]:
        names = [f for f in self.planned if _column(f) == "path"]
        if not all(_passes(f, path) for f in names):
            return []
        try:
            with open_workbook(path) as book:
                parts = [SheetPart(path, order, sheet) for order, (sheet, _) in enumerate(book.sheets)]
        except Exception as error:  # noqa: BLE001 - one odd file must not end the corpus
            parts = [SheetPart(path, error=_failure(error))]
        return [p for p in parts if self._wanted(p)]

    def partitions(self) -> Sequence[SheetPart]:
        files = [f for path in self.paths for f in list_workbooks(path, self.recursive)]
        with ThreadPoolExecutor(self.threads) as pool:
            return [part for parts in pool.map(self._sheets, files) for part in parts]

    def read(self, partition: SheetPart | None) -> Iterator[pa.RecordBatch]:
        """Cells of one sheet; there is no partition if no sheet was planned."""
        rows: list[tuple] = []
        if partition is None or partition.error is not None:
            if partition and self._keeps(None, None):
                rows.append(self._record(partition, partition.error))
            yield self._batch(rows)
            return
        last = self._last_row()
        try:
            with open_workbook(partition.path) as book:
                for cell in sheet_records(book, partition.order):
                    row, col = cell[2], cell[3]
                    if last is not None and row is not None and row > last:
                        break
                    if self._keeps(row, col):
                        rows.append((partition.path, *cell, None))
                        if len(rows) >= BATCH_CELLS:
                            yield self._batch(rows)
                            rows = []
        except Exception as error:  # noqa: BLE001 - what was read before stays
            if self._keeps(None, None):
                rows.append(self._record(partition, _failure(error)))
        yield self._batch(rows)

    def _keeps(self, row: int | None, col: int | None) -> bool:
        return all(_passes(f, row if _column(f) == "row_idx" else col) for f in self.read_filters)

    def _last_row(self) -> int | None:
        """The last row that any filter lets pass, if they say."""
        ends = [
            f.value - isinstance(f, LessThan)
            for f in self.read_filters
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and _column(f) == "row_idx" and f.value is not None
        ]
        return min(ends, default=None)

    @staticmethod
    def _record(part: SheetPart, error: str) -> tuple:
        out: list[Any] = [None] * len(_COLUMNS)
        out[_PLACE["path"]], out[_PLACE["sheet_ord"]], out[_PLACE["sheet"]], out[_PLACE["error"]] = part.path, part.order, part.sheet, error
        return tuple(out)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(_COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


class SheetsSource(DataSource):
    """Options: ``path`` (a file or folder; several by ``paths``, one a line), ``recursive`` (false), ``planners`` (threads)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CELLS_DDL

    def reader(self, schema) -> SheetsReader:
        paths = [p for p in self.options.get("paths", self.options.get("path", "")).split("\n") if p]
        if not paths:
            raise ValueError("no path given")
        return SheetsReader(paths, self.options.get("recursive", "false").lower() == "true", int(self.options.get("planners", PLANNERS)))


def register_sheets(spark: SparkSession) -> None:
    """Make ``format("sheets")`` known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SheetsSource)


def read_sheets(spark: SparkSession, paths: Sequence[str], recursive: bool = False) -> DataFrame:
    """Cells as ``read_workbooks`` gives them, read sheet by sheet.

    Paths must be in a store that Python workers can open (see ``filesystem_of``); for others take ``read_workbooks``,
    whose files are read by Spark itself. A damaged file gives one row with ``error`` and no sheet, a sheet that breaks off its
    cells up to there and a row with ``error``; filters on the sheet's columns leave such rows out like any null.
    """
    register_sheets(spark)
    return spark.read.format(FORMAT).option("paths", "\n".join(paths)).option("recursive", str(recursive).lower()).load()
