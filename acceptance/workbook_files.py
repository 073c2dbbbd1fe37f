"""Whole tables written as workbook files into the shared folder, found, checked and read back sheet by sheet."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acceptance.base import query, table
from tabprep.operators import validate as vd
from tabprep.session import materialize, scratch_path
from tabprep.sources.sheets import filesystem_of, read_sheets
from tabprep.sources.workbook import discover, read_workbooks, workbook_inventory, workbook_sheets

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PER_BOOK = 2000
#: What XML cannot hold, a carriage return, and what looks like such a code already.
_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
#: table -> (key, columns; one that is null where it equals a value, that value)
TABLES = {
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_mktsegment", "BUILDING"),
    "events": ("event_id", ["event_id", "user_id", "event_type", "value", "props"], "event_type", "error"),
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"], "lang", "de"),
}


def _text(value: str, place: str) -> str:
    plain = _UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", value).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{plain}</t></is></c>'


def _sheet(header: list[str], rows: Iterator[list]) -> Iterator[str]:
    yield f'<worksheet xmlns="{_MAIN}"><sheetData>'
    for at, row in enumerate([header, *rows], 1):
        cells = (_text(v, f"{chr(65 + k)}{at}") if isinstance(v, str) else f'<c r="{chr(65 + k)}{at}"><v>{v!r}</v></c>' for k, v in enumerate(row) if v is not None)
        yield f'<row r="{at}">{"".join(cells)}</row>'
    yield "</sheetData></worksheet>"


def _write(path: str, sheets: dict[str, tuple[list[str], list[list]]]) -> None:
    """Put a workbook at ``path``, whole or not at all, so that a task may be run again."""
    store, inner = filesystem_of(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner + ".part") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{name}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (header, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/s{i}.xml", "w") as part:
                for line in _sheet(header, rows):
                    part.write(line.encode())
    store.move(inner + ".part", inner)


def _plain(value):
    """A cell's value as Python writes it."""
    return None if pd.isna(value) else value.item() if hasattr(value, "item") else value


def written(spark: SparkSession, sf: str, name: str) -> str:
    """Folder of workbooks that hold the table's rows, dealt by key; each also has a sheet of keys only, and one book in five lies deeper."""
    key, columns, nulled, where = TABLES[name]
    folder = scratch_path(spark, f"books-{name}")
    rows = table(spark, sf, name).select(*[F.nullif(F.col(c), F.lit(where)).alias(c) if c == nulled else F.col(c) for c in columns])
    books = rows.count() // _PER_BOOK + 1

    def save(part: pd.DataFrame) -> pd.DataFrame:
        book = int(part["book"].iloc[0])
        body = [[_plain(v) for v in r] for r in part.sort_values(key)[columns].itertuples(index=False)]
        path = f"{folder}/{'deep/' if book % 5 == 4 else ''}{name}-{book}.{'XLSM' if book % 2 else 'xlsx'}"
        _write(path, {name: (columns, body), "keys": ([key], [[r[0]] for r in body])})
        return pd.DataFrame({"path": [path]})

    made = rows.withColumn("book", F.pmod(F.col(key), F.lit(books))).groupBy("book").applyInPandas(save, "path string")
    materialize(made, "paths")
    return folder


def _read_back(spark: SparkSession, sf: str, name: str, kinds: list[str]) -> DataFrame:
    cells = read_sheets(spark, [written(spark, sf, name)], recursive=True).filter(F.col("sheet") == name)
    rows = workbook_sheets(materialize(cells, "cells")).rows
    return rows.select(*[F.get("cells", F.lit(i)).cast(k).alias(c) for i, (c, k) in enumerate(zip(TABLES[name][1], kinds))])


@query("workbook_customer", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def workbook_customer(spark, sf):
    return _read_back(spark, sf, "customer", ["long", "string", "int", "double", "string"])


@query("workbook_events", "SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, value, props FROM events")
def workbook_events(spark, sf):
    return _read_back(spark, sf, "events", ["long", "long", "string", "double", "string"])


_MISSING = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"


@query("workbook_documents", f"SELECT doc_id, CASE WHEN text NOT IN {_MISSING} THEN text END AS text, nullif(lang, 'de') AS lang, source, n_chars FROM documents")
def workbook_documents(spark, sf):
    return _read_back(spark, sf, "documents", ["long", "string", "string", "string", "long"])


@query("workbook_top_rows", f"""WITH b AS (SELECT event_id, props, event_id % ((SELECT count(*) FROM events) // {_PER_BOOK} + 1) AS book FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY event_id) AS row_idx FROM b)
SELECT book::BIGINT AS book, row_idx, props AS value FROM r WHERE row_idx BETWEEN 10 AND 19""")
def workbook_top_rows(spark, sf):
    """Filters on sheet, column and rows reach the reader, which stops after the twentieth row."""
    cells = read_sheets(spark, [written(spark, sf, "events")], recursive=True)
    found = cells.filter("sheet = 'events' AND row_idx >= 10 AND row_idx < 20 AND col_idx = 4")
    return found.select(F.regexp_extract("path", r"-(\d+)\.\w+$", 1).cast("long").alias("book"), "row_idx", "value")


@query("workbook_discovery", f"""WITH n AS (SELECT count(*) // {_PER_BOOK} + 1 AS books FROM events)
SELECT 'events-' || book || CASE WHEN book % 2 = 1 THEN '.XLSM' ELSE '.xlsx' END AS name, true AS supported FROM n, range(books) r(book) WHERE book % 5 <> 4
UNION ALL SELECT 'note-' || book || '.txt', false FROM n, range(books) r(book)""")
def workbook_discovery(spark, sf):
    """Books of the folder itself, in either case, next to files of another kind; deeper folders are not looked into."""
    folder = written(spark, sf, "events")
    _notes(spark, sf, folder)
    return discover(spark, [folder]).select("name", "supported")


def _notes(spark: SparkSession, sf: str, folder: str) -> None:
    """One text file, one that is no archive and one that is cut for every book of the events."""

    def save(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for book in part["id"]:
                store, inner = filesystem_of(folder)
                store.create_dir(inner, recursive=True)
                with store.open_output_stream(f"{inner}/note-{book}.txt") as file:
                    file.write(b"a note")
            yield part

    books = table(spark, sf, "events").count() // _PER_BOOK + 1
    materialize(spark.range(books).mapInPandas(save, "id long"), "notes")


@query("workbook_file_checks", f"""WITH n AS (SELECT count(*) // {_PER_BOOK} + 1 AS books FROM events)
SELECT 'events-' || book || CASE WHEN book % 2 = 1 THEN '.XLSM' ELSE '.xlsx' END AS name, CASE WHEN book % 2 = 1 THEN 'invalid-extension' ELSE '' END AS reasons FROM n, range(books) r(book) WHERE book % 5 <> 4
UNION ALL SELECT 'note-' || book || '.txt', 'invalid-extension,file-empty' FROM n, range(books) r(book)
UNION ALL SELECT 'odd-' || book || '.xlsx', CASE book % 3 WHEN 0 THEN 'file-damaged' WHEN 1 THEN 'file-damaged' ELSE 'file-empty' END FROM n, range(books) r(book)""")
def workbook_file_checks(spark, sf):
    """Whole books beside damaged and empty ones; what the reader could not read is told apart from what holds no row."""
    folder = written(spark, sf, "events")
    _notes(spark, sf, folder)

    def save(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for book in part["id"]:
                path = f"{folder}/odd-{book}.xlsx"
                if book % 3 == 2:
                    _write(path, {"none": ([], [])})
                else:
                    store, inner = filesystem_of(path)
                    with store.open_output_stream(inner) as file:
                        file.write(b"no archive" if book % 3 else b"PK\x05\x06" + bytes(18))
            yield part

    books = table(spark, sf, "events").count() // _PER_BOOK + 1
    materialize(spark.range(books).mapInPandas(save, "id long"), "odd")
    cells = materialize(read_workbooks(spark, [folder]), "cells")
    rows = workbook_inventory(cells).groupBy(F.substring_index("sheet_id", "#", 1).alias("path")).agg(F.sum("total_rows").alias("total_rows"))
    errors = cells.filter("error IS NOT NULL").groupBy("path").agg(F.first("error").alias("error"))
    files = discover(spark, [folder]).join(rows, "path", "left").join(errors, "path", "left")
    checked = vd.file_checks(files, 1 << 40)
    return checked.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.array_join("reasons", ",").alias("reasons"))
