"""Workbooks made from orders inside the tasks, decoded again, and compared with the table."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from acceptance.base import query, table
from tabprep.operators.tables import cell_features
from tabprep.session import materialize
from tabprep.sources.workbook import decode_workbooks, workbook_inventory, workbook_sheets

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
_PER_BOOK = 4000


def _row(r: int, cells: list[str]) -> str:
    return f'<row r="{r}">' + "".join(cells) + "</row>"


def _book(rows: pd.DataFrame, date1904: bool) -> bytes:
    """Header in the third row; a blank row after every tenth; cells without reference, shared formulas, a merged range, an empty sheet."""
    start = pd.Timestamp("1904-01-01" if date1904 else "1899-12-30")
    text = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    body, at = [_row(3, [text(c) for c in _COLUMNS])], 4
    for n, (key, status, price, day) in enumerate(rows[_COLUMNS].itertuples(index=False)):
        formula = '<f t="shared" si="0" ref="C4:C9">A4*2</f>' if n == 0 else '<f t="shared" si="0"/>'
        body.append(_row(at, [f"<c><v>{key}</v></c>", f'<c r="B{at}" t="s"><v>{"FOP".index(status)}</v></c>', f"<c>{formula}<v>{price!r}</v></c>", f'<c s="1"><v>{(pd.Timestamp(day) - start).days}</v></c>']))
        at += 2 if n % 10 == 9 else 1
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="orders" sheetId="1" r:id="r1"/><sheet name="none" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}"><si><t>F</t></si><si><r><t>O</t></r></si><si><t>P</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><fonts><font/><font><b/></font></fonts><fills><fill/><fill><patternFill><fgColor rgb="FFFF00"/></patternFill></fill></fills><borders><border/><border><left style="thin"/></border></borders><cellXfs><xf numFmtId="0"/><xf numFmtId="14" fontId="1" fillId="1" borderId="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(body)}</sheetData><mergeCells><mergeCell ref="A3:B4"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{_MAIN}"><sheetData/></worksheet>')
    return out.getvalue()


def _make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    content = _book(rows.sort_values("o_orderkey"), key[0] % 2 == 1)
    # a cut file cannot be opened, the other one holds no workbook
    odd = [(f"cut-{key[0]}.xlsx", content[:200]), (f"zip-{key[0]}.xlsx", b"PK\x05\x06" + bytes(18)), (f"note-{key[0]}.txt", b"text")]
    return pd.DataFrame([(f"book-{key[0]}.xlsx", content), *odd], columns=["path", "content"])


def _cells(spark, sf):
    orders = table(spark, sf, "orders").select(*_COLUMNS, F.expr(f"cast(floor(o_orderkey / {_PER_BOOK}) as long)").alias("book"))
    files = orders.groupBy("book").applyInPandas(_make, "path string, content binary")
    return materialize(decode_workbooks(files), "decoded")


@query("workbook_rows", "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def workbook_rows(spark, sf):
    rows = workbook_sheets(_cells(spark, sf)).rows.filter(F.get("cells", F.lit(0)).isNotNull())
    kinds = ["long", "string", "double", "timestamp"]
    shown = rows.select(*[F.get("cells", F.lit(i)).cast(k).alias(c) for i, (c, k) in enumerate(zip(_COLUMNS, kinds))])
    return shown.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


_BOOKS = f"""b AS (SELECT CAST(floor(o_orderkey / {_PER_BOOK}) AS BIGINT) AS book, count(*) AS n FROM orders GROUP BY 1)"""


@query(
    "workbook_contents",
    f"""WITH {_BOOKS} SELECT 'book-' || book || '.xlsx#orders' AS sheet_id, 4 AS columns, n + (n - 1) // 10 AS total_rows, n AS formulas, 4::BIGINT AS merged_cells, n + (n - 1) // 10 AS corpus_rows FROM b
    UNION ALL SELECT 'book-' || book || '.xlsx#none', 0, 0, 0, 0, 0 FROM b""",
)
def workbook_contents(spark, sf):
    cells = _cells(spark, sf)
    corpus = workbook_sheets(cells).rows.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("corpus_rows"))
    marks = cells.filter("error is null").groupBy(F.concat_ws("#", "path", "sheet").alias("sheet_id")).agg(
        F.count(F.when(F.col("formula") == "=A4*2", 1)).alias("formulas"), F.count("merged").alias("merged_cells")
    )
    found = workbook_inventory(cells).join(marks, "sheet_id").join(corpus, "sheet_id", "left")
    return found.withColumn("corpus_rows", F.coalesce("corpus_rows", F.lit(0).cast("long")))


@query(
    "workbook_errors",
    f"""WITH {_BOOKS} SELECT 'cut-' || book || '.xlsx' AS path, 'BadZipFile' AS kind FROM b UNION ALL SELECT 'zip-' || book || '.xlsx', 'KeyError' FROM b""",
)
def workbook_errors(spark, sf):
    return _cells(spark, sf).filter("error is not null").select("path", F.substring_index("error", ":", 1).alias("kind"))


@query(
    "workbook_cell_features",
    f"""WITH {_BOOKS}, c AS (SELECT book, n, unnest([0, 1, 2, 3]) AS col FROM b)
    SELECT 'book-' || book || '.xlsx' AS path, col AS col_idx, round(col / 3, 6) AS col_rel, (CASE WHEN col = 3 THEN n ELSE 0 END)::BIGINT AS bold,
      (CASE WHEN col = 3 THEN n ELSE 0 END)::BIGINT AS bordered, (CASE WHEN col = 3 THEN n ELSE 0 END)::BIGINT AS dates, (CASE WHEN col = 3 THEN 2 ELSE 1 END)::BIGINT AS fills, 1.0::DOUBLE AS lowest FROM c""",
)
def workbook_cell_features(spark, sf):
    found = cell_features(_cells(spark, sf))
    return found.groupBy("path", "col_idx", F.round("col_rel", 6).alias("col_rel")).agg(
        F.count_if("style_bold").alias("bold"), F.count_if("style_border").alias("bordered"), F.count_if(F.col("num_format_family") == "date").alias("dates"),
        F.count_distinct("style_fill_hash").alias("fills"), F.max("row_rel").alias("lowest"),
    )
