import zipfile

import pytest
from conftest import rows

from tabprep.operators.clean import clean
from tabprep.sources import tables as tb
from tabprep.sources import workbook as wb

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_xlsx(path, sheets, merged=()):
    """A minimal workbook: ``sheets`` maps names to rows of raw ``<c>`` bodies."""
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>Cliente</t></si><si><r><t>Fe</t></r><r><t>cha</t></r></si><si><t>NA</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, body in enumerate(sheets.values(), 1):
            data = "".join(
                f'<row r="{r}">' + "".join(c.replace("@", f"{chr(65 + k)}{r}") for k, c in enumerate(cells) if c) + "</row>"
                for r, cells in enumerate(body, 1) if any(cells)
            )
            ranges = "".join(f'<mergeCell ref="{m}"/>' for m in merged)
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{data}</sheetData><mergeCells>{ranges}</mergeCells></worksheet>')


SHARED = '<c r="@" t="s"><v>{}</v></c>'
FIRST = [
    [SHARED.format(0), SHARED.format(1), '<c r="@" t="inlineStr"><is><t>Total</t></is></c>'],
    ['<c r="@" t="str"><v>Ana</v></c>', '<c r="@" s="1"><v>45292</v></c>', '<c r="@"><f>SUM(D:D)</f><v>12</v></c>'],
    [SHARED.format(2), '<c r="@" s="1"><v>45293.5</v></c>', '<c r="@"><v>1.5</v></c>'],
    [None, None, None],
    ['<c r="@" t="b"><v>1</v></c>', '<c r="@" t="e"><v>#DIV/0!</v></c>', None],
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    write_xlsx(path / "b.xlsx", {"Uno": FIRST, "Vacía": []}, merged=["A2:A3"])
    write_xlsx(path / "A.XLSM", {"Uno": FIRST[:2]})
    (path / "bad.xlsx").write_bytes(b"not a workbook")
    (path / "note.txt").write_text("x")
    return path


def test_discovery(spark, folder):
    assert rows(wb.discover(spark, [str(folder)]).select("name", "supported"), "name") == [
        ("A.XLSM", True), ("b.xlsx", True), ("bad.xlsx", True), ("note.txt", False),
    ]


def test_cells(spark, folder):
    cells = wb.read_workbooks(spark, [str(folder)])
    found = {(r.row_idx, r.col_idx): r for r in cells.filter("path like '%b.xlsx' and sheet = 'Uno'").collect()}
    assert [found[(0, c)].value for c in range(3)] == ["Cliente", "Fecha", "Total"]
    assert (found[(1, 1)].value, found[(2, 1)].value) == ("2024-01-01 00:00:00", "2024-01-02 12:00:00")
    assert (found[(1, 2)].value, found[(1, 2)].formula, found[(2, 2)].value) == ("12", "=SUM(D:D)", "1.5")
    assert (found[(1, 0)].merged, found[(4, 0)].value, found[(4, 1)].value) == ("A2:A3", "True", None)
    assert cells.filter("error is not null").select("path").first().path.endswith("bad.xlsx")


def test_workbooks_become_sheets(spark, folder):
    cells = wb.read_workbooks(spark, [str(folder)])
    sheets = wb.workbook_sheets(cells)
    one = tb.select_sheets(sheets, [r.sheet_id for r in sheets.headers.filter("sheet_id like '%b.xlsx#Uno'").distinct().collect()][:1])
    assert [r.cells for r in one.rows.orderBy("row_idx").collect()] == [
        ["Ana", "2024-01-01 00:00:00", "12"], [None, "2024-01-02 12:00:00", "1.5"], [None, None, None], ["True", None, None],
    ]
    listed = {r.sheet_id.rsplit("/")[-1]: (r.columns, r.total_rows) for r in wb.workbook_inventory(cells).collect()}
    assert listed["b.xlsx#Vacía"] == (0, 0) and listed["b.xlsx#Uno"] == (3, 4)
    assert clean(sheets).report.count() == 2
    index = wb.workbook_index(cells)
    moved = {r.workbook_id.rsplit("/")[-1]: r for r in tb.navigation(index).collect()}
    assert moved["b.xlsx"].next.endswith("#Vacía") and moved["A.XLSM"].next is None


def test_rows_are_let_go_once_read(tmp_path):
    """Of 50,000 rows only empty elements stay while a sheet is read, and each row is told by its end alone."""
    import io
    import tracemalloc

    from tabprep.sources import workbook as wb

    told = []
    real = wb.ElementTree.iterparse
    body = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="inlineStr"><is><t>{"x" * 200}</t></is></c></row>' for i in range(1, 50_001))
    part = f'<worksheet xmlns="{wb._NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>'.encode()
    wb.ElementTree.iterparse = lambda stream, events: told.append(events) or real(stream, events)
    try:
        tracemalloc.start()
        rows = sum(len(list(row)) for row in wb._children(io.BytesIO(part), f"{wb._NS}row"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        wb.ElementTree.iterparse = real
    assert rows == 100_000 and told == [("end",)] and peak < 12 << 20


def test_rows_are_grouped_after_they_moved(spark, monkeypatch):
    """The task that reads cells holds no row; those that put rows together meet so many at most."""
    from pyspark.sql import functions as F

    from tabprep.sources import workbook as wb

    monkeypatch.setattr(wb, "ROWS_PER_TASK", 100)
    cells = spark.range(8_000).selectExpr(
        "'p' AS path", "'s' AS sheet", "id div 4 AS row_idx", "cast(id % 4 AS int) AS col_idx", "cast(id AS string) AS value", "cast(null AS string) AS error"
    )
    rows = wb.workbook_sheets(cells).rows
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_999 and len(sizes) == 20 and max(sizes) < 200
    assert rows.filter("row_idx = 7").first().cells == ["32", "33", "34", "35"]
