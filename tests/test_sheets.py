"""The workbook data source: what is planned, what is read, and that nothing else comes out than from whole files."""

import random
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNull, LessThan, Not
from test_workbook import FIRST, write_xlsx

from acceptance.workbook_files import _write
from tabprep.operators.validate import file_checks
from tabprep.sources import sheets as sh
from tabprep.sources import tables as tb
from tabprep.sources import workbook as wb

TEXTS = ["plain", " two  blanks ", "a<b>&\"c'", "é 日本 😀", "line\nbreak\ttab", "bell\x07 nul\x00 cr\r", "_x0041_ stays", "_x", "￾", None, "x" * 70_000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    write_xlsx(path / "b.xlsx", {"Uno": FIRST, "Vacía": [], "Dos": FIRST[:2]}, merged=["A2:A3"])
    write_xlsx(path / "A.XLSM", {"Uno": FIRST[:2]})
    (path / "bad.xlsx").write_bytes(b"not a workbook")
    (path / "note.txt").write_text("x")
    (path / "deep").mkdir()
    write_xlsx(path / "deep" / "c.xlsx", {"Tres": FIRST})
    return str(path)


def parts(df):
    return df.rdd.getNumPartitions()


def test_same_cells_as_from_whole_files(spark, folder):
    plain = lambda df: rows(df.withColumn("path", F.regexp_replace("path", "^(file:)?/*", "")), *df.columns[:5])
    assert plain(sh.read_sheets(spark, [folder])) == plain(wb.read_workbooks(spark, [folder]))


def test_only_asked_sheets_are_planned(spark, folder):
    cells = sh.read_sheets(spark, [folder])
    assert parts(cells) == 5  # three sheets, one sheet, one damaged file
    one = cells.filter("sheet = 'Uno'")
    assert parts(one) == 2 and {r.sheet for r in one.collect()} == {"Uno"}
    assert parts(cells.filter("sheet IN ('Dos', 'Vacía') AND path LIKE '%b.xlsx'")) == 2
    assert parts(cells.filter("sheet_ord > 0")) == 2 and parts(cells.filter("sheet IS NULL")) == 1
    assert parts(cells.filter("sheet <> 'Uno'")) == 2 and cells.filter("sheet = 'none'").count() == 0
    assert parts(sh.read_sheets(spark, [folder], recursive=True)) == 6
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "sheets" in plan


def test_rows_and_columns_are_cut_in_the_reader(spark, folder):
    cells = sh.read_sheets(spark, [folder]).filter("sheet = 'Uno' AND path LIKE '%b.xlsx'")
    whole = rows(cells, "row_idx", "col_idx")
    for condition, keep in [
        ("row_idx < 2", lambda r: r[3] < 2), ("row_idx BETWEEN 1 AND 2 AND col_idx = 1", lambda r: 1 <= r[3] <= 2 and r[4] == 1),
        ("col_idx IN (0, 2)", lambda r: r[4] in (0, 2)), ("NOT col_idx = 1", lambda r: r[4] != 1), ("row_idx = 4", lambda r: r[3] == 4),
        ("row_idx < 2 OR col_idx = 2", lambda r: r[3] < 2 or r[4] == 2), ("row_idx IS NULL", lambda r: False), ("value LIKE 'A%'", lambda r: (r[5] or "").startswith("A")),
    ]:
        assert rows(cells.filter(condition), "row_idx", "col_idx") == [r for r in whole if keep(r)], condition


def test_reading_ends_at_the_last_wanted_row(tmp_path):
    _write(f"{tmp_path}/long.xlsx", {"s": (["a"], [[i] for i in range(5000)])})
    with zipfile.ZipFile(tmp_path / "long.xlsx") as z:
        body = z.read("xl/worksheets/s1.xml")
        other = [(n, z.read(n)) for n in z.namelist() if n != "xl/worksheets/s1.xml"]
    with zipfile.ZipFile(tmp_path / "long.xlsx", "w") as z:
        for name, content in other:
            z.writestr(name, content)
        z.writestr("xl/worksheets/s1.xml", body[: len(body) // 2])  # breaks off, so reading on would give an error row
    reader = sh.SheetsReader([str(tmp_path)], False, 2)
    assert list(reader.pushFilters([LessThan(("row_idx",), 50), EqualTo(("value",), "7"), Not(In(("col_idx",), (3,)))])) == [EqualTo(("value",), "7")]
    (part,) = reader.partitions()
    got = [r for batch in reader.read(part) for r in batch.to_pylist()]
    assert [r["row_idx"] for r in got] == list(range(50)) and not any(r["error"] for r in got)
    every = sh.SheetsReader([str(tmp_path)], False, 2)
    last = [r for batch in every.read(part) for r in batch.to_pylist()]
    assert 1000 < len(last) < 5000 and last[-1]["error"] and last[-1]["sheet"] == "s" and last[-2]["value"] == str(last[-2]["row_idx"] - 1)


def test_unknown_outcomes_are_not_true():
    assert not sh._passes(EqualTo(("sheet",), "a"), None) and not sh._passes(Not(EqualTo(("sheet",), "a")), None)
    assert sh._passes(IsNull(("sheet",)), None) and not sh._passes(LessThan(("row_idx",), None), 3)
    assert sh._column(Not(IsNull(("sheet",)))) is None and sh._column(EqualTo(("sheet", "x"), 1)) is None


def test_texts_come_back_whole(spark, tmp_path):
    _write(f"{tmp_path}/t.xlsx", {"t": (["n", "text"], [[i, t] for i, t in enumerate(TEXTS)])})
    got = wb.workbook_sheets(sh.read_sheets(spark, [f"{tmp_path}/t.xlsx"])).rows.orderBy("row_idx").collect()
    assert [r.cells for r in got] == [[str(i), t] for i, t in enumerate(TEXTS)]


def test_characters_of_all_kinds(spark, tmp_path):
    pick = random.Random(4)
    texts = ["".join(chr(pick.choice([pick.randrange(1, 0x250), pick.randrange(0x1F300, 0x1F600), pick.randrange(0x5F, 0x60), 120, 48])) for _ in range(40)) for _ in range(60)]
    _write(f"{tmp_path}/t.xlsx", {"t": (["text"], [[t] for t in texts])})
    assert [r.value for r in sh.read_sheets(spark, [str(tmp_path)]).filter("row_idx > 0").orderBy("row_idx").collect()] == texts


def test_no_path_and_no_file(spark, tmp_path):
    with pytest.raises(Exception, match="no path"):
        sh.read_sheets(spark, []).count()
    assert sh.read_sheets(spark, [str(tmp_path)]).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError|No such|not found"):
        sh.read_sheets(spark, [f"{tmp_path}/none"]).count()


def test_damaged_is_not_empty(spark):
    files = spark.createDataFrame(
        [("a.xlsx", 5, None, "BadZipFile: x"), ("b.xlsx", 5, None, None), ("c.xlsx", 5, 3, None), ("d.xls", 5, 3, "KeyError: y")],
        "path string, length long, total_rows long, error string",
    )
    assert [r.reasons for r in file_checks(files, 10).orderBy("path").collect()] == [["file-damaged"], ["file-empty"], [], ["invalid-extension", "file-damaged"]]
    assert [r.reasons for r in file_checks(files.drop("error"), 10).orderBy("path").collect()][0] == ["file-empty"]


def test_numbers_of_rows_without_an_order_stay(spark):
    shuffled = spark.range(200).repartition(9).selectExpr("cast(rand() * 1000000 as int) AS a", "id AS b")
    sheet = tb.as_sheet(shuffled, "s")
    first, again = (rows(sheet.rows.select("row_idx", "cells"), "row_idx") for _ in range(2))
    assert first == again and len({r[0] for r in first}) == 200
