import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabprep.functions.parse import as_day, as_epoch, as_number
from tabprep.functions.text import clean_cell, normalize_document_id, normalize_text
from tabprep.operators import clean as cl
from tabprep.operators import profile as pf
from tabprep.sources import tables as tb

ROWS = "sheet_id string, row_idx long, cells array<string>"


def sheet(spark, headers, data, sheet_id="s"):
    return tb.Sheets(
        spark.createDataFrame([(sheet_id, i, r) for i, r in enumerate(data)], ROWS),
        spark.createDataFrame([(sheet_id, i, h) for i, h in enumerate(headers)], tb.HEADERS_DDL),
    )


@pytest.mark.parametrize(
    "given, wanted",
    [
        (["A", "A", "A"], ["A", "A__1", "A__2"]),
        ([" A ", "", None, "col_2"], ["A", "col_2", "col_3", "col_2__1"]),
        (["A", "A", "A__1"], ["A", "A__1", "A__1__1"]),
        (["A__1", "A", "A"], ["A__1", "A", "A__2"]),
    ],
)
def test_headers_are_unique(spark, given, wanted):
    headers = spark.createDataFrame([("s", i, h) for i, h in enumerate(given)], tb.HEADERS_DDL)
    named = [r[2] for r in rows(cl.normalize_headers(headers), "col_idx")]
    assert named == wanted and len(set(named)) == len(named)


def test_cells_are_stripped_of_all_white_space(spark):
    df = spark.createDataFrame([("\t a ",), (" ",), ("",), (None,), ("x y",)], "v string")
    assert [r[0] for r in df.select(clean_cell(F.col("v"))).collect()] == ["a", None, None, None, "x y"]


def test_sparse_columns_and_rows_go(spark):
    data = [["1", "x", None]] * 8 + [[None, None, "z"]] + [["9", " ", None]]
    result = cl.clean(sheet(spark, ["a", "b", "c"], data))
    assert [h[2] for h in rows(result.sheets.headers, "col_idx")] == ["a", "b"]
    report = result.report.first()
    assert (report.source_rows, report.total_rows, report.dropped_rows, report.dropped_columns) == (10, 9, 1, 1)
    assert {r.header: r.coverage for r in result.coverage.collect()} == {"a": 0.9, "b": 0.8, "c": 0.1}
    assert [r[1] for r in rows(cl.renumber_rows(result.sheets).rows, "row_idx")] == list(range(9))


def test_all_columns_stay_when_none_is_dense(spark):
    data = [[None, None]] * 19 + [["1", None]]
    result = cl.clean(sheet(spark, ["a", "b"], data))
    assert result.sheets.headers.count() == 2 and result.report.first().dropped_columns == 0


def test_sheet_without_rows(spark):
    result = cl.clean(sheet(spark, ["a"], []))
    assert result.report.first().total_rows == 0 and result.sheets.rows.count() == 0
    summary = tb.sheet_summary(result.sheets).first()
    assert (summary.total_rows, summary.sample_row_count, summary.truncated) == (0, 0, False)


def test_numbers_and_dates(spark):
    values = ["12", "1e3", ".5", "12d", "NaN", "inf", "1,5", "2024-02-30", "2024-02-29 12:30:15.5", "31/01/2024", "01/31/2024", "2024", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = rows(df.select("i", as_number(F.col("v")), as_day(F.col("v")).cast("string"), as_epoch(F.col("v"))), "i")
    assert [r[1] for r in out][:7] == [12.0, 1000.0, 0.5, None, None, None, None]
    assert [r[2] for r in out][7:] == [None, "2024-02-29", "2024-01-31", "2024-01-31", None, None]
    assert out[8][3] == 1709209815.5


def test_profile_of_edge_columns(spark):
    data = [["Sí", None, "1", "2024-01-01"], ["no", None, "1", "2024-01-02"], ["TRUE", None, "x", "2024-01-03"], [None, None, "2", "n/a"]]
    s = sheet(spark, ["flag", "none", "mix", "day"], data)
    counts = pf.column_counts(pf.value_marks(s))
    ratios = {r.header: r for r in pf.profile(s.headers, counts).collect()}
    assert (ratios["flag"].boolean_ratio, ratios["flag"].unique_ratio) == (1.0, 1.0)
    assert tuple(ratios["none"])[3:] == (0.0, 0.0, 0.0, 0.0)
    assert (ratios["mix"].numeric_ratio, ratios["mix"].unique_ratio) == (0.75, 0.75)
    kinds = {r.header: (r.kind, r.boolean_like) for r in pf.infer_types(s.headers, counts).collect()}
    assert kinds == {"flag": ("categorical", True), "none": ("categorical", False), "mix": ("numeric", False), "day": ("date", False)}
    approx = pf.column_counts_approx(s)
    assert rows(approx, "col_idx") == rows(counts, "col_idx")


def test_boolean_text_keeps_nulls(spark):
    s = sheet(spark, ["flag"], [["Yes"], [None], ["0"], ["si"]])
    types = pf.infer_types(s.headers, pf.column_counts(pf.value_marks(s)))
    typed = pf.coerce(tb.to_cells(s), types)
    assert [r.text for r in typed.orderBy("row_idx").collect()] == ["true", None, "false", "true"]


def test_text_normalisation(spark):
    df = spark.createDataFrame([(" Dirección-Nº 5! ", "12.345.678-9 K")], "a string, b string")
    assert tuple(df.select(normalize_text(F.col("a")), normalize_document_id(F.col("b"))).first()) == ("direccionn 5", "123456789k")


def test_unknown_sheet_is_an_error(spark):
    with pytest.raises(ValueError, match="not found: zz"):
        tb.require_sheets(sheet(spark, ["a"], [["1"]]), ["s", "zz"])


def test_cells_round_trip(spark):
    s = sheet(spark, ["a", "b"], [["1", None], ["2", "x"]])
    back = tb.from_cells(tb.to_cells(s), s.headers)
    assert rows(back.rows, "row_idx") == rows(s.rows, "row_idx")


def test_strip_looks_at_the_ends_only(spark):
    """Texts with visible ends are taken as they are; any other end still goes through the full list of white space."""
    from tabprep.functions.text import _tight, clean_cell, strip

    texts = ["a", " a", "a\x1f", "　a b\xa0", "é", "é ", "~!", "\x7fa", "", "  ", "a b", "1\n", "\ta é", "a\x85", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", strip(F.col("t")).alias("s"), clean_cell(F.col("t")).alias("c"), _tight(F.col("t")).alias("tight")).collect()
    assert [(r.s, r.c) for r in got] == [(t, None) if t is None else (t.strip(), t.strip() or None) for t in texts]
    assert [r.t for r in got if r.tight] == ["a", "~!", "a b"]


def test_guards_before_patterns_change_nothing(spark):
    from tabprep.functions import parse as ps

    texts = [
        "1", "-1.5", "+.5", ".5", "/5", ",5", "1e5", "1-2-2024", "31/12/2024", "12/31/2024", "2024-1-2", "2024-01-02T03:04:05.123456789Z", "2024-01-02 23:59", "123/1/2024",
        "1/2/2024 9:05", "12d", "x1", "TRUE", "Sí", "no", "falsely", "a text that is long", "2024-13-40", "9" * 60, "", "é", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain_day = F.when(t.rlike(ps.ISO_DATE), F.regexp_extract(t, r"^\d{4}-\d{1,2}-\d{1,2}", 0).try_cast("date")).when(
        t.rlike(ps.LOCAL_DATE), F.coalesce(ps._ordered_date(t, "$3-$2-$1"), ps._ordered_date(t, "$3-$1-$2"))
    )
    plain = [F.when(t.rlike(ps.NUMBER), t.try_cast("double")), plain_day, F.lower(t).isin(ps.TRUE_WORDS + ps.FALSE_WORDS)]
    got = df.select(ps.as_number(t), ps.as_day(t), ps.is_boolean(t)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in df.select(*plain).collect()]
    epochs = [r[0] for r in df.filter("t like '2024-01-02%' or t like '%9:05'").select(ps.as_epoch(t)).collect()]
    assert epochs == [1704164645.123456789, 1704239940.0, 1706778300.0]
