from pyspark.sql import functions as F

from acceptance.base import cells_sql, cleaned_sql, corpus, query, table
from tabprep.operators import clean as cl
from tabprep.operators.scale import attach
from tabprep.sources import sinks
from tabprep.sources import tables as tb

ALL = cells_sql()


@query(
    "sheet_cells",
    f"WITH {ALL} SELECT sheet_id, header, count(value) AS filled, sum(length(value))::BIGINT AS total_length,"
    " sum(row_idx)::BIGINT AS row_sum FROM cells GROUP BY ALL",
)
def sheet_cells(spark, sf):
    sheets = cl.strip_cells(corpus(spark, sf))
    cells = tb.to_cells(sheets).join(sheets.headers, ["sheet_id", "col_idx"])
    return cells.groupBy("sheet_id", "header").agg(
        F.count("value").alias("filled"), F.sum(F.length("value")).alias("total_length"), F.sum("row_idx").alias("row_sum")
    )


@query(
    "cells_to_wide",
    "SELECT c_custkey AS row_idx, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS"
    " c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer",
)
def cells_to_wide(spark, sf):
    sheets = corpus(spark, sf, ["customer"])
    back = tb.from_cells(tb.to_cells(sheets), sheets.headers)
    return tb.to_wide(back, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query(
    "selected_sheets",
    f"WITH {ALL} SELECT sheet_id, count(DISTINCT row_idx) AS total_rows FROM cells WHERE sheet_id IN"
    " ('orders', 'customer') GROUP BY 1",
)
def selected_sheets(spark, sf):
    chosen = tb.require_sheets(corpus(spark, sf), ["orders", "customer"])
    return tb.sheet_summary(chosen).select("sheet_id", "total_rows")


@query(
    "missing_sheets",
    "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS sheet_id FROM orders WHERE o_custkey NOT IN"
    " (SELECT user_id FROM events) ORDER BY 1",
)
def missing_sheets(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("sheet_id"))
    present = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("sheet_id"))
    return tb.missing_sheets(asked, present)


@query(
    "preview_first_rows",
    """WITH r AS (SELECT user_id, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
       SELECT CAST(user_id AS VARCHAR) AS sheet_id, k AS preview_idx,
              coalesce(nullif(event_type, 'error'), '') AS kind, CAST(value AS VARCHAR) AS amount
       FROM r WHERE k <= 50""",
)
def preview_first_rows(spark, sf):
    events = table(spark, sf, "events").withColumn("kind", F.expr("nullif(event_type, 'error')"))
    sheets = tb.as_sheet(events, F.col("user_id").cast("string"), "event_id", ["kind", "value"])
    return tb.preview_rows(sheets).select(
        "sheet_id", F.col("preview_idx").cast("long").alias("preview_idx"), F.get("cells", F.lit(0)).alias("kind"),
        F.get("cells", F.lit(1)).alias("amount"),
    )


@query(
    "row_cap_report",
    """SELECT CAST(user_id AS VARCHAR) AS sheet_id, count(*) AS source_rows, count(*) > 60 AS truncated,
              least(count(*), 60) AS kept_rows FROM events GROUP BY 1""",
)
def row_cap_report(spark, sf):
    sheets = tb.as_sheet(table(spark, sf, "events"), F.col("user_id").cast("string"), "event_id", ["event_type"])
    capped, report = tb.cap_rows(sheets, 60)
    kept = capped.rows.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("kept_rows"))
    return report.join(kept, "sheet_id")


@query(
    "workbook_totals",
    """SELECT CAST(user_id AS VARCHAR) AS workbook_id, count(DISTINCT CAST(ts AS DATE)) AS total_sheets,
              count(*) AS total_rows_estimate FROM events GROUP BY 1""",
)
def workbook_totals(spark, sf):
    events = table(spark, sf, "events")
    per_sheet = events.groupBy(
        F.col("user_id").cast("string").alias("workbook_id"), F.to_date("ts").alias("sheet_id")
    ).agg(F.count(F.lit(1)).alias("total_rows"))
    return tb.workbook_summary(per_sheet)


@query(
    "sheet_navigation",
    """WITH s AS (SELECT DISTINCT user_id AS workbook_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS sheet_id FROM events),
       l AS (SELECT *, lag(sheet_id) OVER w AS prev, lead(sheet_id) OVER w AS nxt, count(*) OVER (PARTITION BY workbook_id)
             AS available, first_value(sheet_id) OVER w AS head FROM s WINDOW w AS (PARTITION BY workbook_id ORDER BY sheet_id)),
       q AS (SELECT user_id AS workbook_id, max(CAST(CAST(ts AS DATE) AS VARCHAR)) AS wanted FROM events
             WHERE event_type = 'error' AND value > 100 GROUP BY 1)
       SELECT l.workbook_id, sheet_id AS "current", prev AS "previous", nxt AS "next", available
       FROM l LEFT JOIN q USING (workbook_id) WHERE sheet_id = coalesce(wanted, head)""",
)
def sheet_navigation(spark, sf):
    events = table(spark, sf, "events").withColumn("sheet_id", F.to_date("ts").cast("string"))
    sheets = events.select(F.col("user_id").alias("workbook_id"), "sheet_id").distinct()
    asked = events.filter("event_type = 'error' and value > 100").groupBy(F.col("user_id").alias("workbook_id")).agg(
        F.max("sheet_id").alias("sheet_id")
    )
    return tb.navigation(sheets.withColumn("sheet_ord", F.col("sheet_id")), asked)


@query(
    "header_normalization",
    """WITH h AS (SELECT doc_id, line_no, trim(line) AS label FROM (
         SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)),
       n AS (SELECT doc_id, line_no, CASE WHEN label = '' THEN 'col_' || (line_no + 1) ELSE label END AS label FROM h),
       k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY line_no) - 1 AS k FROM n)
       SELECT CAST(doc_id AS VARCHAR) AS sheet_id, line_no::INTEGER AS col_idx,
              CASE WHEN k = 0 THEN label ELSE label || '__' || k END AS header FROM k""",
)
def header_normalization(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select(
        F.col("doc_id").cast("string").alias("sheet_id"), F.posexplode(F.split("text", "\n")).alias("col_idx", "header")
    )
    return cl.normalize_headers(lines)


@query(
    "column_coverage",
    f"WITH {ALL} SELECT sheet_id, header, count(*) AS n, count(value) AS filled, round(count(value) / count(*), 6) AS"
    " coverage FROM cells GROUP BY ALL",
)
def column_coverage(spark, sf):
    covered = cl.coverage(cl.strip_cells(corpus(spark, sf)))
    return covered.select("sheet_id", "header", "n", "filled", F.round("coverage", 6).alias("coverage"))


@query(
    "clean_report",
    cleaned_sql()
    + """ SELECT s.sheet_id, source_rows, total_rows, source_rows - total_rows AS dropped_rows, dropped_columns FROM
    (SELECT sheet_id, count(*) AS source_rows, count(CASE WHEN share >= 0.18 THEN 1 END) AS total_rows FROM signal GROUP BY 1) s
    JOIN (SELECT sheet_id, count(*) - count(CASE WHEN k.col_idx IS NOT NULL THEN 1 END) AS dropped_columns
          FROM cov LEFT JOIN kept k USING (sheet_id, col_idx) GROUP BY 1) c USING (sheet_id)""",
)
def clean_report(spark, sf):
    return cl.clean(corpus(spark, sf)).report.withColumn("dropped_columns", F.col("dropped_columns").cast("long"))


@query(
    "clean_rows",
    cleaned_sql() + " SELECT sheet_id, row_idx, header, value FROM cleaned",
)
def clean_rows(spark, sf):
    cleaned = cl.clean(corpus(spark, sf)).sheets
    return attach(tb.to_cells(cleaned), cleaned.headers, ["sheet_id", "col_idx"], how="inner").select(
        "sheet_id", "row_idx", "header", "value"
    )


@query(
    "renumbered_rows",
    cleaned_sql(["incidents"])
    + """ SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY source_row) - 1 AS row_idx, detail, amount FROM
      (SELECT sheet_id, row_idx AS source_row, max(CASE WHEN header = 'detail' THEN value END) AS detail,
              max(CASE WHEN header = 'amount' THEN value END) AS amount FROM cleaned GROUP BY ALL)""",
)
def renumbered_rows(spark, sf):
    cleaned = cl.renumber_rows(cl.clean(corpus(spark, sf, ["incidents"])).sheets)
    return cleaned.rows.select(
        "sheet_id", "row_idx", F.get("cells", F.lit(0)).alias("detail"), F.get("cells", F.lit(1)).alias("amount")
    )


@query(
    "normalized_export",
    cleaned_sql()
    + """ SELECT sheet_id, row_idx, string_agg(coalesce(value, ''), '|' ORDER BY col_idx) AS line FROM cleaned GROUP BY ALL""",
)
def normalized_export(spark, sf):
    from tabprep.session import scratch_path

    path = scratch_path(spark, "export")
    sinks.normalize_export(cl.clean(corpus(spark, sf)).sheets, path)
    back = spark.read.schema("sheet_id string, row_idx long, cells array<string>").json(path)
    return back.select("sheet_id", "row_idx", F.concat_ws("|", "cells").alias("line"))
