"""Registry, table access and the shared sheet corpus of the acceptance queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.operators import scale
from tabprep.sources.tables import Sheets, as_sheet, union_sheets

# Fixed values of the SQL side, written out here so that a slip in the library cannot hide.
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?Z?)?$"
LOCAL_DATE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}([ T]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?Z?)?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def any_of(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def shuffled(name: str) -> None:
    """Register a query a second time with no side small enough to be broadcast, as on large inputs."""
    first = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        usual, scale.BROADCAST_ROWS = scale.BROADCAST_ROWS, 0
        try:
            return first(spark, sf_dir)
        finally:
            scale.BROADCAST_ROWS = usual

    query(f"{name}_shuffled", ORACLES.get(name))(run)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- the corpus: tables seen as sheets of text cells -------------------------------------------

#: sheet -> (FROM clause, row key, [(header, expression)]); the expressions are valid in both engines
CORPUS: dict[str, tuple[str, str, list[tuple[str, str]]]] = {
    "orders": (
        "orders",
        "o_orderkey",
        [(c, c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")],
    ),
    "customer": (
        "customer",
        "c_custkey",
        [(c, c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")],
    ),
    "events": (
        "events",
        "event_id",
        [
            ("event_id", "event_id"),
            ("ts", "ts"),
            ("kind", "nullif(event_type, 'error')"),
            ("value", "case when event_type <> 'view' then value end"),
            ("props", "props"),
            ("flag", "case when event_type = 'click' then 'Yes' when event_type = 'view' then 'NO' when value > 20 then 'Sí' end"),
            ("local_day", "concat(day(ts), '/', month(ts), '/', year(ts))"),
        ],
    ),
    "incidents": (
        "events",
        "event_id",
        [
            ("detail", "case when event_type = 'error' then concat(' ', props, ' ') end"),
            ("amount", "case when event_type in ('click', 'view') then value end"),
            ("peak", "case when value > 200 then value end"),
            ("remark", "case when event_type = 'signup' then '   ' end"),
        ],
    ),
    "documents": (
        "documents left join labels using (doc_id)",
        "doc_id",
        [(c, c) for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")],
    ),
}


def corpus(spark: SparkSession, sf_dir: str, names: list[str] | None = None, skip: tuple[str, ...] = ()) -> Sheets:
    sheets = []
    for name in names or CORPUS:
        source, key, columns = CORPUS[name]
        df = table(spark, sf_dir, source.split()[0])
        if "join labels" in source:
            df = df.join(table(spark, sf_dir, "labels"), "doc_id", "left")
        shown = df.select(
            F.col(key).alias("_key"), *[F.expr(e).alias(h) for h, e in columns if h not in skip]
        )
        sheets.append(as_sheet(shown, name, "_key", [h for h, _ in columns if h not in skip]))
    return union_sheets(sheets)


def cells_sql(names: list[str] | None = None, skip: tuple[str, ...] = ()) -> str:
    """``cells(sheet_id, row_idx, col_idx, header, value)`` with stripped values, blanks null."""
    parts = []
    for name in names or CORPUS:
        source, key, columns = CORPUS[name]
        for i, (header, expression) in enumerate([c for c in columns if c[0] not in skip]):
            parts.append(
                f"SELECT '{name}' AS sheet_id, {key} AS row_idx, {i} AS col_idx, '{header}' AS header,"
                f" nullif(trim(CAST({expression} AS VARCHAR), '{WHITESPACE}'), '') AS value FROM {source}"
            )
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


#: drops columns then rows, on top of ``cells``
CLEANED_SQL = """
cov AS (SELECT sheet_id, col_idx, header, count(*) AS n, count(value) AS filled,
               count(value) / count(*) AS coverage FROM cells GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, max(coverage >= 0.12) OVER (PARTITION BY sheet_id) AS any_dense FROM cov)
         WHERE coverage >= 0.12 OR NOT any_dense),
signal AS (SELECT c.sheet_id, c.row_idx, count(c.value) / count(*) AS share
           FROM cells c JOIN kept USING (sheet_id, col_idx) GROUP BY ALL),
cleaned AS (SELECT c.sheet_id, c.row_idx, c.col_idx, c.header, c.value
            FROM cells c JOIN kept USING (sheet_id, col_idx) JOIN signal s
            ON s.sheet_id = c.sheet_id AND s.row_idx = c.row_idx WHERE s.share >= 0.18)"""

#: parses cleaned cells the way ``tabprep.functions.parse`` does
PARSED_SQL = f"""
parsed AS (SELECT *,
  CASE WHEN regexp_matches(value, '{NUMBER}') THEN TRY_CAST(value AS DOUBLE) END AS num,
  CASE WHEN regexp_matches(value, '{ISO_DATE}')
         THEN TRY_CAST(regexp_extract(value, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AS DATE)
       WHEN regexp_matches(value, '{LOCAL_DATE}') THEN coalesce(
         TRY_CAST(regexp_replace(value, '^(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{4}}).*$', '\\3-\\2-\\1') AS DATE),
         TRY_CAST(regexp_replace(value, '^(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{4}}).*$', '\\3-\\1-\\2') AS DATE)) END AS dt,
  lower(value) IN ('true', '1', 'yes', 'si', 'sí', 'false', '0', 'no') AS boo
  FROM cleaned),
counts AS (SELECT sheet_id, col_idx, header, count(*) AS n_rows, count(value) AS filled, count(num) AS nums,
                  count(dt) AS dts, count(CASE WHEN boo THEN 1 END) AS boos, count(DISTINCT value) AS dist
           FROM parsed GROUP BY ALL),
typed AS (SELECT sheet_id, col_idx, header, kind, kind = 'categorical' AND boos / n_rows > 0.65 AS boolean_like FROM (
  SELECT *, CASE WHEN dts / n_rows > 0.55 AND nums / n_rows < 0.5 THEN 'date'
                 WHEN nums / n_rows > 0.55 OR (nums / n_rows > 0.35 AND dist > 3) THEN 'numeric'
                 ELSE 'categorical' END AS kind FROM counts)),
coerced AS (SELECT p.sheet_id, p.row_idx, p.col_idx, p.header, t.kind, p.value,
  CASE t.kind WHEN 'numeric' THEN num WHEN 'date' THEN
    date_diff('day', DATE '1970-01-01', dt) * 86400.0
    + coalesce(TRY_CAST(regexp_extract(value, '[ T](\\d+):', 1) AS DOUBLE), 0) * 3600
    + coalesce(TRY_CAST(regexp_extract(value, '[ T]\\d+:(\\d+)', 1) AS DOUBLE), 0) * 60
    + coalesce(TRY_CAST(regexp_extract(value, '[ T]\\d+:\\d+:([\\d.]+)', 1) AS DOUBLE), 0) END AS num,
  CASE WHEN t.kind = 'categorical' THEN CASE WHEN NOT t.boolean_like THEN value
       WHEN lower(value) IN ('true', '1', 'yes', 'si', 'sí') THEN 'true'
       WHEN lower(value) IN ('false', '0', 'no') THEN 'false' ELSE lower(value) END END AS txt
  FROM parsed p JOIN typed t USING (sheet_id, col_idx))"""


def cleaned_sql(names=None, skip=()) -> str:
    return "WITH " + cells_sql(names, skip) + "," + CLEANED_SQL


def coerced_sql(names=None, skip=()) -> str:
    return cleaned_sql(names, skip) + "," + PARSED_SQL
