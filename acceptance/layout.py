"""Structure, fingerprints, templates and missingness of sheets derived from events."""

from pyspark.sql import functions as F

from acceptance import fixed as lx
from acceptance.base import query, table
from acceptance.semantics import CATALOGUE, LABEL, SHEET, catalogue, classified_sql
from tabprep.operators import headers as hd
from tabprep.operators import structure as st
from tabprep.operators import templates as tp
from tabprep.session import materialize
from tabprep.sources.tables import Sheets

# one endless sheet: blank where an error was logged, else two to four cells
_CELLS = [
    "case when event_type <> 'error' then event_type end",
    "case when event_type <> 'error' then cast(value as {s}) end",
    "case when event_type in ('click', 'view') and value > 20 then props end",
    "case when event_type = 'signup' then 'x' end",
]


def _endless(spark, sf):
    events = table(spark, sf, "events")
    cells = F.array(*[F.expr(c.format(s="string")) for c in _CELLS])
    rows = events.select(F.lit("events").alias("sheet_id"), F.col("event_id").alias("row_idx"), cells.alias("cells"))
    return Sheets(rows, spark.createDataFrame([("events", i, f"c{i}") for i in range(4)], "sheet_id string, col_idx int, header string"))


_ROWS = (
    "r AS (SELECT event_id AS row_idx, [" + ", ".join(c.format(s="varchar") for c in _CELLS) + "] AS cells FROM events WHERE event_type <> 'error'),"
    """ f AS (SELECT *, list_filter([1, 2, 3, 4], lambda i: cells[i] IS NOT NULL) AS places FROM r),
    p AS (SELECT *, lag(row_idx) OVER (ORDER BY row_idx) AS prev FROM f),
    s AS (SELECT *, last_value(CASE WHEN prev IS NULL OR prev < row_idx - 1 THEN row_idx END IGNORE NULLS) OVER (ORDER BY row_idx) AS table_start FROM p),
    t AS (SELECT table_start, max(row_idx) AS last_row, min(list_min(places)) - 1 AS first_col, max(list_max(places)) - 1 AS last_col,
      arg_min(cells, row_idx) AS header_cells, sum(CASE WHEN row_idx > table_start THEN len(places) ELSE 0 END) AS dat,
      sum(CASE WHEN row_idx = table_start THEN len(places) ELSE 0 END) AS head FROM s GROUP BY 1),
    u AS (SELECT *, last_row - table_start AS data_rows, last_col - first_col + 1 AS width FROM t),
    tabs AS (SELECT *, chr((65 + first_col)::INT) || (table_start + 1) || ':' || chr((65 + last_col)::INT) || (table_start + 1) AS header_range,
      CASE WHEN data_rows > 0 THEN chr((65 + first_col)::INT) || (table_start + 2) || ':' || chr((65 + last_col)::INT) || (last_row + 1) END AS data_range,
      0.6::DOUBLE * (head / width) + 0.4::DOUBLE * CASE WHEN data_rows > 0 THEN dat / (width * data_rows) ELSE 0 END AS conf FROM u)"""
)


@query(
    "detected_tables",
    f"WITH {_ROWS} SELECT table_start, last_row, data_rows, header_range, data_range, round(conf, 4) AS confidence FROM tabs",
)
def detected_tables(spark, sf):
    return st.detect_tables(_endless(spark, sf)).select(
        "table_start", "last_row", "data_rows", "header_range", "data_range", "confidence"
    )


_COLS = """, cols AS (SELECT table_start, i - 1 AS col_idx, header_cells[i] AS header, CASE WHEN data_rows > 0 THEN
  chr((64 + i)::INT) || (table_start + 2) || ':' || chr((64 + i)::INT) || (last_row + 1) END AS data_range
  FROM tabs, (VALUES (1), (2), (3), (4)) v(i) WHERE header_cells[i] IS NOT NULL)"""


@query("table_columns", f"WITH {_ROWS}{_COLS} SELECT table_start, col_idx, header, data_range FROM cols")
def table_columns(spark, sf):
    return st.table_columns(st.detect_tables(_endless(spark, sf))).drop("sheet_id")


@query(
    "anchor_labels",
    f"WITH {_ROWS}{_COLS} SELECT header AS label, arg_min(chr((65 + col_idx)::INT) || (table_start + 1), struct_pack(a := table_start, b := col_idx)) AS cell"
    " FROM cols GROUP BY 1",
)
def anchor_labels(spark, sf):
    return st.anchors(st.table_columns(st.detect_tables(_endless(spark, sf)))).drop("sheet_id")


def _formulas(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sheet_id"), F.col("l_orderkey").alias("row_idx"), F.col("l_linenumber").alias("col_idx"),
        F.expr("case when l_discount > 0.02 then concat('=PRICE*', cast(l_discount as string)) end").alias("formula"),
        F.expr("case when l_tax > 0 then concat('pct-', cast(l_tax as string)) end").alias("format"),
    )


def _index_sql(what, expression):
    return f"""WITH c AS (SELECT l_returnflag AS sheet_id, {expression} AS {what}, struct_pack(r := l_orderkey, c := l_linenumber) AS spot FROM lineitem)
    SELECT sheet_id, {what}, count(*) AS occurrences, chr(65 + struct_extract(min(spot), 'c')) || (struct_extract(min(spot), 'r') + 1) AS first_cell, chr(65 + struct_extract(max(spot), 'c')) || (struct_extract(max(spot), 'r') + 1) AS last_cell
    FROM c WHERE {what} IS NOT NULL GROUP BY 1, 2"""


_FORMULA = "CASE WHEN l_discount > 0.02 THEN '=PRICE*' || l_discount END"


@query("formula_index", _index_sql("formula", _FORMULA))
def formula_index(spark, sf):
    return st.occurrence_index(_formulas(spark, sf), "formula")


@query("format_groups", _index_sql("format", "CASE WHEN l_tax > 0 THEN 'pct-' || l_tax END"))
def format_groups(spark, sf):
    return st.occurrence_index(_formulas(spark, sf), "format")


@query(
    "formula_cells",
    f"SELECT l_returnflag AS sheet_id, {_FORMULA} AS formula, chr(65 + l_linenumber) || (l_orderkey + 1) AS cell FROM lineitem WHERE l_discount > 0.02",
)
def formula_cells(spark, sf):
    return st.occurrences(_formulas(spark, sf), "formula")


# a sheet per user and day; two tables per sheet, split at noon; marks from what the day logged
_MARKS = f"""sh AS (SELECT {SHEET.replace('cast(ts as date)', 'cast(cast(ts as date) as varchar)')} AS sheet_id, event_id, event_type, value, props, hour(ts) >= 12 AS late, {LABEL} AS header FROM events),
  marks AS (SELECT sheet_id, CASE WHEN max(value) > 100 THEN 'anchor-hash' WHEN max(value) > 60 THEN 'anchor-' || min(event_type) END AS anchor_hash,
    CASE WHEN count(*) > 1 THEN 'formula-fp' END AS formula_fingerprint FROM sh GROUP BY 1),
  labels AS (SELECT sheet_id, late, string_agg(lower(header), '|' ORDER BY lower(header)) AS l FROM sh GROUP BY 1, 2),
  prints AS (SELECT sheet_id, coalesce(anchor_hash, 'unknown-anchor') || '::' || coalesce(formula_fingerprint, 'unknown-formula') || '::' || string_agg(l, '::' ORDER BY late)
    AS fingerprint FROM marks JOIN labels USING (sheet_id) GROUP BY sheet_id, anchor_hash, formula_fingerprint)"""


def _columns(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        F.expr(SHEET).alias("sheet_id"), F.expr("cast(hour(ts) >= 12 as int)").alias("table_start"), F.col("event_id").alias("col_idx"),
        F.expr(LABEL).alias("header"), "event_type", "value", "props",
    )


def _prints(spark, sf):
    columns = _columns(spark, sf)
    marks = columns.groupBy("sheet_id").agg(
        F.expr("case when max(value) > 100 then 'anchor-hash' when max(value) > 60 then concat('anchor-', min(event_type)) end").alias("anchor_hash"),
        F.expr("case when count(*) > 1 then 'formula-fp' end").alias("formula_fingerprint"),
    )
    return st.fingerprints(columns, marks)


_HASHES = """, placed AS (SELECT sheet_id, md5((row_number() OVER (PARTITION BY sheet_id ORDER BY late) - 1) || ':' || l) AS m FROM labels),
  hashes AS (SELECT sheet_id, sha256(sum(('0x' || substr(m, 1, 15))::UBIGINT) || ':' || sum(('0x' || substr(m, 17, 15))::UBIGINT) || ':' || count(*)) AS tables_hash FROM placed GROUP BY 1)"""


@query("sheet_fingerprints", f"WITH {_MARKS}{_HASHES} SELECT sheet_id, fingerprint, tables_hash FROM prints JOIN hashes USING (sheet_id)")
def sheet_fingerprints(spark, sf):
    return _prints(spark, sf)


@query(
    "sheet_signatures",
    f"""WITH {CATALOGUE}, d AS (SELECT DISTINCT sheet_id, header FROM catalogue)
    SELECT sheet_id, sha256(coalesce(sum(('0x' || substr(md5(header), 1, 15))::UBIGINT), 0)::VARCHAR || ':' || coalesce(sum(('0x' || substr(md5(header), 17, 15))::UBIGINT), 0)::VARCHAR || ':' || count(*)) AS anchor_hash FROM d GROUP BY 1""",
)
def sheet_signatures(spark, sf):
    return st.signature(catalogue(spark, sf), "header", "anchor_hash")


# the fixed entry, plus prefixes seen in real fingerprints: shorter, overlapping ones come later
_KNOWN = [
    (0, "anchor-hash::formula-fp", "template-historic", "v1"),
    (1, "anchor-click::formula-fp::activo", "template-mass", "v3"),
    (2, "anchor-click::formula-fp", "template-adhoc", "v2"),
    (3, "anchor-hash", "template-mass", "v3"),
]
_KNOWN_SQL = f""", known(ord, prefix, template_id, template_version_id) AS (VALUES {', '.join(str(k) for k in _KNOWN)}),
  matched AS (SELECT p.sheet_id, p.fingerprint, k.template_id, k.template_version_id FROM prints p LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY ord) AS r FROM prints JOIN known ON starts_with(fingerprint, prefix)) k
    ON k.sheet_id = p.sheet_id AND r = 1)"""


def _matched(spark, sf):
    known = spark.createDataFrame(_KNOWN, "ord int, prefix string, template_id string, template_version_id string")
    return st.match_fingerprints(_prints(spark, sf), known)


@query("known_fingerprints", f"WITH {_MARKS}{_KNOWN_SQL} SELECT * FROM matched")
def known_fingerprints(spark, sf):
    return _matched(spark, sf)


# a catalog with low scores reaches every branch of the decision
_CATALOG = [("template-historic", "v1", 0.68), ("template-mass", "v3", 0.62), ("template-adhoc", "v2", 0.57)]


def _scores_sql(catalog):
    rows = ", ".join(f"({i}, '{t}', '{v}', {b}::DOUBLE)" for i, (t, v, b) in enumerate(catalog))
    return f"""WITH {CATALOGUE}, {classified_sql('catalogue')}, {_MARKS}{_KNOWN_SQL},
  summ AS (SELECT sheet_id, avg(confidence) AS conf, count(*) FILTER (type IN ('date', 'number', 'text')) AS keys, count(DISTINCT type) AS types
    FROM classified GROUP BY 1),
  tmpl(ord, tid, ver, base) AS (VALUES {rows}),
  sug AS (SELECT s.sheet_id, ord, tid, ver, m.template_id, coalesce(tid = m.template_id AND ver = m.template_version_id, false) AS hit,
    round(least(0.99, base + CASE WHEN keys >= 2 AND conf > 0.62 THEN 0.06 ELSE 0 END + CASE WHEN types >= 4 THEN 0.03 ELSE 0 END
      + CASE WHEN coalesce(tid = m.template_id AND ver = m.template_version_id, false) THEN 0.12 ELSE 0 END
      - CASE WHEN conf < 0.45 THEN 0.08 ELSE 0 END), 3) AS score
    FROM summ s JOIN matched m USING (sheet_id), tmpl)"""


def _scored(spark, sf, catalog):
    classified = hd.classify_columns(catalogue(spark, sf))
    return tp.score_templates(tp.class_summary(classified), _matched(spark, sf), catalog)


@query(
    "template_scores",
    _scores_sql(lx.TEMPLATES) + """ SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, ord)::INTEGER AS rank, tid AS template_id,
    ver AS template_version_id, score::DOUBLE AS score, hit AS fingerprint_hit FROM sug""",
)
def template_scores(spark, sf):
    ranked = _scored(spark, sf, lx.TEMPLATES).select("sheet_id", F.posexplode("suggestions").alias("i", "s"))
    return ranked.select(
        "sheet_id", (F.col("i") + 1).alias("rank"), "s.template_id", "s.template_version_id", "s.score", "s.fingerprint_hit"
    )


_DECIDED = _scores_sql(_CATALOG) + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, ord) AS k,
    CASE WHEN hit THEN 0 WHEN score >= 0.85 THEN 1 END AS strength FROM sug),
  dec AS (SELECT sheet_id, arg_min(tid, strength * 100 + k) AS strong_template, arg_min(ver, strength * 100 + k) AS strong_version,
    coalesce(arg_min(tid, strength * 100 + k), arg_min(tid, k)) AS top_template, coalesce(arg_min(score, strength * 100 + k), arg_min(score, k))::DOUBLE AS top_score,
    count(strength) = 0 AND bool_and(score < 0.7) AS propose_new, any_value(template_id) AS known FROM ranked GROUP BY 1)"""


@query(
    "template_decisions",
    _DECIDED + """ SELECT * EXCLUDE (known), round(top_score * 100)::INTEGER AS friendly_score, CASE WHEN strong_template IS NULL THEN 'below-similarity-bar'
    WHEN known IS NOT NULL THEN 'known-fingerprint' ELSE 'schema-and-scores' END AS rationale, concat_ws(',', 'check-headers-and-dates',
    CASE WHEN known IS NOT NULL THEN 'confirm-repeat-upload,confirm-client-and-project' END, CASE WHEN propose_new THEN 'draft-new-template' END) AS next_steps FROM dec""",
)
def template_decisions(spark, sf):
    return tp.decide_template(_scored(spark, sf, _CATALOG)).withColumn("next_steps", F.array_join("next_steps", ","))


@query(
    "template_outcomes",
    _DECIDED + """ SELECT sheet_id, CASE WHEN m > 200 THEN 'block' WHEN strong_template IS NOT NULL THEN 'reuse' WHEN propose_new THEN 'propose' ELSE 'review' END AS outcome
    FROM dec JOIN (SELECT sheet_id, max(value) AS m FROM sh GROUP BY 1) USING (sheet_id)""",
)
def template_outcomes(spark, sf):
    fits = _columns(spark, sf).groupBy("sheet_id").agg((F.max("value") <= 200).alias("compatible"))
    return tp.template_outcome(tp.decide_template(_scored(spark, sf, _CATALOG)), fits)


@query(
    "repeat_uploads",
    f"""WITH {CATALOGUE}, {classified_sql('catalogue')}, {_MARKS}{_KNOWN_SQL}, d AS (SELECT sheet_id, string_agg(header, ',' ORDER BY col_idx) AS dates
      FROM classified WHERE type = 'date' GROUP BY 1)
    SELECT sheet_id, fingerprint, coalesce(dates, '') AS confirmed_date_columns, 'cliente,proyecto' AS required_prompts, true AS template_exists,
    CASE WHEN dates IS NULL THEN 'confirm-template' ELSE 'confirm-dates' END AS note FROM matched LEFT JOIN d USING (sheet_id) WHERE template_id IS NOT NULL""",
)
def repeat_uploads(spark, sf):
    hints = tp.repeat_hint(_matched(spark, sf), hd.classify_columns(catalogue(spark, sf)))
    for c in ("confirmed_date_columns", "required_prompts"):
        hints = hints.withColumn(c, F.array_join(c, ","))
    return hints


SHAPE_SQL = f"""{_MARKS}, shape AS (SELECT sheet_id, count(DISTINCT late) AS tables, count(*) AS columns, count(DISTINCT header) AS anchors,
    count(DISTINCT CASE WHEN value > 30 THEN props END) AS formats, count(DISTINCT CASE WHEN event_type = 'purchase' THEN props END) AS formulas FROM sh GROUP BY 1),
  rate AS (SELECT *, round(least(0.95, greatest(0.35, CASE WHEN tables > 1 THEN 0.2 ELSE 0.12 END + least(anchors, 3) * 0.08 + least(formats, 5) * 0.05
    + CASE WHEN formulas > 0 THEN 0.08 ELSE 0 END + CASE WHEN columns >= 8 THEN 0.2 WHEN columns >= 4 THEN 0.1 ELSE 0.04 END)), 2)::DOUBLE AS confidence FROM shape),
  sig AS (SELECT *, CASE WHEN confidence < 0.5 OR columns < 3 THEN 'MNAR' WHEN confidence > 0.72 THEN 'MAR' ELSE 'MCAR' END AS signal FROM rate),
  mis AS (SELECT *, signal <> 'MNAR' AND confidence >= 0.58 AS imputation_permitted FROM sig)"""


def shape(spark, sf):
    return _columns(spark, sf).groupBy("sheet_id").agg(
        F.countDistinct("table_start").alias("tables"), F.count(F.lit(1)).alias("columns"), F.countDistinct("header").alias("anchors"),
        F.countDistinct(F.expr("case when value > 30 then props end")).alias("formats"),
        F.countDistinct(F.expr("case when event_type = 'purchase' then props end")).alias("formulas"),
    )


@query(
    "missingness_signals",
    f"""WITH {SHAPE_SQL} SELECT sheet_id, signal, confidence, imputation_permitted, concat_ws(',', CASE WHEN signal = 'MNAR' THEN 'structure-insufficient' END,
    CASE WHEN NOT imputation_permitted THEN 'confidence-below-imputation-bar' END, CASE WHEN anchors = 0 THEN 'no-anchors' END,
    CASE WHEN formats <= 1 THEN 'few-formats' END) AS blockers FROM mis""",
)
def missingness_signals(spark, sf):
    return tp.missingness_signal(shape(spark, sf)).withColumn("blockers", F.array_join("blockers", ","))


@query(
    "similar_templates",
    """WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
    cent AS (SELECT label AS template_id, list(x ORDER BY i) AS v FROM c GROUP BY 1),
    s AS (SELECT vec_id AS sheet_id, template_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS similarity FROM embeddings, cent)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY similarity DESC, template_id)::INTEGER AS rank FROM s) WHERE rank <= 3""",
)
def similar_templates(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sheet_id"), F.col("embedding").alias("vector"), "label")
    return tp.similar_sheets(vectors, tp.template_centroids(vectors, "label"))
