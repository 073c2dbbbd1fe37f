"""Validation, diagnostics and job state over orders, documents, lineitem and events."""

from pyspark.sql import functions as F

from acceptance.base import query, table
from acceptance.layout import SHAPE_SQL, _endless, _ROWS, shape
from acceptance.semantics import LABEL, SHEET, TYPED_MAP, typed_mapping
from tabprep.operators import jobs as jb
from tabprep.operators import structure as st
from tabprep.operators import templates as tp
from tabprep.operators import validate as vd

# --- orders as import jobs -----------------------------------------------------------------------
_JOB = {
    "job_id": "cast(o_orderkey as {s})",
    "mode": "case when o_orderstatus = 'F' then 'MASS_CREATE' else 'POST_SERVICE' end",
    "artifact": "case when o_totalprice > 50000 then concat('artifact-', o_orderkey) end",
    "version": "case when o_orderpriority <> '5-LOW' then 'v1' end",
    "proposed": "o_totalprice > 480000",
    "insights": "o_orderpriority <> '4-NOT SPECIFIED'",
    "signal": "case when o_orderpriority = '1-URGENT' then 'MNAR' when o_orderpriority = '2-HIGH' then 'MAR' when o_orderpriority = '3-MEDIUM' then 'MCAR' end",
    "permitted": "o_totalprice > 150000",
    "has_pos": "o_totalprice < 400000",
    "pos_required": "o_totalprice < 120000",
    "has_geo": "o_custkey > 30",
    "geo_ok": "o_totalprice > 60000",
    "errors_ref": "case when o_totalprice > 470000 then 'errors/earlier.xlsx' end",
}


def jobs(spark, sf):
    flat = table(spark, sf, "orders").select(*[F.expr(e.format(s="string")).alias(c) for c, e in _JOB.items()])
    none = F.array().cast("array<string>")
    insights = F.struct(
        F.when(F.col("signal").isNotNull(), F.struct("signal", F.lit(0.6).alias("confidence"), F.col("permitted").alias("imputation_permitted"), none.alias("blockers"))).alias("missingness_profile"),
        F.when(F.col("has_pos"), F.struct(F.lit("POS").alias("column"), F.col("pos_required").alias("missing_required"), none.alias("warnings"))).alias("pos_detection"),
        F.when(F.col("has_geo"), F.struct(F.col("geo_ok").alias("ok"), none.alias("issues"))).alias("geolocation_validation"),
        F.when(F.col("permitted"), F.struct(F.lit("AUTO_ASSIGN").alias("policy"))).alias("technician_assignment"),
        F.when(
            F.col("proposed") | F.col("geo_ok"),
            F.array(F.struct(F.lit("template-a").alias("template_id"), F.lit("v1").alias("template_version_id"), F.lit(0.9).alias("score"))),
        ).alias("template_similarity_scores"),
    )
    return flat.select(
        "job_id", "mode", F.col("artifact").alias("structural_artifact_id"),
        F.when(F.col("version").isNotNull() | F.col("proposed"), F.struct(F.col("version").alias("template_version_id"), F.col("proposed").alias("proposed_new_template"))).alias("template_resolution"),
        F.when(F.col("insights"), insights).alias("ml_insights"), "errors_ref",
    )


_J = "j AS (SELECT " + ", ".join(f"{e.format(s='varchar')} AS {c}" for c, e in _JOB.items()) + " FROM orders)"
_RULES = {
    "missing-structure": "artifact IS NULL",
    "template-not-confirmed": "version IS NULL",
    "new-template-proposed": "proposed",
    "missingness-mnar": "insights AND signal = 'MNAR'",
    "ml-insights-missing": "NOT insights",
    "pos-missing": "NOT insights OR NOT has_pos",
    "pos-required": "insights AND has_pos AND pos_required",
    "geolocation-blocked": "insights AND has_geo AND NOT geo_ok",
    "missingness-blocked": "insights AND signal IN ('MAR', 'MCAR') AND NOT permitted",
    "previous-errors": "errors_ref IS NOT NULL",
}
_WARNINGS = ("missing-structure", "new-template-proposed", "previous-errors")
_LEVELS = {c: "warning" if c in _WARNINGS else "error" for c in _RULES}
_ISSUES = _J + ", iss AS (" + " UNION ALL ".join(
    f"SELECT job_id, '{c}' AS code, '{_LEVELS[c]}' AS level FROM j WHERE {cond}" for c, cond in _RULES.items()
) + ")"


@query("job_issues", f"WITH {_ISSUES} SELECT * FROM iss")
def job_issues(spark, sf):
    return vd.diagnose(jobs(spark, sf))


@query(
    "job_readiness",
    f"WITH {_ISSUES} SELECT job_id, count(code) AS issues, count(*) FILTER (level = 'error') = 0 AS ready_to_run FROM j LEFT JOIN iss USING (job_id) GROUP BY 1",
)
def job_readiness(spark, sf):
    return vd.readiness(jobs(spark, sf)).withColumn("issues", F.size("issues").cast("long"))


@query(
    "hard_rules",
    f"""WITH {_J} SELECT job_id, CASE WHEN version IS NULL THEN 'errors/missing-template.xlsx' WHEN mode = 'MASS_CREATE' AND insights AND signal = 'MNAR' THEN 'errors/mnar-blocked.xlsx'
    WHEN NOT insights OR NOT has_pos OR pos_required THEN 'errors/missing-pos.xlsx' WHEN has_geo AND NOT geo_ok THEN 'errors/geolocation-blocked.xlsx' END AS error_file FROM j""",
)
def hard_rules(spark, sf):
    return vd.hard_rules(jobs(spark, sf)).select("job_id", "error_file")


@query(
    "insight_defaults",
    f"""WITH {_J} SELECT job_id, CASE WHEN insights THEN coalesce(signal, 'MAR') ELSE 'MAR' END AS signal,
    CASE WHEN insights AND signal IS NOT NULL THEN permitted ELSE false END AS imputation_permitted, CASE WHEN insights AND has_pos THEN pos_required ELSE true END AS pos_missing_required,
    CASE WHEN insights AND has_geo THEN geo_ok ELSE false END AS geo_ok, CASE WHEN insights AND permitted THEN 'AUTO_ASSIGN' ELSE 'REVIEW' END AS policy,
    NOT (insights AND (proposed OR geo_ok)) AS propose_new, CASE WHEN insights AND (proposed OR geo_ok) THEN coalesce(artifact, job_id) END AS repeat_fingerprint FROM j""",
)
def insight_defaults(spark, sf):
    return vd.with_defaults(jobs(spark, sf)).select(
        "job_id", "signal", "imputation_permitted", "pos_missing_required", "geo_ok", "policy", "propose_new", "repeat_fingerprint"
    )


_TEXTS = [
    ("missing-structure", "Job {{job}}: run the preview again"),
    ("template-not-confirmed", "Job {{job}}: confirm a template first ({{level}})"),
    ("pos-required", "The point of sale of {{job}} is empty"),
]


@query(
    "issue_messages",
    f"""WITH {_ISSUES} SELECT job_id, code, replace(replace(CASE code {' '.join(f"WHEN '{c}' THEN '{t}'" for c, t in _TEXTS)} ELSE code END, '{{{{job}}}}', job_id), '{{{{level}}}}', level) AS message FROM iss""",
)
def issue_messages(spark, sf):
    found = vd.diagnose(jobs(spark, sf)).withColumn("params", F.create_map(F.lit("job"), F.col("job_id"), F.lit("level"), F.col("level")))
    return vd.render_messages(found, spark.createDataFrame(_TEXTS, "code string, text string")).select("job_id", "code", "message")


# --- request bodies --------------------------------------------------------------------------------
_BODY = """concat('{{"project_id":"', case when o_orderpriority = '5-LOW' then '' else o_orderpriority end, '","created_by":',
  case o_orderkey % 7 when 0 then cast(o_custkey as {s}) when 1 then '{{"a":1}}' when 2 then 'true' else concat('"', o_custkey, '"') end, ',"mode":"',
  case when o_orderstatus = 'P' then 'OTHER' when o_orderstatus = 'F' then 'MASS_CREATE' else 'POST_SERVICE' end, '","upload":{{"filename":"f.xlsx","mimeType":"x","size":',
  cast(o_totalprice - 100000 as {s}), case when o_totalprice < 300000 then ',"storageKey":"k"' else '' end, case when o_totalprice > 490000 then '' else '}}}}' end,
  case o_orderkey % 11 when 0 then ' junk' when 1 then '{{}}' when 2 then ' ' else '' end)"""


@query(
    "job_request_validation",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 490000 OR o_orderkey % 11 < 2 THEN 'malformed' ELSE concat_ws(',', CASE WHEN o_orderpriority = '5-LOW' THEN 'project_id' END,
    CASE WHEN o_orderkey % 7 < 3 THEN 'created_by' END, CASE WHEN o_orderstatus = 'P' THEN 'mode' END, CASE WHEN o_totalprice < 100000 THEN 'upload.size' END, CASE WHEN o_totalprice >= 300000 THEN 'upload.storageKey' END) END AS errors FROM orders""",
)
def job_request_validation(spark, sf):
    bodies = table(spark, sf, "orders").select("o_orderkey", F.expr(_BODY.format(s="string")).alias("payload"))
    checked = vd.validate_job_requests(bodies)
    broken = F.array_contains("errors", "malformed")
    return checked.select("o_orderkey", F.when(broken, "malformed").otherwise(F.array_join("errors", ",")).alias("errors"))


_DECISION = """concat('{{"proposeNewTemplate":', case when o_orderstatus = 'F' then 'true' else 'false' end, ',"rationale":', case when o_orderpriority = '1-URGENT' then '""' when o_orderkey % 7 = 0 then '3' else '"why"' end,
  ',"technicianSummary":', case when o_orderkey % 11 = 0 then 'false' else '"s"' end, case when o_orderkey % 5 = 0 then ',"nextSteps":[1,null]' when o_orderkey % 5 = 1 then ',"nextSteps":["a"]' else '' end,
  case when o_orderkey % 13 < 2 then concat(',"repeatUploadHint":{{"fingerprint":"f","confirmedDateColumns":[', case when o_orderkey % 13 = 0 then 'null' else '"d"' end, '],"requiredPrompts":[],"templateExistsOnPlatform":true,"note":""}}') else '' end,
  case when o_orderkey % 17 = 0 then ',"suggestions":[{{"template_id":"t","template_version_id":"v","score":"1"}}]' else '' end,
  case when o_totalprice > 200000 then ',"strongMatch":{{"template_id":"t","template_version_id":"v1","score":0.9}}' when o_orderkey % 19 = 0 then ',"strongMatch":null' else '' end, '}}')"""


@query(
    "decision_validation",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 19 = 0 AND o_totalprice <= 200000 THEN 'strongMatch' END, CASE WHEN o_orderkey % 17 = 0 THEN 'suggestions' END,
    CASE WHEN o_orderpriority = '1-URGENT' OR o_orderkey % 7 = 0 THEN 'rationale' END, CASE WHEN o_orderkey % 11 = 0 THEN 'technicianSummary' END, CASE WHEN o_orderkey % 5 = 0 THEN 'nextSteps' END,
    CASE WHEN o_orderkey % 13 = 0 THEN 'repeatUploadHint' END, CASE WHEN o_orderstatus = 'F' AND (o_totalprice > 200000 OR o_orderkey % 19 = 0) THEN 'ambiguous-decision' END) AS errors FROM orders""",
)
def decision_validation(spark, sf):
    bodies = table(spark, sf, "orders").select("o_orderkey", F.expr(_DECISION.format()).alias("payload"))
    return vd.validate_decisions(bodies).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


# --- previews ----------------------------------------------------------------------------------------
_PREVIEW = """pv AS (SELECT conv_id AS sheet_id, CASE WHEN role = 'system' AND length(text) < 60 THEN NULL ELSE 0 END AS table_idx,
  CASE WHEN role = 'system' THEN NULL ELSE turn END AS col_idx, CASE WHEN length(text) > 400 AND role = 'assistant' THEN '  ' ELSE role END AS header FROM conversations)"""


@query(
    "preview_health",
    f"""WITH {_PREVIEW}, c AS (SELECT *, CASE WHEN table_idx IS NULL THEN 'tables-missing' WHEN col_idx IS NULL THEN 'columns-missing' WHEN trim(header) = '' THEN 'name-blank' END AS code FROM pv),
    f AS (SELECT sheet_id, code, table_idx, col_idx, row_number() OVER (PARTITION BY sheet_id ORDER BY coalesce(table_idx, -1), coalesce(col_idx, -1)) AS k FROM c WHERE code IS NOT NULL)
    SELECT s.sheet_id, f.code IS NULL AS valid, f.code, f.table_idx, f.col_idx FROM (SELECT DISTINCT sheet_id FROM pv) s LEFT JOIN f ON f.sheet_id = s.sheet_id AND k = 1""",
)
def preview_health(spark, sf):
    columns = table(spark, sf, "conversations").selectExpr(
        "conv_id as sheet_id", "case when role = 'system' and length(text) < 60 then null else 0 end as table_idx",
        "case when role = 'system' then null else turn end as col_idx", "case when length(text) > 400 and role = 'assistant' then '  ' else role end as header",
    )
    return vd.preview_health(columns)


@query(
    "preview_alerts",
    """SELECT event_id AS sheet_id, concat_ws(',', CASE WHEN event_type = 'click' OR value > 90 THEN 'pos-number-missing' END, CASE WHEN value < 5 THEN 'sheet-format-invalid' END,
    CASE WHEN event_type = 'view' AND value > 20 THEN 'address-pos-mismatch' END, CASE WHEN event_type = 'error' OR value < 10 THEN 'auto-assignment-unreliable' END,
    CASE WHEN value > 120 OR event_type = 'signup' THEN 'report-blocked' END) AS alerts FROM events""",
)
def preview_alerts(spark, sf):
    previews = table(spark, sf, "events").selectExpr(
        "event_id as sheet_id", "case when event_type <> 'click' then 'POS' end as pos_column", "value > 90 as missing_required", "value >= 5 as valid",
        "event_type <> 'view' as geo_ok", "cast(value > 20 as int) as geo_issues", "case when event_type = 'error' then 'REVIEW' else 'AUTO_ASSIGN' end as policy",
        "cast(value >= 10 as int) as matches", "cast(value > 120 as int) as blockers", "event_type <> 'signup' as imputation_permitted",
    )
    return vd.alerts(previews).withColumn("alerts", F.array_join("alerts", ","))


# --- files, structure, mapping -----------------------------------------------------------------------
@query(
    "file_checks",
    """SELECT url AS path, page_id, concat_ws(',', CASE WHEN NOT (ends_with(lower(url), 'ref=x') OR ends_with(lower(url), '.xlsx')) THEN 'invalid-extension' END,
    CASE WHEN length(html) > 6000 THEN 'file-too-large' END, CASE WHEN NOT contains(html, '<td>') THEN 'file-empty' END) AS reasons FROM pages""",
)
def file_checks(spark, sf):
    files = table(spark, sf, "pages").selectExpr(
        "url as path", "page_id", "length(html) as length", "case when contains(html, '<td>') then 1 else 0 end as total_rows"
    )
    named = files.withColumn("path", F.concat_ws("\x1f", F.col("page_id").cast("string"), "path"))
    checked = vd.file_checks(named, 6000, (".xlsx", "ref=x"))
    parts = F.split("path", "\x1f")
    return checked.select(
        F.get(parts, F.lit(1)).alias("path"), F.get(parts, F.lit(0)).cast("long").alias("page_id"), F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "structure_checks",
    f"""WITH {_ROWS} SELECT table_start, CASE WHEN round(conf, 4) < 0.7 OR data_rows = 0 THEN 'block' WHEN head < width THEN 'review' ELSE 'ok' END AS action FROM tabs""",
)
def structure_checks(spark, sf):
    tables = st.detect_tables(_endless(spark, sf))
    held = F.size(F.filter("header_cells", lambda c: c.isNotNull()))
    gaps = tables.withColumn("header_gaps", F.col("last_col") - F.col("first_col") + 1 - held)
    return vd.structure_checks(gaps).drop("sheet_id")


# what each field must be, and whose values may not exceed what
_EXPECTED = [("cliente", True, "text"), ("direccion", True, "address"), ("fecha_visita", True, "date"), ("tecnico", False, "text")]
_MOST = 100


@query(
    "mapping_checks",
    TYPED_MAP + f""", e(field_id, required, expected) AS (VALUES {', '.join(f"('{f}', {r}, '{t}')" for f, r, t in _EXPECTED)}),
    high AS (SELECT {SHEET.replace('cast(ts as date)', 'cast(cast(ts as date) as varchar)')} AS sheet_id, {LABEL} AS header, count(*) AS n FROM events WHERE value > {_MOST} GROUP BY ALL)
    SELECT tm.sheet_id, tm.field_id, CASE WHEN required AND tm.header IS NULL THEN 'block' WHEN n > 0 THEN 'block'
      WHEN tm.header IS NOT NULL AND tm.type IS DISTINCT FROM expected THEN 'review' ELSE 'ok' END AS action
    FROM tm JOIN e USING (field_id) LEFT JOIN high ON high.sheet_id = tm.sheet_id AND high.header = tm.header""",
)
def mapping_checks(spark, sf):
    """Columns are mapped and classified by the library; a field is out of range where a value under its column is."""
    mapped = typed_mapping(spark, sf)
    expected = spark.createDataFrame(_EXPECTED, "field_id string, required boolean, expected_type string")
    high = table(spark, sf, "events").filter(F.col("value") > _MOST).groupBy(F.expr(SHEET).alias("sheet_id"), F.expr(LABEL).alias("header")).agg(
        F.count(F.lit(1)).alias("out_of_range")
    )
    ranges = mapped.join(high, ["sheet_id", "header"]).select("sheet_id", "field_id", "out_of_range")
    return vd.mapping_checks(mapped, expected, ranges)


@query("missing_data_actions", f"WITH {SHAPE_SQL} SELECT sheet_id, CASE signal WHEN 'MCAR' THEN 'impute' WHEN 'MAR' THEN 'review' ELSE 'block' END AS action FROM mis")
def missing_data_actions(spark, sf):
    return tp.missingness_signal(shape(spark, sf)).select("sheet_id", vd.missing_action(F.col("signal")).alias("action"))


# --- rows against reference tables -------------------------------------------------------------------
@query(
    "reference_checks",
    """WITH a AS (SELECT l_orderkey AS client, l_suppkey % 25 AS address, CASE WHEN l_quantity > 25 THEN l_suppkey END AS technician FROM lineitem)
    SELECT a.*, concat_ws(',', CASE WHEN c.c_custkey IS NULL THEN 'client-unknown' WHEN c.c_nationkey <> address THEN 'address-mismatch' END,
      CASE WHEN technician IS NOT NULL AND s.s_suppkey IS NULL THEN 'technician-unknown' END) AS reference_issues
    FROM a LEFT JOIN customer c ON c.c_custkey = client LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = technician""",
)
def reference_checks(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as client", "l_suppkey % 25 as address", "case when l_quantity > 25 then l_suppkey end as technician"
    )
    people = table(spark, sf, "customer")
    checked = vd.reference_checks(
        rows, people.selectExpr("c_custkey as client"), people.selectExpr("c_custkey as client", "cast(c_nationkey as bigint) as address"),
        table(spark, sf, "supplier").filter("s_acctbal > 0").selectExpr("s_suppkey as technician"),
    )
    return checked.withColumn("reference_issues", F.array_join("reference_issues", ","))


_STATUS = """st AS (SELECT d.doc_id, lang AS job_id, concat_ws(',', CASE WHEN quality = 0 THEN 'low-quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' END,
    CASE WHEN n_chars > 3000 THEN 'long' END) AS reasons, CASE WHEN quality = 0 OR toxic = 1 THEN 'ERROR' WHEN l.doc_id IS NULL OR n_chars > 3000 THEN 'WARNING' ELSE 'OK' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _statuses(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("job_id"), "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return vd.row_status(
        rows,
        [
            ("low-quality", "ERROR", F.col("quality") == 0), ("toxic", "ERROR", F.col("toxic") == 1),
            ("unlabelled", "WARNING", F.col("quality").isNull()), ("long", "WARNING", F.col("n_chars") > 3000),
        ],
    )


@query("row_statuses", f"WITH {_STATUS} SELECT * FROM st")
def row_statuses(spark, sf):
    return _statuses(spark, sf).select("doc_id", "job_id", F.array_join("reasons", ",").alias("reasons"), "status")


@query(
    "run_summary",
    f"""WITH {_STATUS} SELECT job_id, count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'WARNING') AS warnings,
    count(*) FILTER (status = 'ERROR') AS errors, count(*) FILTER (status = 'ERROR') = 0 AS runnable FROM st GROUP BY 1""",
)
def run_summary(spark, sf):
    return vd.run_summary(_statuses(spark, sf))


@query("error_rows_export", f"WITH {_STATUS} SELECT doc_id, job_id, replace(reasons, ',', '; ') AS reasons FROM st WHERE status = 'ERROR'")
def error_rows_export(spark, sf):
    from tabprep.session import scratch_path
    from tabprep.sources.sinks import write_errors

    path = scratch_path(spark, "errors")
    write_errors(_statuses(spark, sf), path)
    schema = "doc_id long, job_id string, n_chars long, quality int, toxic int, reasons string, status string"
    return spark.read.schema(schema).option("header", True).csv(path).select("doc_id", "job_id", "reasons")


@query(
    "value_checks",
    """WITH v AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN CASE WHEN value > 100 THEN props ELSE CAST(user_id AS VARCHAR) END END AS pos, CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS addr,
      value * 2 - 100 AS lat, CASE WHEN event_type = 'click' THEN 'west' ELSE CAST(value AS VARCHAR) END AS lon FROM events)
    SELECT event_id, CASE WHEN pos IS NULL OR NOT regexp_matches(pos, '^\\d+$') OR trim(addr) = '' THEN 'ERROR' WHEN lat NOT BETWEEN -90 AND 90 OR TRY_CAST(lon AS DOUBLE) IS NULL
      OR TRY_CAST(lon AS DOUBLE) NOT BETWEEN -180 AND 180 THEN 'WARNING' ELSE 'OK' END AS status, concat_ws(',', CASE WHEN pos IS NULL THEN 'pos-missing' WHEN NOT regexp_matches(pos, '^\\d+$') THEN 'pos-format' END,
      CASE WHEN trim(addr) = '' THEN 'address-missing' END, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude-invalid' END,
      CASE WHEN TRY_CAST(lon AS DOUBLE) IS NULL OR TRY_CAST(lon AS DOUBLE) NOT BETWEEN -180 AND 180 THEN 'longitude-invalid' END) AS reasons FROM v""",
)
def value_checks(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "case when event_type <> 'error' then case when value > 100 then props else cast(user_id as string) end end as pos",
        "case when event_type = 'view' then ' ' else event_type end as addr", "cast(value * 2 - 100 as string) as lat",
        "case when event_type = 'click' then 'west' else cast(value as string) end as lon",
    )
    checked = vd.row_status(rows, vd.value_rules("pos", "addr", "lat", "lon"))
    return checked.select("event_id", "status", F.array_join("reasons", ",").alias("reasons"))


# --- jobs as an update log -----------------------------------------------------------------------------
_UPD = {
    "job_id": "user_id", "ts": "ts", "seq": "event_id",
    "status": "case when event_type = 'click' then 'PREVIEW_READY' when event_type = 'view' then 'RUNNING' when event_type = 'purchase' then 'COMPLETED' end",
    "errors_ref": "case when event_type = 'error' then props end",
    "stats": "case when event_type = 'signup' then value end",
}


def updates(spark, sf):
    return table(spark, sf, "events").select(*[F.expr(e).alias(c) for c, e in _UPD.items()])


def known_jobs(spark, sf):
    """Half of the customers (those in debt or small) exist as jobs before the log starts."""
    return table(spark, sf, "customer").filter("c_acctbal < 5000").select(
        F.col("c_custkey").alias("job_id"), F.concat(F.lit("p"), "c_nationkey").alias("project_id"), F.col("c_name").alias("created_by"),
        F.lit("MASS_CREATE").alias("mode"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("errors_ref"),
        F.expr("timestamp_ntz '2023-12-31 00:00:00'").alias("created_at"), F.expr("timestamp_ntz '2023-12-31 00:00:00'").alias("updated_at"),
    )


_LOG = f"""u AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _UPD.items())} FROM events), k AS (SELECT c_custkey AS job_id, 'p' || c_nationkey AS project_id, c_name AS created_by FROM customer WHERE c_acctbal < 5000),
  o AS (SELECT job_id, min(struct_pack(a := ts, b := seq)) AS opened FROM u WHERE errors_ref IS NOT NULL OR stats IS NOT NULL GROUP BY 1),
  g AS (SELECT u.*, k.job_id IS NOT NULL OR coalesce(struct_pack(a := ts, b := seq) >= opened, false) AS ok FROM u LEFT JOIN k USING (job_id) LEFT JOIN o USING (job_id))"""


@query(
    "job_state_fold",
    f"""WITH {_LOG}, f AS (SELECT job_id, arg_max(status, struct_pack(a := ts, b := seq)) FILTER (status IS NOT NULL) AS status, arg_max(errors_ref, struct_pack(a := ts, b := seq)) FILTER (errors_ref IS NOT NULL) AS errors_ref,
      arg_max(stats, struct_pack(a := ts, b := seq)) FILTER (stats IS NOT NULL) AS stats, min(ts) AS t0, max(ts) AS t1 FROM g WHERE ok GROUP BY 1)
    SELECT coalesce(k.job_id, f.job_id) AS job_id, coalesce(project_id, '') AS project_id, coalesce(created_by, '') AS created_by, CASE WHEN k.job_id IS NULL THEN 'POST_SERVICE' ELSE 'MASS_CREATE' END AS mode,
      coalesce(f.status, 'PENDING') AS status, f.errors_ref, f.stats, CASE WHEN k.job_id IS NULL THEN t0 ELSE TIMESTAMP '2023-12-31' END AS created_at, coalesce(t1, TIMESTAMP '2023-12-31') AS updated_at
    FROM k FULL JOIN f ON f.job_id = k.job_id""",
)
def job_state_fold(spark, sf):
    return jb.apply_updates(known_jobs(spark, sf), updates(spark, sf), ["status", "errors_ref", "stats"])[0]


@query("refused_job_updates", f"WITH {_LOG} SELECT job_id, seq, status FROM g WHERE NOT ok")
def refused_job_updates(spark, sf):
    return jb.apply_updates(known_jobs(spark, sf), updates(spark, sf), ["status", "errors_ref", "stats"])[1].select("job_id", "seq", "status")


@query(
    "newest_pending_jobs",
    "SELECT o_orderkey AS job_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
)
def newest_pending_jobs(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey as job_id", "o_orderstatus as status", "o_orderdate as created_at")
    return jb.find_jobs(rows, status="P", newest=20).select("job_id", "created_at")


@query(
    "new_pending_jobs",
    "SELECT o_orderkey AS job_id, o_orderpriority AS project_id, 'PENDING' AS status, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders WHERE o_orderpriority <> '5-LOW'",
)
def new_pending_jobs(spark, sf):
    asked = table(spark, sf, "orders").selectExpr(
        "o_orderkey as job_id", "nullif(o_orderpriority, '5-LOW') as project_id", "o_custkey as created_by", "'POST_SERVICE' as mode", "cast(null as string) as upload", "o_orderdate as ts"
    )
    return jb.new_jobs(asked.filter("project_id is not null")).select("job_id", "project_id", "status", "created_at", "updated_at")


_STATE = "case event_type when 'signup' then 'PENDING' when 'click' then 'PREVIEW_READY' when 'view' then 'READY_TO_RUN' when 'purchase' then 'RUNNING' else case when value > 50 then 'FAILED' else 'COMPLETED' end end"


@query(
    "job_transitions",
    f"""WITH e AS (SELECT user_id AS job_id, event_id AS seq, ts, {_STATE} AS status FROM events), l AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS previous FROM e)
    SELECT *, CASE WHEN previous IS NULL THEN status = 'PENDING' WHEN previous IN ('COMPLETED', 'FAILED') THEN false ELSE status = 'FAILED' OR (previous, status) IN (('PENDING', 'PREVIEW_READY'),
      ('PREVIEW_READY', 'READY_TO_RUN'), ('READY_TO_RUN', 'RUNNING'), ('RUNNING', 'COMPLETED')) END AS legal FROM l""",
)
def job_transitions(spark, sf):
    events = table(spark, sf, "events").selectExpr("user_id as job_id", "event_id as seq", "ts", f"{_STATE} as status")
    return jb.transitions(events)


_PIECES = "concat_ws(chr(31), 'v' || l_orderkey, 'v' || l_linenumber)"
_TICKETS = f"""r AS (SELECT l_returnflag AS job_id, l_orderkey * 10 + l_linenumber AS row_idx, l_orderkey, l_linenumber, sha256({_PIECES}) AS row_hash, l_shipdate FROM lineitem),
  x AS (SELECT job_id, row_hash, row_number() OVER (PARTITION BY job_id ORDER BY row_hash) AS ticket_no FROM (SELECT DISTINCT job_id, row_hash FROM r WHERE l_shipdate < TIMESTAMP '1997-01-01')),
  d AS (SELECT job_id, row_hash, min(row_idx) AS row_idx FROM r GROUP BY 1, 2),
  f AS (SELECT d.*, coalesce((SELECT max(ticket_no) FROM x WHERE x.job_id = d.job_id), 0) + row_number() OVER (PARTITION BY job_id ORDER BY row_idx, row_hash) AS ticket_no
    FROM d WHERE (job_id, row_hash) NOT IN (SELECT (job_id, row_hash) FROM x))"""


def _ticket_rows(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_returnflag as job_id", "l_orderkey * 10 + l_linenumber as row_idx", "l_orderkey", "l_linenumber", "l_shipdate"
    )


def _created(spark, sf):
    from tabprep.operators.scale import positions

    rows = _ticket_rows(spark, sf)
    content = ["l_orderkey", "l_linenumber"]
    early = rows.filter("l_shipdate < timestamp_ntz '1997-01-01 00:00:00'").select("job_id", jb.row_hash(content).alias("row_hash")).distinct()
    existing = positions(early, ["job_id"], ["row_hash"], "ticket_no").withColumn("ticket_no", F.col("ticket_no") + 1)
    return jb.create_tickets(rows, content, existing)


@query("created_tickets", f"WITH {_TICKETS} SELECT job_id || '-ticket-' || ticket_no AS ticket_id, job_id, ticket_no, row_idx, row_hash FROM f")
def created_tickets(spark, sf):
    return _created(spark, sf)[0]


@query(
    "ticket_creation_counts",
    f"WITH {_TICKETS} SELECT job_id, created, n - created AS skipped FROM (SELECT job_id, count(*) AS n FROM r GROUP BY 1) JOIN (SELECT job_id, count(*) AS created FROM f GROUP BY 1) USING (job_id)",
)
def ticket_creation_counts(spark, sf):
    return _created(spark, sf)[1]


@query(
    "job_audit",
    f"""WITH {_STATUS} SELECT o_orderkey AS job_id, o_orderstatus AS status, CASE WHEN o_totalprice > 400000 THEN 'e' END AS errors_ref,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS created, coalesce(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 END, 0)::BIGINT AS failed
    FROM orders LEFT JOIN labels l ON l.doc_id = o_orderkey""",
)
def job_audit(spark, sf):
    rows = _statuses(spark, sf).select(F.col("doc_id").alias("job_id"), "status")
    made = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    heads = table(spark, sf, "orders").selectExpr("o_orderkey as job_id", "o_orderstatus as status", "case when o_totalprice > 400000 then 'e' end as errors_ref")
    return vd.audit(heads, made, rows)
