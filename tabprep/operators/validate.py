"""Record, job, reference and row validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.operators.scale import attach

# Modes, issue codes with their level, and bounds.
MODES = ["POST_SERVICE", "MASS_CREATE"]
ISSUES = {
    "missing-structure": "warning",
    "template-not-confirmed": "error",
    "new-template-proposed": "warning",
    "missingness-mnar": "error",
    "ml-insights-missing": "error",
    "pos-missing": "error",
    "pos-required": "error",
    "geolocation-blocked": "error",
    "missingness-blocked": "error",
    "previous-errors": "warning",
}
LEAST_STRUCTURE_CONFIDENCE = 0.70

JOB_REQUEST_DDL = "project_id string, created_by string, mode string, upload struct<filename:string,mimeType:string,size:double,storageKey:string>"
DECISION_DDL = (
    "strongMatch struct<template_id:string,template_version_id:string,score:double>, "
    "suggestions array<struct<template_id:string,template_version_id:string,score:double>>, "
    "proposeNewTemplate boolean, rationale string, technicianSummary string, nextSteps array<string>, "
    "repeatUploadHint struct<fingerprint:string,confirmedDateColumns:array<string>,requiredPrompts:array<string>,"
    "templateExistsOnPlatform:boolean,note:string>"
)


def when_list(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of all rules that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def _kind(value: Column) -> Column:
    """JSON type of a VARIANT as Spark names it; null where there is no value."""
    return F.schema_of_variant(value)


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def _is_text(value: Column, empty: bool = False) -> Column:
    known = F.coalesce(_kind(value) == "STRING", F.lit(False))
    return known if empty else known & (F.try_variant_get(value, "$", "string") != "")


def _is_number(value: Column) -> Column:
    return F.coalesce(_kind(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.lit(False))


def _is_flag(value: Column) -> Column:
    return F.coalesce(_kind(value) == "BOOLEAN", F.lit(False))


def _is_object(value: Column) -> Column:
    return F.coalesce(_kind(value).startswith("OBJECT"), F.lit(False))


def _is_list(value: Column, item) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(_kind(value).startswith("ARRAY"), F.lit(False)) & F.forall(items, lambda x: x.isNotNull() & item(x))


def _is_match(value: Column) -> Column:
    named = _is_text(_at(value, "template_id")) & _is_text(_at(value, "template_version_id"))
    return _is_object(value) & named & _is_number(_at(value, "score"))


def _is_hint(value: Column) -> Column:
    lists = [_is_list(_at(value, c), lambda x: _is_text(x, empty=True)) for c in ("confirmedDateColumns", "requiredPrompts")]
    rest = _is_flag(_at(value, "templateExistsOnPlatform")) & _is_text(_at(value, "note"), empty=True)
    return _is_object(value) & _is_text(_at(value, "fingerprint")) & lists[0] & lists[1] & rest


def _checked(df: DataFrame, payload: str, ddl: str, rules) -> DataFrame:
    """``errors`` of each body and, if it has none, its ``record``. A body must be one JSON object and nothing else."""
    body = F.col(f"`{payload}`")
    # the parser stops behind the first value; nothing but blanks may follow it both inside a list and inside an object
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    alone = F.coalesce(F.size(listed) == 1, F.lit(False)) & boxed.isNotNull()
    parsed = df.withColumn("_v", F.when(alone, F.try_parse_json(body)))
    errors = when_list([("malformed", ~_is_object(F.col("_v"))), *rules(F.col("_v"))])
    record = F.when(F.size("errors") == 0, F.from_json(body, ddl))
    return parsed.withColumn("errors", errors).withColumn("record", record).drop("_v")


def validate_job_requests(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Parse request bodies and list the fields of a missing or wrong type or value; valid ones have an empty list."""

    def rules(v: Column):
        size = _at(v, "upload.size")
        return [
            ("project_id", ~_is_text(_at(v, "project_id"))),
            ("created_by", ~_is_text(_at(v, "created_by"))),
            ("mode", ~(_is_text(_at(v, "mode")) & F.try_variant_get(v, "$.mode", "string").isin(MODES))),
            *[(f"upload.{c}", ~_is_text(_at(v, f"upload.{c}"))) for c in ("filename", "mimeType")],
            ("upload.size", ~(_is_number(size) & (F.try_variant_get(size, "$", "double") >= 0))),
            ("upload.storageKey", ~_is_text(_at(v, "upload.storageKey"))),
        ]

    return _checked(df, payload, JOB_REQUEST_DDL, rules)


def validate_decisions(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Same for template decisions; proposing a new template beside a strong match is ambiguous.

    Fields that may be absent may not be null.
    """

    def rules(v: Column):
        match, proposed = _at(v, "strongMatch"), F.try_variant_get(v, "$.proposeNewTemplate", "boolean")
        absent_or = lambda name, good: _at(v, name).isNotNull() & ~good(_at(v, name))
        return [
            ("strongMatch", absent_or("strongMatch", _is_match)),
            ("suggestions", absent_or("suggestions", lambda x: _is_list(x, _is_match))),
            ("proposeNewTemplate", ~_is_flag(_at(v, "proposeNewTemplate"))),
            ("rationale", ~_is_text(_at(v, "rationale"))),
            ("technicianSummary", ~_is_text(_at(v, "technicianSummary"))),
            ("nextSteps", absent_or("nextSteps", lambda x: _is_list(x, lambda i: _is_text(i, empty=True)))),
            ("repeatUploadHint", absent_or("repeatUploadHint", _is_hint)),
            ("ambiguous-decision", _is_flag(_at(v, "proposeNewTemplate")) & proposed & match.isNotNull()),
        ]

    return _checked(df, payload, DECISION_DDL, rules)


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def issue_codes() -> Column:
    """Codes of all problems of a job, in the order of ``ISSUES``."""
    insights, pos = F.col("ml_insights"), F.col("ml_insights.pos_detection")
    geo, missing = F.col("ml_insights.geolocation_validation"), F.col("ml_insights.missingness_profile")
    return when_list(
        [
            ("missing-structure", _blank("structural_artifact_id")),
            ("template-not-confirmed", _blank("template_resolution.template_version_id")),
            ("new-template-proposed", _flag("template_resolution.proposed_new_template")),
            ("missingness-mnar", missing["signal"] == "MNAR"),
            ("ml-insights-missing", insights.isNull()),
            ("pos-missing", pos.isNull()),
            ("pos-required", pos.isNotNull() & pos["missing_required"]),
            ("geolocation-blocked", geo.isNotNull() & ~geo["ok"]),
            ("missingness-blocked", missing.isNotNull() & (missing["signal"] != "MNAR") & ~missing["imputation_permitted"]),
            ("previous-errors", ~_blank("errors_ref")),
        ]
    )


def _level(code: Column) -> Column:
    errors = [c for c, level in ISSUES.items() if level == "error"]
    return F.when(code.isin(errors), "error").otherwise("warning")


def diagnose(jobs: DataFrame) -> DataFrame:
    """One row per job and issue: ``job_id, code, level``. See ``readiness`` for the verdict."""
    return jobs.select("job_id", F.explode(issue_codes()).alias("code")).withColumn("level", _level(F.col("code")))


def readiness(jobs: DataFrame) -> DataFrame:
    """``ready_to_run`` (no error) with the issue codes of each job; nothing is shuffled."""
    coded = jobs.select("job_id", issue_codes().alias("issues"))
    return coded.withColumn("ready_to_run", ~F.exists("issues", lambda c: _level(c) == "error"))


def hard_rules(jobs: DataFrame) -> DataFrame:
    """First violated rule of a run as a file key, null if the job may run."""
    pos, geo = F.col("ml_insights.pos_detection"), F.col("ml_insights.geolocation_validation")
    key = (
        F.when(_blank("template_resolution.template_version_id"), "errors/missing-template.xlsx")
        .when(
            (F.col("mode") == "MASS_CREATE") & (F.col("ml_insights.missingness_profile.signal") == "MNAR"),
            "errors/mnar-blocked.xlsx",
        )
        .when(pos.isNull() | pos["missing_required"], "errors/missing-pos.xlsx")
        .when(geo.isNotNull() & ~geo["ok"], "errors/geolocation-blocked.xlsx")
    )
    return jobs.select("*", key.alias("error_file")).withColumn("ok", F.col("error_file").isNull())


def with_defaults(jobs: DataFrame) -> DataFrame:
    """Stand-ins for insights a preview did not deliver."""
    i = F.col("ml_insights")
    none = F.array().cast("array<string>")
    top = F.try_element_at(i["template_similarity_scores"], F.lit(1))
    return jobs.select(
        "job_id",
        F.coalesce(i["missingness_profile"]["signal"], F.lit("MAR")).alias("signal"),
        F.coalesce(i["missingness_profile"]["confidence"], F.lit(0.5)).alias("signal_confidence"),
        F.coalesce(i["missingness_profile"]["imputation_permitted"], F.lit(False)).alias("imputation_permitted"),
        F.coalesce(i["pos_detection"]["missing_required"], F.lit(True)).alias("pos_missing_required"),
        F.when(i["pos_detection"].isNull(), F.array(F.lit("pos-not-found")))
        .otherwise(F.coalesce(i["pos_detection"]["warnings"], none))
        .alias("pos_warnings"),
        F.coalesce(i["geolocation_validation"]["ok"], F.lit(False)).alias("geo_ok"),
        F.when(i["geolocation_validation"].isNull(), F.array(F.lit("geolocation-unavailable")))
        .otherwise(F.coalesce(i["geolocation_validation"]["issues"], none))
        .alias("geo_issues"),
        F.coalesce(i["technician_assignment"]["policy"], F.lit("REVIEW")).alias("policy"),
        top["template_id"].alias("strong_template"),
        top["template_version_id"].alias("strong_version"),
        top["score"].alias("strong_score"),
        top.isNull().alias("propose_new"),
        F.when(top.isNotNull(), F.coalesce("structural_artifact_id", "job_id")).alias("repeat_fingerprint"),
    )


def preview_health(columns: DataFrame) -> DataFrame:
    """First broken place of each preview, null if all tables and names are usable.

    ``columns(sheet_id, table_idx, col_idx, header)``: a table without columns has one row with a
    null ``col_idx``; a preview without a table list has one row with a null ``table_idx``.
    """
    name = F.col("header").isNull() | (F.trim("header") == "")
    code = (
        F.when(F.col("table_idx").isNull(), "tables-missing")
        .when(F.col("col_idx").isNull(), "columns-missing")
        .when(name, "name-blank")
    )
    place = F.struct(F.coalesce("table_idx", F.lit(-1)), F.coalesce("col_idx", F.lit(-1)))
    checked = columns.withColumn("_code", code)
    first = F.min_by(F.struct("_code", "table_idx", "col_idx"), F.when(F.col("_code").isNotNull(), place))
    return checked.groupBy("sheet_id").agg(first.alias("_f")).select(
        "sheet_id", F.col("_f").isNull().alias("valid"), F.col("_f._code").alias("code"), "_f.table_idx", "_f.col_idx"
    )


def alerts(previews: DataFrame) -> DataFrame:
    """User-facing alert codes of a preview.

    ``previews(sheet_id, pos_column, missing_required, valid, geo_ok, geo_issues INT, policy,
    matches INT, blockers INT, imputation_permitted)``; null means the part is absent.
    """
    return previews.select(
        "sheet_id",
        when_list(
            [
                ("pos-number-missing", _blank("pos_column") | _flag("missing_required")),
                ("sheet-format-invalid", ~F.coalesce("valid", F.lit(True))),
                ("address-pos-mismatch", ~F.col("geo_ok") & (F.col("geo_issues") > 0)),
                ("auto-assignment-unreliable", (F.col("policy") == "REVIEW") | (F.col("policy").isNotNull() & (F.col("matches") == 0))),
                ("report-blocked", (F.col("blockers") > 0) | ~F.coalesce("imputation_permitted", F.lit(True))),
            ]
        ).alias("alerts"),
    )


def file_checks(files: DataFrame, max_bytes: int, suffixes: Sequence[str] = (".xlsx",)) -> DataFrame:
    """Block files by suffix, size, damage or lack of rows: ``files(path, length, total_rows)``, and ``error`` if the reader told any.

    A file that could not be read is damaged; only one that was read can be empty.
    """
    ends = [F.lower("path").endswith(s) for s in suffixes]
    supported = ends[0]
    for e in ends[1:]:
        supported = supported | e
    damaged = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    return files.select(
        "path",
        when_list(
            [
                ("invalid-extension", ~supported),
                ("file-too-large", F.col("length") > max_bytes),
                ("file-damaged", damaged),
                ("file-empty", ~damaged & (F.coalesce("total_rows", F.lit(0)) == 0)),
            ]
        ).alias("reasons"),
    ).withColumn("blocked", F.size("reasons") > 0)


def structure_checks(tables: DataFrame) -> DataFrame:
    """block / review / ok per detected table: low confidence or no data blocks, a gap in the
    header row is ambiguous. ``tables(sheet_id, table_start, confidence, data_rows, header_gaps)``."""
    return tables.select(
        "sheet_id",
        "table_start",
        F.when(F.col("confidence") < LEAST_STRUCTURE_CONFIDENCE, "block")
        .when(F.col("data_rows") == 0, "block")
        .when(F.col("header_gaps") > 0, "review")
        .otherwise("ok")
        .alias("action"),
    )


def mapping_checks(mapped: DataFrame, expected: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per sheet and field: missing column blocks, other type is reviewed, value out of range blocks.

    ``mapped(sheet_id, field_id, header, type)``, ``expected(field_id, required, expected_type)``,
    ``ranges(sheet_id, field_id, out_of_range)``.
    """
    joined = attach(mapped, expected, ["field_id"], how="inner").join(ranges, ["sheet_id", "field_id"], "left")
    return joined.select(
        "sheet_id",
        "field_id",
        F.when(F.col("required") & F.col("header").isNull(), "block")
        .when(F.coalesce("out_of_range", F.lit(0)) > 0, "block")
        .when(F.col("header").isNotNull() & (F.coalesce("type", F.lit("")) != F.col("expected_type")), "review")
        .otherwise("ok")
        .alias("action"),
    )


def reference_checks(rows: DataFrame, clients: DataFrame, addresses: DataFrame, technicians: DataFrame) -> DataFrame:
    """Add ``reference_issues``: unknown client, address of another client, unknown technician.

    ``rows(…, client, address, technician)``, ``clients(client)``, ``addresses(client, address)``,
    ``technicians(technician)``; a null technician is no issue.
    """
    mark = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    checked = attach(rows, mark(clients, ["client"], "_client"), ["client"])
    checked = attach(checked, mark(addresses, ["client", "address"], "_address"), ["client", "address"])
    checked = attach(checked, mark(technicians, ["technician"], "_tech"), ["technician"])
    issues = when_list(
        [
            ("client-unknown", F.col("_client").isNull()),
            ("address-mismatch", F.col("_client").isNotNull() & F.col("_address").isNull()),
            ("technician-unknown", F.col("technician").isNotNull() & F.col("_tech").isNull()),
        ]
    )
    return checked.withColumn("reference_issues", issues).drop("_client", "_address", "_tech")


def missing_action(signal: Column) -> Column:
    """MCAR is imputed, MAR reviewed, MNAR blocked."""
    return F.when(signal == "MCAR", "impute").when(signal == "MAR", "review").when(signal == "MNAR", "block")


def row_status(rows: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Add ``reasons`` and ``status``; rules are ``(code, "ERROR" | "WARNING", condition)``."""
    errors = when_list([(code, cond) for code, level, cond in rules if level == "ERROR"])
    warnings = when_list([(code, cond) for code, level, cond in rules if level != "ERROR"])
    return rows.withColumn("_e", errors).withColumn("_w", warnings).select(
        *rows.columns,
        F.concat("_e", "_w").alias("reasons"),
        F.when(F.size("_e") > 0, "ERROR").when(F.size("_w") > 0, "WARNING").otherwise("OK").alias("status"),
    )


def value_rules(pos: str, address: str, latitude: str, longitude: str) -> list[tuple[str, str, Column]]:
    """Row rules on text columns: number of the point of sale, address, coordinates."""
    number = lambda c: F.col(c).try_cast("double")
    off = lambda c, bound: F.col(c).isNotNull() & (number(c).isNull() | ~number(c).between(-bound, bound))
    return [
        ("pos-missing", "ERROR", _blank(pos)),
        ("pos-format", "ERROR", ~_blank(pos) & ~F.col(pos).rlike(r"^\d+$")),
        ("address-missing", "ERROR", F.col(address).isNull() | (F.trim(address) == "")),
        ("latitude-invalid", "WARNING", off(latitude, 90.0)),
        ("longitude-invalid", "WARNING", off(longitude, 180.0)),
    ]


def run_summary(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows by status and whether the job may run (nothing critical)."""
    of = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), of("OK").alias("ok"), of("WARNING").alias("warnings"), of("ERROR").alias("errors")
    ).withColumn("runnable", F.col("errors") == 0)


def audit(jobs: DataFrame, created: DataFrame, rows: DataFrame) -> DataFrame:
    """Final state of each job with created and failed counts.

    ``jobs(job_id, status, errors_ref)``, ``created(job_id, …)``, ``rows(job_id, status, …)``.
    """
    made = created.groupBy("job_id").agg(F.count(F.lit(1)).alias("created"))
    failed = rows.groupBy("job_id").agg(F.count_if(F.col("status") == "ERROR").alias("failed"))
    joined = jobs.select("job_id", "status", "errors_ref").join(made, "job_id", "left").join(failed, "job_id", "left")
    return joined.fillna(0, ["created", "failed"])


def render_messages(issues: DataFrame, catalog: DataFrame) -> DataFrame:
    """Text of each issue: ``issues(…, code, params MAP)`` with ``catalog(code, text)``."""
    joined = attach(issues, catalog.select("code", "text"), ["code"])
    filled = F.aggregate(
        F.map_entries("params"),
        F.coalesce("text", F.col("code")),
        lambda text, p: F.replace(text, F.concat(F.lit("{{"), p["key"], F.lit("}}")), F.coalesce(p["value"], F.lit(""))),
    )
    return joined.withColumn("message", filled).drop("text")
