import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabprep.operators import evaluate as ev
from tabprep.operators import jobs as jb
from tabprep.operators import validate as vd

JOB = (
    "job_id string, project_id string, mode string, structural_artifact_id string, "
    "template_resolution struct<template_version_id:string,proposed_new_template:boolean>, "
    "ml_insights struct<missingness_profile:struct<signal:string,confidence:double,imputation_permitted:boolean,blockers:array<string>>,"
    "pos_detection:struct<column:string,missing_required:boolean,warnings:array<string>>,"
    "geolocation_validation:struct<ok:boolean,issues:array<string>>>, errors_ref string"
)
POS, GEO = ("POS", False, []), (True, [])


def job(artifact=None, template=None, insights=None, errors=None, mode="POST_SERVICE"):
    return ("job-1", "project-1", mode, artifact, template, insights, errors)


CASES = [
    (job(), {"template-not-confirmed", "ml-insights-missing", "missing-structure", "pos-missing"}, False),
    (job("a", ("v1", None), (("MNAR", 0.92, False, None), POS, GEO)), {"missingness-mnar"}, False),
    (job("a", ("v2", None), (("MAR", 0.58, False, ["x"]), POS, GEO)), {"missingness-blocked"}, False),
    (job("a", ("v3", None)), {"ml-insights-missing", "pos-missing"}, False),
    (job("a", ("v1", None), (("MCAR", 0.61, True, None), POS, GEO)), set(), True),
    (job("a", ("v1", True), (None, ("POS", True, []), (False, []))), {"new-template-proposed", "pos-required", "geolocation-blocked"}, False),
    (job("a", ("v1", None), (None, POS, None), "errors/x"), {"previous-errors"}, True),
]


@pytest.mark.parametrize("record, codes, ready", CASES)
def test_diagnostics(spark, record, codes, ready):
    jobs = spark.createDataFrame([record], JOB)
    issues = vd.diagnose(jobs).collect()
    assert {i.code for i in issues} == codes and all(i.level == vd.ISSUES[i.code] for i in issues)
    assert vd.readiness(jobs).first().ready_to_run is ready


@pytest.mark.parametrize(
    "record, key",
    [
        (job(), "errors/missing-template.xlsx"),
        (job("a", ("v1", None), (("MNAR", 0.9, False, None), POS, GEO), mode="MASS_CREATE"), "errors/mnar-blocked.xlsx"),
        (job("a", ("v1", None), (("MNAR", 0.9, False, None), POS, GEO)), None),
        (job("a", ("v1", None), (None, None, GEO)), "errors/missing-pos.xlsx"),
        (job("a", ("v1", None), (None, POS, (False, []))), "errors/geolocation-blocked.xlsx"),
    ],
)
def test_hard_rules(spark, record, key):
    assert vd.hard_rules(spark.createDataFrame([record], JOB)).first().error_file == key


def test_request_bodies(spark):
    good = {"project_id": "p", "created_by": "u", "mode": "POST_SERVICE", "upload": {"filename": "f", "mimeType": "m", "size": 0, "storageKey": "k"}}
    bad = {**good, "mode": "X", "upload": {**good["upload"], "size": -1}}
    df = spark.createDataFrame([(0, json.dumps(good)), (1, "{}"), (2, json.dumps(bad)), (3, "{oops")], "i int, payload string")
    errors = {r.i: r.errors for r in vd.validate_job_requests(df).collect()}
    assert errors[0] == [] and errors[2] == ["mode", "upload.size"] and len(errors[1]) >= 7 and "malformed" in errors[3]


def test_bodies_of_wrong_types(spark):
    good = {"project_id": "p", "created_by": "c", "mode": "MASS_CREATE", "upload": {"filename": "f", "mimeType": "m", "size": 1.5, "storageKey": "k"}}
    text = json.dumps(good)
    bodies = [text, text + " \n", text + " junk", text + "{}", text + "],[1", text + ',"x":1', "[1]", "null", "", None]
    bodies += [json.dumps({**good, "project_id": v}) for v in (5, {"a": 1}, True, None, [])] + [json.dumps({**good, "upload": {**good["upload"], "size": v}}) for v in ("12", -1, None)]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, payload string")
    errors = {r.i: r.errors for r in vd.validate_job_requests(df).collect()}
    assert errors[0] == errors[1] == [] and all(errors[i][0] == "malformed" for i in range(2, 10))
    assert all(errors[i] == ["project_id"] for i in range(10, 15)) and all(errors[i] == ["upload.size"] for i in range(15, 18))


def test_ambiguous_decision(spark):
    base = {"rationale": "r", "technicianSummary": "s", "proposeNewTemplate": True, "suggestions": []}
    both = {**base, "strongMatch": {"template_id": "t", "template_version_id": "v", "score": 0.9}}
    df = spark.createDataFrame([(0, json.dumps(base)), (1, json.dumps(both))], "i int, payload string")
    assert {r.i: r.errors for r in vd.validate_decisions(df).collect()} == {0: [], 1: ["ambiguous-decision"]}


def test_updates_of_unknown_jobs(spark):
    jobs = spark.createDataFrame([("a", "p", "u", "MASS_CREATE", "PENDING", "t0", "t0")], "job_id string, project_id string, created_by string, mode string, status string, created_at string, updated_at string")
    log = [("a", "t1", 1, "RUNNING", None), ("b", "t1", 2, "RUNNING", None), ("c", "t1", 3, None, "5"), ("c", "t2", 4, "FAILED", None), ("d", "t0", 5, "FAILED", None), ("d", "t3", 6, None, "7")]
    updates = spark.createDataFrame(log, "job_id string, ts string, seq int, status string, stats string")
    state, refused = jb.apply_updates(jobs, updates, ["status", "stats"])
    assert rows(state.select("job_id", "mode", "status", "stats"), "job_id") == [
        ("a", "MASS_CREATE", "RUNNING", None), ("c", "POST_SERVICE", "FAILED", "5"), ("d", "POST_SERVICE", "PENDING", "7"),
    ]
    assert {r.seq for r in refused.collect()} == {2, 5}


def test_transitions(spark):
    path = ["PENDING", "PREVIEW_READY", "READY_TO_RUN", "RUNNING", "COMPLETED", "RUNNING"]
    events = spark.createDataFrame([("j", float(i), i, s) for i, s in enumerate(path)] + [("k", 0.5, 9, "RUNNING"), ("k", 9.0, 10, "FAILED")], "job_id string, ts double, seq int, status string")
    legal = {(r.job_id, r.seq): r.legal for r in jb.transitions(events, chunk_rows=2).collect()}
    assert [legal[("j", i)] for i in range(6)] == [True] * 5 + [False]
    assert legal[("k", 9)] is False and legal[("k", 10)] is True


def test_tickets_are_created_once(spark):
    data = spark.createDataFrame([("j", i, "abca"[i]) for i in range(4)] + [("k", 0, None), ("k", 1, "")], "job_id string, row_idx long, v string")
    tickets, counts = jb.create_tickets(data, ["v"])
    assert rows(tickets.select("ticket_id", "row_idx"), "ticket_id") == [("j-ticket-1", 0), ("j-ticket-2", 1), ("j-ticket-3", 2), ("k-ticket-1", 0), ("k-ticket-2", 1)]
    assert rows(counts, "job_id") == [("j", 3, 1), ("k", 2, 0)]
    again, counts = jb.create_tickets(data.unionByName(spark.createDataFrame([("j", 9, "new")], data.schema)), ["v"], tickets)
    assert [r.ticket_id for r in again.collect()] == ["j-ticket-4"]
    assert rows(counts, "job_id") == [("j", 1, 4), ("k", 0, 2)]


def test_row_status_and_summary(spark):
    df = spark.createDataFrame([("j", "12", "x", "1", "2"), ("j", "ab", " ", None, None), ("j", "5", "y", "95", "z")], "job_id string, pos string, addr string, lat string, lon string")
    checked = vd.row_status(df, vd.value_rules("pos", "addr", "lat", "lon"))
    assert [(r.status, r.reasons) for r in checked.collect()] == [
        ("OK", []), ("ERROR", ["pos-format", "address-missing"]), ("WARNING", ["latitude-invalid", "longitude-invalid"]),
    ]
    s = vd.run_summary(checked).first()
    assert (s.total, s.ok, s.warnings, s.errors, s.runnable) == (3, 1, 1, 1, False)


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    b = ev.bootstrap_mean(df, "id", "x")
    r = b.first()
    assert r.low < 4.5 < r.high and r.high - r.low < 0.5 and b.first() == r


def test_drift_distance(spark):
    pairs = [("m", float(i), "a") for i in range(100)] + [("m", float(i + 50), "b") for i in range(100)]
    found = ev.ks_distance(spark.createDataFrame(pairs, "m string, v double, s string"), "m", "v", "s", chunk_rows=3).first()
    assert found.distance == pytest.approx(0.5)
