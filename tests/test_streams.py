"""Streams give what the batch operators give, also when a batch is run again."""

import os
import time
from pathlib import Path
from urllib.parse import urlsplit

import pyarrow as pa
from acceptance.preparation import _as_stream
from conftest import rows
from pyspark.sql import functions as F

from tabprep.operators.assign import assign
from tabprep.session import materialize, scratch_path, scratch_scope
from tabprep.streaming import streams as sm
from test_assignment import PEOPLE, TECH, TICKET


def arrivals(spark, df, files):
    path = scratch_path(spark, "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_assignment_equals_batch_and_reports(spark):
    people = spark.createDataFrame(PEOPLE, TECH)
    df = spark.createDataFrame([(f"t{i}", f"project-{1 + i % 3}", None, ["batch-handling"], "P2") for i in range(30)], TICKET)
    out, metrics = scratch_path(spark, "out"), scratch_path(spark, "metrics")
    log = sm.BatchLog()
    failing = lambda pairs: pairs.withColumn("score", F.lit(None).cast("double")).withColumn("ranker_failed", F.lit(True))
    spark.streams.addListener(log)
    try:
        finish(sm.assign_stream(arrivals(spark, df, 3), people, out, metrics, log=log, scorer=failing))
    finally:
        spark.streams.removeListener(log)
    got = spark.read.parquet(out).select("ticket_id", "technician_id", "strategy")
    assert rows(got, "ticket_id") == rows(assign(df, people, scorer=failing).select("ticket_id", "technician_id", "strategy"), "ticket_id")
    assert spark.read.parquet(metrics).agg(F.sum("enqueued"), F.sum("hard_stops"), F.sum("ml_failures")).first() == (30, 10, 20)
    sizes = [r.n for r in spark.read.parquet(out).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).orderBy("batch_id").collect()]
    assert sm.total_metrics(spark, metrics).select("enqueued", "processed", "ml_failures", "last_batch_size").first() == (30, 30, 20, sizes[-1])
    assert [e["batch_id"] for kind, e in log.events if kind == "batch_start"] == [0, 1, 2]
    assert sum(e["tickets"] for kind, e in log.events if kind == "ranker_failed") == 20
    assert sum(e["enqueued"] or 0 for kind, e in log.events if kind == "batch_end") == 30


def test_tickets_survive_a_rerun(spark):
    df = spark.createDataFrame([("j", i, f"v{i % 7}") for i in range(40)], "job_id string, row_idx long, v string")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    source = scratch_path(spark, "in")
    df.repartition(4).write.parquet(source)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    finish(sm.ticket_stream(stream(), ["v"], out, checkpoint))
    first = rows(spark.read.parquet(out).select("ticket_id", "row_hash"), "row_hash")
    assert len(first) == 7 == len({t for t, _ in first})
    # a fresh checkpoint replays every batch over the same folder
    finish(sm.ticket_stream(stream(), ["v"], out, scratch_path(spark, "cp")))
    assert rows(spark.read.parquet(out).select("ticket_id", "row_hash"), "row_hash") == first


def spool(spark, folder, data):
    """One more file of arrivals."""
    spark.createDataFrame(data, "job_id string, row_idx long, v string").coalesce(1).write.mode("append").parquet(folder)


def test_tickets_after_a_restart(spark):
    source, out, checkpoint = (scratch_path(spark, x) for x in ("in", "out", "cp"))
    stream = lambda: spark.readStream.schema("job_id string, row_idx long, v string").option("maxFilesPerTrigger", 1).parquet(source)
    made = lambda: rows(spark.read.parquet(out).select("job_id", "ticket_no", "row_hash", "ticket_id"), "job_id", "ticket_no")
    spool(spark, source, [("a", i, f"v{i}") for i in range(30)] + [("b", 1, "x"), ("b", 2, "x"), (None, 1, "n")])
    finish(sm.ticket_stream(stream(), ["v"], out, checkpoint))
    before = made()
    assert [(r[0], r[1]) for r in before] == [*[("a", n) for n in range(1, 31)], ("b", 1)]
    # known rows, new ones, and a job that comes up again after a batch without it
    spool(spark, source, [("a", i, f"v{i}") for i in range(20, 45)] + [("c", 1, None)])
    finish(sm.ticket_stream(stream(), ["v"], out, checkpoint))
    spool(spark, source, [("b", 9, "y"), ("b", 10, "x"), ("a", 99, "v99"), ("c", 2, None), ("c", 3, "")])
    finish(sm.ticket_stream(stream(), ["v"], out, checkpoint))
    after = made()
    numbers = {job: [r[1] for r in after if r[0] == job] for job in "abc"}
    assert numbers == {"a": [*range(1, 47)], "b": [1, 2], "c": [1, 2]}
    assert set(before) <= set(after) and len({r[3] for r in after}) == len(after) == len({(r[0], r[2]) for r in after})


def test_numbers_follow_the_rows_and_no_output_is_read(spark):
    df = spark.createDataFrame([("j", 1000 - i, f"v{i % 150}") for i in range(600)], "job_id string, row_idx long, v string")
    out = scratch_path(spark, "out")
    query = finish(sm.ticket_stream(arrivals(spark, df, 3), ["v"], out))
    got = spark.read.parquet(out)
    assert [r.ticket_no for r in got.orderBy("ticket_no").collect()] == [*range(1, 151)]
    for batch in {r.batch_id for r in got.select("batch_id").distinct().collect()}:
        part = got.filter(F.col("batch_id") == batch).orderBy("ticket_no").collect()
        assert [r.row_idx for r in part] == sorted(r.row_idx for r in part)
    plan = query._jsq.explainInternal(True)
    assert "StreamingDeduplicate" in plan and "TransformWithState" in plan and out not in plan


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {os.path.basename(f) for f in files.mkString("\n").split("\n") if "/shuffle_" in f}


def test_a_finished_batch_leaves_no_shuffle_files(spark):
    df = spark.createDataFrame([("j", i, f"v{i}") for i in range(3000)], "job_id string, row_idx long, v string")
    stream, out = arrivals(spark, df, 3), scratch_path(spark, "out")
    before = _shuffle_files(spark)
    finish(sm.ticket_stream(stream, ["v"], out))
    until = time.monotonic() + 20
    while (left := _shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left and spark.read.parquet(out).count() == 3000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_hashes_are_kept_as_bytes(spark):
    df = spark.range(20_000).selectExpr("'j' AS job_id", "id AS row_idx", "cast(id AS string) AS v")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    finish(sm.ticket_stream(arrivals(spark, df, 1), ["v"], out, checkpoint))
    size = lambda at, end: sum(f.stat().st_size for f in Path(at).rglob(f"*{end}"))
    # 32 bytes are the hash; as hex digits it takes 64
    assert 32 < size(checkpoint, ".sst") / 20_000 < 60 and 32 < size(out, ".parquet") / 20_000 < 55
    made = spark.read.parquet(out)
    assert made.select("row_hash").distinct().count() == 20_000 == made.join(df.select("row_idx", F.sha2(F.concat(F.lit("v"), "v"), 256).alias("row_hash")), ["row_idx", "row_hash"]).count()


def test_rows_meet_the_counter_in_packs():
    jobs, slots = ["a", "b"] * 500, [i % 3 for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(jobs), pa.array(slots, "int32"), pa.array([f"r{i}" for i in range(1000)])], names=["job_id", "slot", "row"])
    packs = pa.Table.from_batches(list(sm._packs(3)(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))).to_pylist()
    held = [(p["job_id"], p["slot"], row) for p in packs if p["rows"] for row in p["rows"].split(",")]
    assert sorted(held) == sorted([*zip(jobs, slots, (f"r{i}" for i in range(1000)), strict=True), ("a", 0, "r0")])
    assert len(held) > 20 * sum(p["rows"] is not None for p in packs) and all(p["n"] == len((p["rows"] or "").split(",")) <= sm.PACK_ROWS for p in packs if p["rows"])
    assert sorted((p["job_id"], p["slot"], p["n"]) for p in packs if p["rows"] is None) == [(j, s, 0) for j in "ab" for s in range(3)]


def test_tickets_of_rows_without_place(spark):
    df = spark.createDataFrame([("j", None, "x"), ("j", -3, "y,z"), ("j", 2**62, "w"), ("k", None, None)], "job_id string, row_idx long, v string")
    out = scratch_path(spark, "out")
    finish(sm.ticket_stream(arrivals(spark, df, 1), ["v"], out))
    got = rows(spark.read.parquet(out).select("job_id", "ticket_no", "row_idx"), "job_id", "ticket_no")
    assert got == [("j", 1, None), ("j", 2, -3), ("j", 3, 2**62), ("k", 1, None)]


def test_every_core_reads_a_file_of_each_batch(spark):
    stream = _as_stream(spark.range(4000).selectExpr("id", "id % 2 as place"), 3, "place")
    seen = []
    finish(stream.writeStream.foreachBatch(lambda b, _: seen.append((b.count(), b.select(F.input_file_name()).distinct().count()))).option(
        "checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start())
    assert len(seen) == 3 and sum(n for n, _ in seen) == 4000
    assert all(files > spark.sparkContext.defaultParallelism // 2 for _, files in seen)


def test_job_state(spark):
    log = spark.createDataFrame([("a", i, "S" + str(i), None if i % 2 else str(i)) for i in range(9)], "job_id string, ts int, status string, stats string")
    out = scratch_path(spark, "out")
    finish(sm.job_state_stream(arrivals(spark, log, 3), ["status", "stats"], ["ts"], out))
    assert tuple(sm.latest_states(spark, out).first()) == ("a", "S8", "8", 0, 8)


def test_quality_windows_on_a_table(spark):
    df = spark.createDataFrame([(0, "k", 1.0), (30, "k", None), (90, "k", 4.0)], "s long, k string, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = sm.quality_stream(df, "ts", ["k"], "1 minute", "1 minute")
    assert [(r.n, r.mean, r.missing_rate) for r in got.orderBy("window_start").collect()] == [(2, 1.0, 0.5), (1, 4.0, 0.0)]


def test_scratch_of_a_scope_goes(spark):
    with scratch_scope(spark):
        path = materialize(spark.range(3)).inputFiles()[0]
        stored = lambda p: os.path.exists(urlsplit(p).path)
        assert stored(path)
    kept = materialize(spark.range(3))
    assert not stored(path) and stored(kept.inputFiles()[0]) and kept.count() == 3
