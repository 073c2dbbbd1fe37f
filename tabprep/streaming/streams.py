"""Tickets, job updates and quality readings arriving as streams.

Sinks are folders with one subfolder per micro-batch. A batch that is run again after a failure
replaces its own subfolder, so every row counts once.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tabprep.operators.assign import RANKER_FAILED, assign, assignment_metrics, directory, needs_classes
from tabprep.operators.jobs import fold_updates, row_hash
from tabprep.operators.scale import attach, positions
from tabprep.session import FREE_SHUFFLES, scratch_path, scratch_scope, settings

#: Notices that a log keeps at most; older ones go first.
KEPT_EVENTS = 10_000


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None, every: float | None, hold: bool = True) -> StreamingQuery:
    def once(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession), settings(batch.sparkSession, FREE_SHUFFLES):
            # operators read a batch more than once; the source (and its observed counters) see it once
            held = batch.persist() if hold else batch
            try:
                handle(held, batch_id)
            finally:
                if hold:
                    held.unpersist()
                _free_shuffles(batch)

    writer = stream.writeStream.outputMode(mode).foreachBatch(once).option(
        "checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "offsets")
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": f"{int(every * 1000)} milliseconds"}
    return writer.trigger(**trigger).start()


def _free_shuffles(batch: DataFrame) -> None:
    """Remove the shuffle files behind a finished batch, which no later batch reads; else they stay until the driver collects its garbage."""
    plan = batch._jdf.queryExecution().analyzed()
    if plan.nodeName() == "LogicalRDD":  # other plans have no rows of their own
        plan.rdd().cleanShuffleDependencies(True)


def assign_stream(
    tickets: DataFrame, technicians: DataFrame, decisions_path: str, metrics_path: str | None = None,
    checkpoint: str | None = None, every: float | None = None, log: BatchLog | None = None, **options,
) -> StreamingQuery:
    """Assign each micro-batch with the batch operator; ``every`` seconds, or all there is, once.

    The directory is read and indexed once, when the query starts. The size of a batch is set at the source (e.g. ``maxFilesPerTrigger``). ``log`` is told when a batch
    starts, and how many decisions fell back because the ranker failed.
    """
    observed = tickets.observe("assignment", F.count(F.lit(1)).alias("enqueued"))
    people = directory(technicians, needs_classes(**options))

    def handle(batch: DataFrame, batch_id: int) -> None:
        folder = f"{decisions_path}/batch_id={batch_id}"
        if log:
            log.add("batch_start", {"batch_id": batch_id})
        assign(batch, people, **options).write.mode("overwrite").parquet(folder)
        written = batch.sparkSession.read.parquet(folder)
        if log and (failed := written.filter(F.array_contains("notes", RANKER_FAILED)).count()):
            log.add("ranker_failed", {"batch_id": batch_id, "tickets": failed})
        if metrics_path:
            assignment_metrics(written).write.mode("overwrite").parquet(f"{metrics_path}/batch_id={batch_id}")

    return _start(observed, handle, "append", checkpoint, every)


def total_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    """Counters of all batches of ``assign_stream`` together, and the size of the last one that had tickets."""
    batches = spark.read.parquet(metrics_path)
    counters = [c for c in batches.columns if c != "batch_id"]
    latest = F.max_by("enqueued", F.when(F.col("enqueued") > 0, F.col("batch_id"))).alias("last_batch_size")
    return batches.agg(*[F.sum(c).alias(c) for c in counters], latest)


class BatchLog(StreamingQueryListener):
    """Start, end and failure notices of micro-batches with their observed counters, the newest ``KEPT_EVENTS``."""

    def __init__(self) -> None:
        self.events: deque[tuple[str, dict]] = deque(maxlen=KEPT_EVENTS)
        self._lock = threading.Lock()

    def add(self, kind: str, fields: dict) -> None:
        with self._lock:
            self.events.append((kind, fields))

    def onQueryStarted(self, event) -> None:
        self.add("started", {"name": event.name})

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get("assignment")
        self.add("batch_end", {"batch_id": progress.batchId, "rows": progress.numInputRows, "enqueued": seen["enqueued"] if seen else None})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.add("failed" if event.exception else "stopped", {"error": event.exception})


#: Groups that the numbering of one job is spread over.
JOB_SLOTS = 16
#: New rows of one group that meet its counter as one row. A batch of 10,000 of those then holds some 50 MB.
PACK_ROWS = 64
#: The store of known rows. It does not count its rows, which would read each key once more before it is written, and does not
#: reserve 4 MB for the manifest of each partition.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}
#: Base64 digits of a row's hash; its ``row_idx`` follows them in a pack.
_DIGITS = 44
_PACKED = "job_id string, slot int, rows string, n long, earlier long"


def ticket_stream(
    rows: DataFrame, content: Sequence[str], tickets_path: str, checkpoint: str | None = None, every: float | None = None, slots: int = JOB_SLOTS
) -> StreamingQuery:
    """Create tickets once per distinct row of a job, across batches, restarts and repeated rows.

    Nothing that was written is read again. Spark's state store knows every row of every job by its hash, so a row that
    came before is dropped where its hash belongs and a large job is spread like a small one. It also counts the
    tickets of each job in ``slots`` groups; new rows pass the counters in packs of up to ``PACK_ROWS``, as only their number
    counts there. Every job of a batch asks all its groups, whose sum is the number that its new tickets continue; they are
    numbered in row order by a range sort. Of equal rows of one batch any may give the ticket its ``row_idx``; rows without
    a job make none. The state grows with the distinct rows; it is kept in RocksDB, which needs no memory for it.
    """
    spark = rows.sparkSession
    hashed = rows.filter(F.col("job_id").isNotNull()).select(F.col("job_id").cast("string").alias("job_id"), F.col("row_idx").cast("long").alias("row_idx"), F.unhex(row_hash(content)).alias("row_hash"))
    fresh = hashed.dropDuplicates(["job_id", "row_hash"]).select(
        "job_id", F.pmod(F.xxhash64("row_hash"), F.lit(slots)).cast("int").alias("slot"), F.concat(F.base64("row_hash"), F.coalesce(F.col("row_idx").cast("string"), F.lit(""))).alias("row")
    )
    packed = fresh.mapInArrow(_packs(slots), _PACKED)
    counted = packed.groupBy("job_id", "slot").transformWithStateInPandas(TicketCounter(), _PACKED, "Append", "None")

    def handle(batch: DataFrame, batch_id: int) -> None:
        used = batch.filter("earlier IS NOT NULL").groupBy("job_id").agg(F.sum("earlier").alias("_used"))
        new = batch.filter("rows IS NOT NULL").select("job_id", F.explode(F.split("rows", ",")).alias("_row")).select(
            "job_id", F.nullif(F.substr("_row", F.lit(_DIGITS + 1)), F.lit("")).cast("long").alias("row_idx"), F.unbase64(F.substring("_row", 1, _DIGITS)).alias("row_hash")
        )
        numbered = attach(positions(new, ["job_id"], ["row_idx", "row_hash"], out="_n"), used, ["job_id"])
        number = F.col("_n") + 1 + F.col("_used")
        tickets = numbered.select(
            F.concat("job_id", F.lit("-ticket-"), number.cast("string")).alias("ticket_id"), "job_id", number.cast("long").alias("ticket_no"), "row_idx", F.lower(F.hex("row_hash")).alias("row_hash")
        )
        # hex digits hold half of what they take, which Parquet's usual codec cannot see
        tickets.write.mode("overwrite").option("compression", "zstd").parquet(f"{tickets_path}/batch_id={batch_id}")

    with settings(spark, STATE_STORE):
        return _start(counted, handle, "append", checkpoint, every)


def _packs(slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one group joined by commas, ``PACK_ROWS`` at most, and once per job and task an empty row for each of the job's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: set[str] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            job_id, slot, row = batch.columns
            coded = job_id.dictionary_encode()
            group = coded.indices.to_numpy().astype("int64") * slots + slot.to_numpy()
            order = np.argsort(group, kind="stable")
            group = group[order]
            begins = np.flatnonzero(np.diff(group, prepend=-1))
            place = np.arange(len(group)) - np.repeat(begins, np.diff(begins, append=len(group)))
            cuts = np.append(np.flatnonzero(place % PACK_ROWS == 0), len(group))
            first = order[cuts[:-1]]
            rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, "int32"), row.take(order)), ",")
            yield _packed_batch(job_id.take(first), slot.take(first), rows, np.diff(cuts))
            jobs = [job for job in coded.dictionary.to_pylist() if job not in asked]
            asked.update(jobs)
            if jobs:
                empty = len(jobs) * slots
                questions = pa.array([job for job in jobs for _ in range(slots)], job_id.type)
                yield _packed_batch(questions, pa.array([*range(slots)] * len(jobs), "int32"), pa.nulls(empty, row.type), np.zeros(empty, "int64"))

    return run


def _packed_batch(job_id: pa.Array, slot: pa.Array, rows: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([job_id, slot, rows, pa.array(n, "int64"), pa.nulls(len(n), "int64")], names=[part.split()[0] for part in _PACKED.split(", ")])


class TicketCounter(StatefulProcessor):
    """Counts the tickets of one group of a job; passes packs of new rows on and answers once with the number before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("tickets", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earlier = self.count.get()[0] if self.count.exists() else 0
        new = 0
        for part in rows:
            packs = part[part["rows"].notna()]
            if len(packs):
                new += int(packs["n"].sum())
                yield packs.astype({"earlier": "Int64"})
        answer = pd.DataFrame({"job_id": [key[0]], "slot": [int(key[1])], "rows": [None], "n": [0], "earlier": [earlier]})
        yield answer.astype({"slot": "int32", "earlier": "Int64"})
        if new:
            self.count.update((earlier + new,))

    def close(self) -> None:
        pass


def job_state_stream(updates: DataFrame, fields: Sequence[str], order: Sequence[str], states_path: str, checkpoint: str | None = None, every: float | None = None) -> StreamingQuery:
    """Keep the latest value of each field per job as streaming state; emit changed jobs per batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{states_path}/batch_id={batch_id}")

    return _start(fold_updates(updates, fields, order), handle, "update", checkpoint, every, hold=False)


def latest_states(spark: SparkSession, states_path: str) -> DataFrame:
    """Current state of every job from the emitted changes."""
    changes = spark.read.parquet(states_path)
    columns = [c for c in changes.columns if c not in ("job_id", "batch_id")]
    return changes.groupBy("job_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("_s")).select("job_id", "_s.*")


def quality_stream(readings: DataFrame, ts: str, keys: Sequence[str], width: str, lateness: str) -> DataFrame:
    """Counts, mean and share of missing values per time window; late data up to ``lateness``.

    Works on a stream and on a table. The watermark is a choice of this library.
    """
    return readings.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("_w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate")
    ).select(F.col("_w.start").alias("window_start"), *keys, "n", "mean", "missing_rate")


def append_stream(df: DataFrame, path: str, checkpoint: str | None = None, every: float | None = None) -> StreamingQuery:
    """Write finished windows as parquet files."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint or scratch_path(df.sparkSession, "offsets")
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": f"{int(every * 1000)} milliseconds"}
    return writer.trigger(**trigger).start()
