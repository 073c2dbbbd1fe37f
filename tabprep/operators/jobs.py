"""Import jobs as an append-only update log, and idempotent ticket creation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.operators.scale import CHUNK_ROWS, attach, chunked, positions, scan_last

# Allowed moves of a job's status. A job may fail from any state but a final one.
TRANSITIONS = {
    "PENDING": ["PREVIEW_READY"],
    "PREVIEW_READY": ["AWAITING_TEMPLATE_CONFIRMATION", "READY_TO_RUN"],
    "AWAITING_TEMPLATE_CONFIRMATION": ["READY_TO_RUN"],
    "READY_TO_RUN": ["RUNNING"],
    "RUNNING": ["COMPLETED"],
}
# updates of these fields need an existing job; the others create it with defaults
STRICT_FIELDS = ["status", "structural_artifact_id"]


def new_jobs(requests: DataFrame) -> DataFrame:
    """Valid requests as pending jobs; ``requests(job_id, project_id, created_by, mode, upload, ts)``."""
    return requests.select(
        "job_id", "project_id", "created_by", "mode", "upload", F.lit("PENDING").alias("status"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )


def find_jobs(jobs: DataFrame, job_id: str | None = None, status: str | None = None, newest: int | None = None) -> DataFrame:
    """Lookup by id or status; ``newest`` gives a top-k by creation time."""
    found = jobs
    if job_id is not None:
        found = found.filter(F.col("job_id") == job_id)
    if status is not None:
        found = found.filter(F.col("status") == status)
    if newest is not None:
        found = found.orderBy(F.desc("created_at"), "job_id").limit(newest)
    return found


def fold_updates(updates: DataFrame, fields: Sequence[str], order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Latest non-null value of every field per job, with map-side partial results.

    ``updates(job_id, <order>, <fields>)``; a null field means "not part of this update".
    """
    latest = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order)))
    return updates.groupBy("job_id").agg(
        *[latest(f).alias(f) for f in fields], F.min(order[0]).alias("first_update"), F.max(order[0]).alias("updated_at")
    )


def apply_updates(jobs: DataFrame, updates: DataFrame, fields: Sequence[str], order: Sequence[str] = ("ts", "seq")) -> tuple[DataFrame, DataFrame]:
    """Jobs after all updates, and the updates that were refused.

    Updates of an unknown job are refused if they only touch strict fields; otherwise they insert
    it with defaults (pending, post-service, empty owner), after which all its updates count.
    """
    loose = [f for f in fields if f not in STRICT_FIELDS]
    opens = F.lit(False)
    for f in loose:
        opens = opens | F.col(f).isNotNull()
    opened = updates.filter(opens).groupBy("job_id").agg(F.min(F.struct(*order)).alias("_opened"))
    known = jobs.select("job_id", F.lit(True).alias("_known"))
    gate = known.join(opened, "job_id", "full")
    marked = attach(updates, gate, ["job_id"])
    fits = F.col("_known").isNotNull() | (F.col("_opened").isNotNull() & (F.struct(*order) >= F.col("_opened")))
    accepted = marked.filter(F.coalesce(fits, F.lit(False))).drop("_known", "_opened")
    refused = marked.filter(~F.coalesce(fits, F.lit(False))).drop("_known", "_opened")
    folded = fold_updates(accepted, fields, order)
    present = set(jobs.columns)
    base = jobs.select(*[F.col(c).alias(f"_{c}") if c != "job_id" else F.col(c) for c in jobs.columns])
    joined = base.join(folded, "job_id", "full")
    old = lambda f: F.col(f"_{f}") if f in present else F.lit(None)
    defaults = {"status": "PENDING", "mode": "POST_SERVICE", "project_id": "", "created_by": ""}
    names = ["project_id", "created_by", "mode", *fields]
    merged = joined.select(
        "job_id",
        *[F.coalesce(*([F.col(f)] if f in fields else []), old(f), F.lit(defaults.get(f))).alias(f) for f in dict.fromkeys(names)],
        F.coalesce(old("created_at"), F.col("first_update")).alias("created_at"),
        F.coalesce(F.col("updated_at"), old("updated_at")).alias("updated_at"),
    )
    return merged, refused


def transitions(events: DataFrame, order: Sequence[str] = ("ts", "seq"), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every status change with its predecessor and whether the move is allowed.

    ``events(job_id, <order>, status)``. The predecessor is looked up inside (job, time slice) and
    carried between slices, so one job may own a third of the log.
    """
    sliced = chunked(events, order[0], chunk_rows)
    seen = scan_last(sliced, ["job_id"], "_chunk", list(order), F.col("status"), "previous", inclusive=False).drop("_chunk")
    allowed = F.when(F.col("previous").isNull(), F.col("status") == "PENDING")
    for state, following in TRANSITIONS.items():
        allowed = allowed.when(F.col("previous") == state, F.col("status").isin([*following, "FAILED"]))
    return seen.withColumn("legal", allowed.otherwise(F.lit(False)))


def row_hash(columns: Sequence[str]):
    """Stable identity of a row; nulls and neighbouring columns cannot be confused."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def create_tickets(rows: DataFrame, content: Sequence[str], existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New tickets ``{job}-ticket-{n}`` for rows not seen before, and counts per job.

    ``rows(job_id, row_idx, <content>)``; ``existing(job_id, row_hash, ticket_no)``. Equal rows of a
    job make one ticket, so a retry creates nothing. Numbers follow the row order and continue
    after the existing ones; numbering a job of any size never meets one task.
    """
    hashed = rows.select("job_id", "row_idx", row_hash(content).alias("row_hash"))
    distinct = hashed.groupBy("job_id", "row_hash").agg(F.min("row_idx").alias("row_idx"), F.count(F.lit(1)).alias("copies"))
    fresh = distinct
    if existing is not None:
        fresh = distinct.join(existing.select("job_id", "row_hash"), ["job_id", "row_hash"], "left_anti")
    numbered = positions(fresh, ["job_id"], ["row_idx", "row_hash"], out="_n")
    if existing is not None:
        used = existing.groupBy("job_id").agg(F.max("ticket_no").alias("_used"))
        numbered = attach(numbered, used, ["job_id"])
    else:
        numbered = numbered.withColumn("_used", F.lit(0))
    number = F.col("_n") + 1 + F.coalesce("_used", F.lit(0))
    tickets = numbered.select(
        F.concat(F.col("job_id").cast("string"), F.lit("-ticket-"), number.cast("string")).alias("ticket_id"),
        "job_id", number.cast("long").alias("ticket_no"), "row_idx", "row_hash",
    )
    made = tickets.groupBy("job_id").agg(F.count(F.lit(1)).alias("created"))
    counts = hashed.groupBy("job_id").agg(F.count(F.lit(1)).alias("_rows")).join(made, "job_id", "left").select(
        "job_id",
        F.coalesce("created", F.lit(0)).alias("created"),
        (F.col("_rows") - F.coalesce("created", F.lit(0))).alias("skipped"),
    )
    return tickets, counts
