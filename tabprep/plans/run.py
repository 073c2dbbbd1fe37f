"""Run confirmed jobs: hard rules, ticket creation, assignment, final status."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.operators import assign as asg
from tabprep.operators import jobs as jb
from tabprep.operators import validate as vd
from tabprep.operators.scale import attach
from tabprep.session import materialize


@dataclass(frozen=True)
class Run:
    jobs: DataFrame
    tickets: DataFrame
    counts: DataFrame
    decisions: DataFrame

    def trace(self, rows: DataFrame, content: Sequence[str]) -> DataFrame:
        """What became of every source row: ``job_id, row_idx, outcome, ticket_id, technician_id, strategy``.

        ``outcome`` is skipped (an error row), blocked (its job failed) or ticket; equal rows of a job share one.
        """
        # tickets and decisions meet first, so the rows move once, with what is shown and half as wide a hash
        known = F.when(F.col("status") != "ERROR", F.unhex(jb.row_hash(content)))
        hashed = rows.select("job_id", "row_idx", "status", known.alias("_hash"))
        made = self.tickets.select("job_id", F.unhex("row_hash").alias("_hash"), "ticket_id")
        decided = attach(hashed, attach(made, self.decisions.select("ticket_id", "technician_id", "strategy"), ["ticket_id"]), ["job_id", "_hash"])
        outcome = F.when(F.col("status") == "ERROR", "skipped").when(F.col("ticket_id").isNull(), "blocked").otherwise("ticket")
        return decided.select("job_id", "row_idx", outcome.alias("outcome"), "ticket_id", "technician_id", "strategy")


def run(jobs: DataFrame, rows: DataFrame, content: Sequence[str], technicians: DataFrame, existing: DataFrame | None = None) -> Run:
    """Jobs that break a hard rule fail with an error file; the rest complete.

    ``rows(job_id, row_idx, status, region, identity_document, <content>)``: rows with status ERROR
    are left out, so a job with some bad rows still imports its good ones.
    """
    judged = materialize(vd.hard_rules(jobs).select("job_id", "project_id", "mode", "ok", "error_file"), "judged")
    admitted = attach(rows.filter(F.col("status") != "ERROR"), judged.filter("ok").select("job_id"), ["job_id"], how="left_semi")
    tickets, counts = jb.create_tickets(admitted, content, existing)
    tickets = materialize(tickets, "tickets")
    # repeated positions: the smallest pair, whatever the order of the rows
    places = admitted.groupBy("job_id", "row_idx").agg(F.min(F.struct("region", "identity_document")).alias("_p")).select("job_id", "row_idx", "_p.*")
    wanted = asg.build_tickets(tickets.join(places, ["job_id", "row_idx"]), judged.filter("ok"))
    decisions = asg.assign(wanted, technicians)
    final = judged.select(
        "job_id", F.when(F.col("ok"), "COMPLETED").otherwise("FAILED").alias("status"), F.col("error_file").alias("errors_ref")
    )
    return Run(final, tickets, counts, decisions)
