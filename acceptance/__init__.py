"""Acceptance queries: every operator run over the test tables, with the equivalent DuckDB SQL."""

from acceptance.base import ORACLES, QUERIES, shuffled  # noqa: F401


def load() -> None:
    from acceptance import assignment, cleaning, layout, preparation, profiling, rules, semantics, workbook_files, workbooks  # noqa: F401

    for name in ("reference_checks", "detected_tables", "feature_matrix", "preview_first_rows", "job_transitions", "ticket_assignment"):
        if f"{name}_shuffled" not in QUERIES:
            shuffled(name)
