"""Template scores and decisions, repeat-upload hints, missingness signal, similar sheets."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabprep.functions import lexicon as lx
from tabprep.operators.scale import attach
from tabprep.session import materialize


#: Largest template catalog that is scored from one literal.
CATALOG_BYTES = 8 << 20
#: Entries in a block of a similarity product and how many times more sheets, bytes of a block's numbers, sheets multiplied at a time.
BLOCK_ROWS, SHEET_SHARE, BLOCK_BYTES, SHEETS_AT_A_TIME = 4096, 16, 16 << 20, 1024


def class_summary(classified: DataFrame) -> DataFrame:
    """Per sheet: columns, average confidence, key columns, distinct types."""
    return classified.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("columns"),
        (F.sum("confidence") / F.count(F.lit(1))).alias("avg_confidence"),
        F.count_if(F.col("type").isin("date", "number", "text")).alias("key_columns"),
        F.size(F.collect_set("type")).alias("type_count"),
    )


def score_templates(summary: DataFrame, matched: DataFrame, catalog: Sequence[tuple[str, str, float]] = lx.TEMPLATES) -> DataFrame:
    """Add ``suggestions``: all templates of the catalog by adjusted score, best first.

    ``matched`` is the result of ``match_fingerprints``. The catalog is a list of templates with their base
    score; it travels as one literal of at most ``CATALOG_BYTES``, so no sheet is joined with it.
    """
    joined = summary.join(matched.drop("fingerprint"), "sheet_id", "left")
    shift = (
        F.when((F.col("key_columns") >= 2) & (F.col("avg_confidence") > 0.62), 0.06).otherwise(0.0)
        + F.when(F.col("type_count") >= 4, 0.03).otherwise(0.0)
    )
    penalty = F.when(F.col("avg_confidence") < 0.45, 0.08).otherwise(0.0)
    text = json.dumps([{"ord": i, "template_id": t, "template_version_id": v, "base": float(b)} for i, (t, v, b) in enumerate(catalog)])
    if len(text.encode()) > CATALOG_BYTES:
        raise ValueError(f"template catalog of more than {CATALOG_BYTES} bytes")
    entries = F.from_json(F.lit(text), "array<struct<ord:int,template_id:string,template_version_id:string,base:double>>")

    def adjust(t):
        hit = F.coalesce(
            (t["template_id"] == F.col("template_id")) & (t["template_version_id"] == F.col("template_version_id")), F.lit(False)
        )
        boosted = F.least(F.lit(0.99), t["base"] + F.col("_shift") + F.when(hit, 0.12).otherwise(0.0) - F.col("_penalty"))
        return F.struct(
            (-F.round(boosted, 3)).alias("neg"),
            t["ord"].alias("ord"),
            t["template_id"].alias("template_id"),
            t["template_version_id"].alias("template_version_id"),
            F.round(boosted, 3).alias("score"),
            hit.alias("fingerprint_hit"),
        )

    scored = joined.withColumn("_shift", shift).withColumn("_penalty", penalty)
    ranked = scored.withColumn("suggestions", F.array_sort(F.transform(entries, adjust)))
    return ranked.drop("_shift", "_penalty")


def decide_template(scored: DataFrame) -> DataFrame:
    """Strong match (fingerprint hit, else first score ≥ .85), proposal of a new template, codes."""
    hit = F.get(F.filter("suggestions", lambda s: s["fingerprint_hit"]), F.lit(0))
    high = F.get(F.filter("suggestions", lambda s: s["score"] >= 0.85), F.lit(0))
    strong = F.coalesce(hit, high)
    low = F.forall("suggestions", lambda s: s["score"] < 0.7)
    decided = scored.withColumn("_strong", strong).withColumn("_top", F.coalesce(strong, F.get("suggestions", F.lit(0))))
    propose = F.col("_strong").isNull() & low
    repeat = F.col("template_id").isNotNull()
    return decided.select(
        "sheet_id",
        F.col("_strong.template_id").alias("strong_template"),
        F.col("_strong.template_version_id").alias("strong_version"),
        F.col("_top.template_id").alias("top_template"),
        F.col("_top.score").alias("top_score"),
        F.round(F.col("_top.score") * 100).cast("int").alias("friendly_score"),
        propose.alias("propose_new"),
        F.when(F.col("_strong").isNull(), "below-similarity-bar")
        .when(repeat, "known-fingerprint")
        .otherwise("schema-and-scores")
        .alias("rationale"),
        F.array_compact(
            F.array(
                F.when(F.col("_top").isNotNull(), "check-headers-and-dates"),
                F.when(repeat, "confirm-repeat-upload"),
                F.when(repeat, "confirm-client-and-project"),
                F.when(propose, "draft-new-template"),
            )
        ).alias("next_steps"),
    )


def repeat_hint(matched: DataFrame, classified: DataFrame, catalog: Sequence[tuple[str, str, float]] = lx.TEMPLATES) -> DataFrame:
    """For sheets with a known fingerprint: date columns to confirm, prompts, template on file."""
    dates = classified.filter("type = 'date'").groupBy("sheet_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda s: s["header"]).alias("_dates")
    )
    entries = matched.sparkSession.createDataFrame([(t, v) for t, v, _ in catalog], "template_id string, template_version_id string")
    on_file = entries.distinct().withColumn("_known", F.lit(True))
    hits = attach(matched.filter(F.col("template_id").isNotNull()), on_file, ["template_id", "template_version_id"]).join(dates, "sheet_id", "left")
    known = F.coalesce("_known", F.lit(False))
    listed = F.coalesce("_dates", F.array().cast("array<string>"))
    return hits.select(
        "sheet_id",
        "fingerprint",
        listed.alias("confirmed_date_columns"),
        F.array(*[F.lit(p) for p in lx.REPEAT_PROMPTS]).alias("required_prompts"),
        known.alias("template_exists"),
        F.when(F.size(listed) > 0, "confirm-dates").otherwise("confirm-template").alias("note"),
    )


def missingness_signal(shape: DataFrame) -> DataFrame:
    """Signal, confidence, permission to impute and blocker codes from structure counts.

    ``shape(sheet_id, tables, columns, anchors, formats, formulas)``.
    """
    density = (
        F.when(F.col("tables") > 1, 0.2).otherwise(0.12)
        + F.least("anchors", F.lit(3)) * 0.08
        + F.least("formats", F.lit(5)) * 0.05
        + F.when(F.col("formulas") > 0, 0.08).otherwise(0.0)
    )
    volume = F.when(F.col("columns") >= 8, 0.2).when(F.col("columns") >= 4, 0.1).otherwise(0.04)
    rated = shape.withColumn("confidence", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.35), density + volume)), 2))
    sparse = (F.col("columns") < 3) | (F.col("tables") == 0)
    signal = (
        F.when((F.col("confidence") < 0.5) | sparse, "MNAR").when(F.col("confidence") > 0.72, "MAR").otherwise("MCAR")
    )
    judged = rated.withColumn("signal", signal).withColumn(
        "imputation_permitted", (F.col("signal") != "MNAR") & (F.col("confidence") >= 0.58)
    )
    return judged.select(
        "sheet_id",
        "signal",
        "confidence",
        "imputation_permitted",
        F.array_compact(
            F.array(
                F.when(F.col("signal") == "MNAR", "structure-insufficient"),
                F.when(~F.col("imputation_permitted"), "confidence-below-imputation-bar"),
                F.when(F.col("anchors") == 0, "no-anchors"),
                F.when(F.col("formats") <= 1, "few-formats"),
            )
        ).alias("blockers"),
    )


def similar_sheets(vectors: DataFrame, catalog: DataFrame, k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact cosine top ``k`` catalog entries for each vector: ``sheet_id, template_id, similarity, rank``.

    ``vectors(sheet_id, vector)``, ``catalog(template_id, vector)``. Both sides are stored and cut into blocks of at most about
    ``block_rows`` entries and ``SHEET_SHARE`` times as many sheets, fewer of long vectors. Each pair of blocks meets in one
    task, which multiplies them as matrices; only ``k`` rows per vector leave it and are ranked again, so catalogs of
    any size are exact. Neither side passes through the driver or a closure: the shuffle carries a vector once for each block
    of entries, and the entries once for each block of sheets. Missing numbers and shorter vectors count as zeros; vectors of
    zeros are like no entry (similarity 0). Equal similarities go by identifier.
    """
    sheets, n_sheets, wide = _stored_vectors(vectors, "sheet_id")
    entries, n_entries, wider = _stored_vectors(catalog, "template_id")
    fitting = max(1, min(block_rows, BLOCK_BYTES // (8 * max(wide, wider, 1))))
    left, right = -(-n_sheets // (fitting * SHEET_SHARE)) or 1, -(-n_entries // fitting) or 1
    met = _dealt(sheets, "l", left, "r", right).groupBy("l", "r").cogroup(_dealt(entries, "r", right, "l", left).groupBy("l", "r"))
    schema = f"sheet_id {dict(vectors.dtypes)['sheet_id']}, template_id {dict(catalog.dtypes)['template_id']}, similarity double"
    order = Window.partitionBy("sheet_id").orderBy(F.desc("similarity"), "template_id")
    return met.applyInArrow(_nearest(k), schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _stored_vectors(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """``id, vector, at`` in the shared folder, their number and the longest vector's length."""
    named = df.select(F.col(name).alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.monotonically_increasing_id().alias("at"))
    watch = Observation()
    sizes = [F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("wide")]
    stored = materialize(named.observe(watch, *sizes), "vectors")
    return stored, watch.get["n"], watch.get["wide"] or 0


def _dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Rows dealt evenly to blocks, each once for every block of the other side."""
    block = F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int")
    return df.select("id", "vector", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def _unit_rows(vectors: pa.ChunkedArray, wide: int) -> np.ndarray:
    """Vectors as rows of length one."""
    out = np.zeros((len(vectors), wide))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    if len(vectors):
        flat = pc.fill_null(pc.list_flatten(vectors), 0.0).to_numpy()
        rows = np.repeat(np.arange(len(vectors)), lengths)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(sheets: pa.Table, entries: pa.Table) -> pa.Table:
        taken, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if sheets.num_rows and entries.num_rows:
            wide = max(pc.max(pc.list_value_length(side["vector"])).as_py() or 0 for side in (sheets, entries))
            # in order of their identifiers, so that ties at the edge are kept the same way everywhere
            entries = entries.sort_by("id")
            matrix = _unit_rows(entries["vector"], wide).T
            for first in range(0, sheets.num_rows, SHEETS_AT_A_TIME):
                similarity = np.round(_unit_rows(sheets["vector"].slice(first, SHEETS_AT_A_TIME), wide) @ matrix, 9)
                best = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(best)), best.shape[1])
                taken.append(rows + first)
                places.append(best.ravel())
                found.append(similarity[rows, best.ravel()])
        ids = sheets["id"].take(pa.array(np.concatenate(taken))), entries["id"].take(pa.array(np.concatenate(places)))
        return pa.table([*ids, pa.array(np.concatenate(found))], ["sheet_id", "template_id", "similarity"])

    return run


def template_centroids(vectors: DataFrame, label: str) -> DataFrame:
    """Mean vector per template, summed coordinate by coordinate with map-side partial sums."""
    coordinates = vectors.select(F.col(label).alias("template_id"), F.posexplode("vector").alias("i", "x"))
    means = coordinates.groupBy("template_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("template_id").agg(F.transform(ordered, lambda s: s["x"]).alias("vector"))


def template_outcome(decided: DataFrame, compatible: DataFrame | None = None) -> DataFrame:
    """reuse / review / propose / block.

    ``compatible(sheet_id, compatible)`` says whether the chosen template fits the project.
    """
    joined = decided if compatible is None else attach(decided, compatible, ["sheet_id"])
    fits = F.lit(True) if compatible is None else F.coalesce("compatible", F.lit(True))
    return joined.select(
        "sheet_id",
        F.when(~fits, "block")
        .when(F.col("strong_template").isNotNull(), "reuse")
        .when(F.col("propose_new"), "propose")
        .otherwise("review")
        .alias("outcome"),
    )
