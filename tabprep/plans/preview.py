"""Everything a user confirms before an import: the preview of a corpus of sheets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.operators import headers as hd
from tabprep.operators import mapping as mp
from tabprep.operators import profile as pf
from tabprep.operators import structure as st
from tabprep.operators import templates as tp
from tabprep.operators.clean import CleanResult, clean
from tabprep.session import materialize
from tabprep.sources.tables import Sheets


@dataclass(frozen=True)
class Preview:
    """Stored per-sheet and per-column results; they outlive the wait for the user's answer."""

    cleaned: CleanResult
    profile: DataFrame
    classified: DataFrame
    mapping: DataFrame
    insights: DataFrame

    def gaps(self) -> DataFrame:
        return mp.mapping_gaps(self.mapping, mp.field_table(self.mapping.sparkSession))


def preview(sheets: Sheets, marks: DataFrame | None = None, known: DataFrame | None = None, shape: DataFrame | None = None) -> Preview:
    """Clean, profile, classify, map and rate every sheet.

    ``marks(sheet_id, anchor_hash, formula_fingerprint)`` and ``shape`` (see ``missingness_signal``)
    come from structure detection; without them a sheet counts as one table with its headers.
    ``known`` lists known fingerprints (see ``match_fingerprints``).
    """
    spark = sheets.spark
    cleaned = clean(sheets)
    headers = cleaned.sheets.headers
    profiled = materialize(pf.profile(headers, pf.column_counts(pf.value_marks(cleaned.sheets))), "profile")
    classified = materialize(hd.classify_columns(headers), "classes")
    mapping = mp.stored_mapping(headers, classified)
    pos = materialize(hd.detect_pos(classified), "pos")
    geo = hd.validate_geo(headers, pos)
    if shape is None:
        shape = headers.groupBy("sheet_id").agg(
            F.lit(1).alias("tables"), F.count(F.lit(1)).alias("columns"), F.countDistinct("header").alias("anchors")
        ).withColumn("formats", F.lit(0)).withColumn("formulas", F.lit(0))
    if marks is None:
        marks = st.signature(headers, "header", "anchor_hash").withColumn("formula_fingerprint", F.lit(None).cast("string"))
    if known is None:
        known = spark.createDataFrame([], "ord int, prefix string, template_id string, template_version_id string")
    prints = st.fingerprints(headers.withColumn("table_start", F.lit(0)), marks)
    scored = tp.score_templates(tp.class_summary(classified), st.match_fingerprints(prints, known))
    insights = (
        pos.join(geo.drop("missing_required"), "sheet_id")
        .join(hd.title_hint(pos), "sheet_id")
        .join(hd.identity_column(headers), "sheet_id")
        .join(tp.missingness_signal(shape), "sheet_id", "left")
        .join(tp.decide_template(scored), "sheet_id", "left")
    )
    return Preview(cleaned, profiled, classified, mapping, materialize(insights, "insights"))
