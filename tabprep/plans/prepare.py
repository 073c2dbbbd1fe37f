"""From raw sheets to profile, outlier report and feature matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.operators import categorical as ct
from tabprep.operators import numeric as nm
from tabprep.operators import profile as pf
from tabprep.operators.clean import CleanResult, clean
from tabprep.operators.scale import first_rows
from tabprep.session import materialize
from tabprep.sources.tables import Sheets, to_cells


@dataclass(frozen=True)
class Prepared:
    """Tables describing how ready each sheet is, and the means to encode it."""

    cleaned: CleanResult
    types: DataFrame
    typed_histogram: DataFrame

    def missingness(self) -> DataFrame:
        return pf.missingness(self.cleaned.sheets.headers, self.typed_histogram)

    def outliers(self) -> DataFrame:
        numbers = self.typed_histogram.filter("kind <> 'categorical'")
        bounds = materialize(nm.iqr_bounds(numbers, "n"), "bounds")
        return nm.outlier_summary(numbers, bounds, "n")

    def features(self) -> tuple[DataFrame, DataFrame]:
        cells = pf.coerce(to_cells(self.cleaned.sheets), self.types)
        return ct.feature_matrix(cells, self.typed_histogram, self.types)

    def preview(self, n: int = 25) -> DataFrame:
        """Feature vectors of the first ``n`` rows of each sheet; no other row is encoded."""
        head = materialize(first_rows(self.cleaned.sheets.rows, n), "head")
        cells = pf.coerce(to_cells(Sheets(head.drop("preview_idx"), self.cleaned.sheets.headers)), self.types)
        matrix, names = ct.feature_matrix(cells, self.typed_histogram, self.types)
        return ct.dense_preview(matrix, names, head.select("sheet_id", "row_idx", "preview_idx"))


def prepare(sheets: Sheets) -> Prepared:
    cleaned = clean(sheets)
    histogram = pf.stored_histogram(cleaned.sheets)
    types = materialize(pf.infer_types(cleaned.sheets.headers, pf.column_counts(pf.histogram_marks(histogram))), "types")
    return Prepared(cleaned, types, materialize(pf.coerce_histogram(histogram, types), "typed"))


def prepare_summary(sheets: Sheets, preview_rows: int = 25) -> DataFrame:
    """Per sheet: capped values, rows shown in the preview and feature dimensions."""
    ready = prepare(sheets)
    categories = (
        ready.typed_histogram.filter(F.col("text").isNotNull())
        .select("sheet_id", "col_idx", "text").distinct()
        .groupBy("sheet_id", "col_idx").agg((F.count(F.lit(1)) - 1).alias("width"))
    )
    dims = ready.types.join(categories, ["sheet_id", "col_idx"], "left").groupBy("sheet_id").agg(
        F.sum(F.when(F.col("kind") == "categorical", F.coalesce("width", F.lit(0))).otherwise(F.lit(1))).alias("feature_dims")
    )
    capped = ready.outliers().groupBy("sheet_id").agg(F.sum("capped_values").alias("total_capped"))
    rows = ready.cleaned.report.select("sheet_id", F.least("total_rows", F.lit(preview_rows)).alias("feature_rows"))
    return dims.join(rows, "sheet_id").join(capped, "sheet_id", "left").select(
        "sheet_id", F.coalesce("total_capped", F.lit(0)).alias("total_capped"), "feature_rows", "feature_dims"
    )
