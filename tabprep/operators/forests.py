"""Random forests for row types and for imputing a numeric column from others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_rows(
    labelled: DataFrame, unlabelled: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 10, seed: int = 7
) -> DataFrame:
    """Predict ``label`` (title, subtotal, data, …) of every row from its structural features, missing ones included.

    ``depth`` bounds the trees; Spark allows up to 30 levels, and the model then grows with the rows.
    """
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(labelled)
    forest = RandomForestClassifier(
        labelCol="_y", featuresCol="_x", predictionCol="_p", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed
    )
    # the copy leaves the training summary behind, which tasks cannot carry
    model = forest.fit(_with_vector(index.transform(labelled), features).select("_x", "_y")).copy()
    named = IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels)
    scored = named.transform(model.transform(_with_vector(unlabelled, features)))
    return scored.drop("_x", "_p", "rawPrediction", "probability")


def _with_vector(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every row with its features as ``_x``: each as a number, zero where it is missing, and whether it is."""
    known = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    parts = {f"_x{i}": F.coalesce(x, F.lit(0.0)) for i, x in enumerate(known)} | {f"_m{i}": x.isNull().cast("double") for i, x in enumerate(known)}
    return VectorAssembler(inputCols=list(parts), outputCol="_x").transform(rows.withColumns(parts)).drop(*parts)


def impute_forest(df: DataFrame, target: str, features: Sequence[str], trees: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """Fill nulls of ``target`` with the prediction of a forest fitted on its observed rows."""
    vector = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    ready = vector.transform(df)
    forest = RandomForestRegressor(labelCol=target, featuresCol="_x", predictionCol="_p", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(ready.filter(F.col(target).isNotNull()).select("_x", F.col(target).cast("double").alias(target)))
    return model.transform(ready).withColumn(target, F.coalesce(F.col(target).cast("double"), F.col("_p"))).drop("_x", "_p")
