"""Map the columns of each sheet to the fields of an import, one to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions import lexicon as lx
from tabprep.functions.text import normalize_text
from tabprep.operators.scale import attach
from tabprep.session import materialize


def field_table(spark, fields=lx.FIELDS, priority: Sequence[str] = lx.PRIORITY) -> DataFrame:
    """``(field_id, required, priority, keywords)`` with label and synonyms normalised."""
    rank = {f: i for i, f in enumerate(priority)}
    rows = [(f, label, req, list(syn or []), rank.get(f, 2**31 - 1)) for f, label, req, syn in fields]
    raw = spark.createDataFrame(rows, "field_id string, label string, required boolean, synonyms array<string>, priority int")
    return raw.select(
        "field_id",
        "required",
        "priority",
        F.transform(F.concat(F.array("label"), "synonyms"), normalize_text).alias("keywords"),
    )


def match_score(normalized: Column, keywords: Column) -> Column:
    """Two points per equal keyword, one per keyword contained."""
    return F.aggregate(
        keywords,
        F.lit(0),
        lambda total, k: total + F.when(normalized == k, 2).when(normalized.contains(k), 1).otherwise(0),
    )


def distinct_columns(headers: DataFrame) -> DataFrame:
    """Distinct labels of each sheet at their first position."""
    return headers.groupBy("sheet_id", "header").agg(F.min("col_idx").alias("col_idx"))


def map_fields(headers: DataFrame, fields: DataFrame) -> DataFrame:
    """``(sheet_id, field_id, header)``: best free column for each field, null if none is left.

    Candidates are taken by score, then field priority, field id and column order. At most F - 1
    columns can be gone when the turn comes to one of F fields, so its F best columns decide:
    no sheet contributes more than F * F candidates to the fold, however wide it is.
    """
    # the field list of an import is a short configuration table; it travels as a literal
    listed = fields.orderBy("field_id").collect()
    size = len(listed)
    options = F.array(
        *[
            F.struct(
                F.lit(r.field_id).alias("field_id"),
                F.lit(r.priority).alias("priority"),
                F.array(*[F.lit(k) for k in r.keywords]).alias("keywords"),
            )
            for r in listed
        ]
    )
    labels = distinct_columns(headers).withColumn("_norm", normalize_text(F.col("header")))
    scored = labels.select(
        "sheet_id", "header", "col_idx",
        F.explode(
            F.filter(
                F.transform(
                    options,
                    lambda f: F.struct(
                        f["field_id"].alias("field_id"), f["priority"].alias("priority"),
                        match_score(F.col("_norm"), f["keywords"]).alias("score"),
                    ),
                ),
                lambda c: c["score"] > 0,
            )
        ).alias("c"),
    ).select("sheet_id", "header", "col_idx", "c.*")
    best_first = Window.partitionBy("sheet_id", "field_id").orderBy(F.desc("score"), "col_idx")
    short = scored.withColumn("_k", F.row_number().over(best_first)).filter(F.col("_k") <= size)
    queue = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("s"), "priority", "field_id", "col_idx", "header"))
    )
    nothing = F.array().cast("array<struct<field_id:string,header:string>>")

    def take(taken: Column, c: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["field_id"] == c["field_id"]) | (t["header"] == c["header"]))
        pair = F.struct(c["field_id"].alias("field_id"), c["header"].alias("header"))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(pair)))

    folded = short.groupBy("sheet_id").agg(F.aggregate(queue, nothing, take).alias("_taken"))
    sheets = headers.select("sheet_id").distinct()
    ids = F.array(*[F.lit(r.field_id) for r in listed])
    return (
        sheets.join(folded, "sheet_id", "left")
        .select("sheet_id", "_taken", F.explode(ids).alias("field_id"))
        .select(
            "sheet_id",
            "field_id",
            F.get(
                F.transform(F.filter("_taken", lambda t: t["field_id"] == F.col("field_id")), lambda t: t["header"]), F.lit(0)
            ).alias("header"),
        )
    )


def field_types(mapped: DataFrame, classified: DataFrame) -> DataFrame:
    """Add the classified type of the mapped column, compared case-insensitively; the last one counts."""
    types = classified.groupBy("sheet_id", F.lower("header").alias("_low")).agg(F.max_by("type", "col_idx").alias("type"))
    return mapped.withColumn("_low", F.lower("header")).join(types, ["sheet_id", "_low"], "left").drop("_low")


def mapping_gaps(typed: DataFrame, fields: DataFrame) -> DataFrame:
    """Per sheet: required fields without a column, required fields without a type, verdict."""
    joined = attach(typed, fields.select("field_id", "required"), ["field_id"], how="inner")
    unmapped = F.col("required") & F.col("header").isNull()
    untyped = F.col("required") & F.col("header").isNotNull() & F.col("type").isNull()
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("field_id"))))
    return joined.groupBy("sheet_id").agg(
        listed(unmapped).alias("missing_required"), listed(untyped).alias("untyped_required")
    ).withColumn("ok", (F.size("missing_required") == 0) & (F.size("untyped_required") == 0))


def preview_summary(tables: DataFrame, typed: DataFrame, missing: DataFrame) -> DataFrame:
    """Per sheet: tables, columns, mapped and typed fields, number of blockers.

    ``tables(sheet_id, table_id, columns)``; ``missing(sheet_id, blockers)``.
    """
    shape = tables.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("table_count"), F.sum("columns").alias("column_count"))
    fields = typed.groupBy("sheet_id").agg(F.count("header").alias("matched_fields"), F.count("type").alias("typed_fields"))
    return shape.join(fields, "sheet_id", "left").join(
        missing.select("sheet_id", F.size("blockers").cast("long").alias("blocker_count")), "sheet_id", "left"
    )


def stored_mapping(headers: DataFrame, classified: DataFrame) -> DataFrame:
    return materialize(field_types(map_fields(headers, field_table(headers.sparkSession)), classified), "mapping")
