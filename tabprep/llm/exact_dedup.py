"""Exact duplicates by sorting contents: equal texts become neighbours, and neighbours are compared in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.text import lower_ascii, packed
from tabprep.session import materialize


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    carry: list[str] | None = None,
    hot_share: float = 1 / 20_000,
    hot_rows: int = 32,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``row``, a struct of ``carry``.

    Texts are equal if identical after lower-casing A-Z. Sampled splitters range-partition the rows by a sort
    key of bounded width (the first 16 characters of the normalised text, then a 64-bit hash of all of it), so
    that only small keys reach the driver. Inside a partition an external sort orders the whole normalised
    texts, and a group ends where a text differs from its neighbour.

    A group of more than ``max(hot_rows, hot_share * rows)`` rows is cut into pieces of that size, which sort
    into different places. One head per piece, compared in full, joins the pieces again: that is at most
    ``2 / hot_share`` rows, and at most ``1 / hot_share`` groups are broadcast, whatever the input's size.

    Null text counts as empty. With ``keep="smallest"`` or ``"largest"`` the row with that identifier stays; a
    null identifier loses against any other. Of rows that tie, exactly one stays. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    norm = lower_ascii(F.col("text"))
    base = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), packed(carry or [id_col])
    )
    keyed = base.withColumns({"prefix": lower_ascii(F.substring("text", 1, 16)), "mark": F.xxhash64(norm)})
    limit = max(hot_rows, int(hot_share * docs.count()))
    sizes = keyed.groupBy("mark").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit)
    hot = materialize(sizes, "hot-texts")
    placed = (
        keyed.join(F.broadcast(hot), "mark", "left")
        .withColumn("hot", F.col("rows").isNotNull())
        .withColumn("piece", F.pmod(F.monotonically_increasing_id(), F.ceil(F.coalesce("rows", F.lit(1)) / limit)).cast("int"))
        .drop("rows")
        .repartitionByRange("prefix", "mark", "piece")
        .withColumn("norm", norm)
    )
    best = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    neighbours = Window.partitionBy("prefix", "mark", "piece", "norm")
    first = neighbours.orderBy(best)
    sorted_rows = placed.select(
        "id", "row", "hot", "piece",
        F.sha2("norm", 256).alias("digest"),
        F.count(F.lit(1)).over(neighbours).alias("size"),
        F.first("id").over(first).alias("best"),
        (F.row_number().over(first) == 1).alias("head"),
        "norm",
    ).withColumn("norm", F.when(F.col("hot") & F.col("head"), F.col("norm")))
    stored = materialize(sorted_rows, "content-sorted")
    rank = F.struct(F.col("best").isNull(), F.col("best") if keep == "smallest" else -F.col("best"), F.col("piece"), F.col("best").alias("id"))
    joined = (
        stored.filter(F.col("hot") & F.col("head"))
        .groupBy("norm", "digest")
        .agg(F.sum("size").alias("all_rows"), F.min(rank).alias("winner"))
        .select("digest", "all_rows", F.col("winner.id").alias("all_best"), F.col("winner.piece").alias("best_piece"))
    )
    return stored.join(F.broadcast(joined), "digest", "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("hot"), F.col("all_best")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("all_rows", "size").alias("group_size"),
        (F.col("head") & (~F.col("hot") | (F.col("piece") == F.col("best_piece")))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "row",
    )


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The documents without exact copies, with their columns."""
    return content_sort(docs, keep=keep, carry=docs.columns).filter("kept").select("row.*")
