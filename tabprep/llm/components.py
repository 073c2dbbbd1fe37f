"""Connected components of a table of links, by alternating star contractions that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.session import materialize


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    found = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.xxhash64("v", "u") % 998_244_353)
    ).first()
    return tuple(x or 0 for x in found)


def _to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node (the smaller ones, or all) to the smallest node among them and itself."""
    if larger_only:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = pairs.join(least, "u")
    if larger_only:
        moved = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` for every node ``u`` of a link except roots: ``v`` is the smallest node that ``u`` reaches.

    Each round is an aggregation with map-side partials and an equi-join on a node; links are never gathered
    by node, so a node with very many links only widens a join that adaptive execution can split. Rounds are
    stored in the shared folder, which ends the lineage; their number grows with the logarithm of the links.
    """
    now = materialize(edges.filter("u <> v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        wide = materialize(_to_smallest(now, larger_only=True), "links")
        now = materialize(_to_smallest(wide, larger_only=False), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
