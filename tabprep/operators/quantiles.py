"""Exact quantiles of huge groups: selection in rounds, so that no task ever sorts more than a fixed number of values.

A quantile sketch (partial aggregation, fixed size) gives for every wanted rank a bracket that is certain to contain
it. A second pass counts the rows below each bracket and keeps the distinct values inside, about a thousandth of the
group. As long as a bracket holds more than ``MOST_RANKED`` of them, it is cut into ``CELLS`` cells of about equally
many values, whose rows are counted with map-side partials, and only the cell that holds the rank is kept. What is left
is sorted, and the order statistics are read off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.operators.scale import attach
from tabprep.session import materialize

ACCURACY = 10_000
#: Distinct values of one group and probability that a task may sort, and cells that a larger bracket is cut into.
MOST_RANKED = 65_536
CELLS = 512
_MARGIN = 5 / ACCURACY


def order_statistics(
    values: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float], weight: str | None = None, most: int = MOST_RANKED
) -> DataFrame:
    """Per key and probability the two neighbouring order statistics.

    Output ``keys, prob, low, high, fraction``; the linear quantile is ``low + fraction*(high-low)``.
    ``weight`` counts repeated values, as in a histogram. At most ``most`` distinct values of a bracket are sorted.
    """
    keys = list(keys)
    inside, state = _narrow_brackets(values, keys, x, list(probs), weight, most)
    order = Window.partitionBy(*keys, "prob").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = attach(inside.withColumn("upto", F.sum("c").over(order)), state, [*keys, "prob"], how="inner", stored=True)
    spot = F.col("prob") * (F.col("_n") - 1)
    reaching = lambda rank: F.min(F.when(F.col("_below") + F.col("upto") > rank, F.col("v")))
    found = ranked.groupBy(*keys, "prob").agg(
        reaching(F.floor(spot)).alias("low"),
        reaching(F.ceil(spot)).alias("high"),
        F.first(spot - F.floor(spot)).alias("fraction"),
        F.first(F.col("_below") > F.floor(spot)).alias("_over"),
    )
    missed = F.col("_over") | F.col("high").isNull()
    guard = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
    return found.select(*keys, "prob", F.coalesce(guard, F.col("low")).alias("low"), "high", "fraction")


def _narrow_brackets(
    values: DataFrame, keys: list[str], x: str, probs: list[float], weight: str | None, most: int
) -> tuple[DataFrame, DataFrame]:
    """Distinct values ``keys, prob, v, c`` of brackets of at most ``most``, and ``keys, prob, _n, _below, _size`` of each."""
    present = values.filter(F.col(x).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("_x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")
    )
    if weight:
        summary = _weighted_brackets(present, keys, probs)
    else:
        cuts = sorted({min(max(p + s, 0.0), 1.0) for p in probs for s in (-_MARGIN, _MARGIN)})
        place = {c: i for i, c in enumerate(cuts)}
        # the sketch is off by at most one ACCURACY-th of the ranks; short groups are taken whole
        small = F.col("_n") <= ACCURACY
        at = lambda p: F.get("_q", F.lit(place[min(max(p, 0.0), 1.0)]))
        sketch = present.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_x").alias("_min"),
            F.max("_x").alias("_max"),
            F.percentile_approx("_x", cuts, ACCURACY).alias("_q"),
        )
        summary = sketch.select(
            *keys,
            "_n",
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("prob"),
                        (F.col("_min") if p - _MARGIN <= 0 else F.when(small, F.col("_min")).otherwise(at(p - _MARGIN))).alias("lo"),
                        (F.col("_max") if p + _MARGIN >= 1 else F.when(small, F.col("_max")).otherwise(at(p + _MARGIN))).alias("hi"),
                    )
                    for p in probs
                ]
            ).alias("_brackets"),
        )
    summary = materialize(summary, "brackets")
    bracketed = attach(present, summary.select(*keys, "_brackets"), keys, how="inner", stored=True)
    # below a bracket: counted under a null value; inside: kept; above: dropped
    marks = F.transform(
        "_brackets",
        lambda b: F.when(
            F.col("_x") <= b["hi"],
            F.struct(b["prob"].alias("prob"), F.when(F.col("_x") >= b["lo"], F.col("_x")).alias("v")),
        ),
    )
    kept = (
        bracketed.select(*keys, "_w", F.explode(F.array_compact(marks)).alias("_m"))
        .select(*keys, "_w", F.col("_m.prob").alias("prob"), F.col("_m.v").alias("v"))
        .groupBy(*keys, "prob", "v")
        .agg(F.sum("_w").alias("c"))
    )
    kept = materialize(kept, "inside")
    within = F.col("v").isNotNull()
    state = kept.groupBy(*keys, "prob").agg(
        F.sum(F.when(within, F.lit(0)).otherwise(F.col("c"))).alias("_below"), F.count_if(within).alias("_size")
    )
    empty = F.raise_error(F.lit("quantile bracket holds no value")).cast("long")
    state = state.withColumn("_size", F.when(F.col("_size") > 0, F.col("_size")).otherwise(empty))
    state = materialize(attach(state, summary.select(*keys, "_n"), keys, how="inner", stored=True), "state")
    inside = kept.filter(within)
    while (state.agg(F.max("_size")).first()[0] or 0) > most:
        inside, state = _one_cell(inside, state, keys, most)
    return inside, state


def _one_cell(inside: DataFrame, state: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Each bracket of more than ``most`` values cut down to the cell, or two neighbours, with its rank and the next one."""
    spot = [*keys, "prob"]
    large = state.filter(F.col("_size") > most).select(*spot)
    grid = [i / CELLS for i in range(1, CELLS)]
    cuts = attach(inside, large, spot, how="inner").groupBy(*spot).agg(F.percentile_approx("v", grid, ACCURACY).alias("_g"))
    cuts = materialize(cuts.withColumn("_g", F.array_sort(F.array_distinct("_g"))), "cuts")
    slotted = _with_slot(attach(inside, cuts, spot, stored=True), "_g", "v").drop("_g")
    mass = slotted.groupBy(*spot, "_slot").agg(F.sum("c").alias("_c"), F.count(F.lit(1)).alias("_values"))
    mass = attach(mass, state.drop("_size"), spot, how="inner", stored=True)
    upto = F.sum("_c").over(Window.partitionBy(*spot).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.col("prob") * (F.col("_n") - 1)
    cells = mass.withColumn("_upto", F.col("_below") + upto).withColumn("_before", F.col("_upto") - F.col("_c"))
    held = (F.col("_upto") > F.floor(rank)) & (F.col("_before") <= F.ceil(rank))
    chosen = cells.filter(held).groupBy(*spot).agg(
        F.min("_slot").alias("_first"), F.max("_slot").alias("_last"), F.first("_n").alias("_n"), F.min("_before").alias("_below"),
        F.sum("_values").alias("_size"),
    )
    chosen = materialize(chosen, "state")
    left = attach(slotted, chosen.select(*spot, "_first", "_last"), spot, how="inner", stored=True)
    left = left.filter(F.col("_slot").between(F.col("_first"), F.col("_last"))).drop("_slot", "_first", "_last")
    return materialize(left, "inside"), chosen.drop("_first", "_last")


def _weighted_brackets(present: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Brackets for weighted values: the rank mass of a grid of sketched cut points is summed exactly."""
    grid = [i / CELLS for i in range(CELLS + 1)]
    cuts = present.groupBy(*keys).agg(F.percentile_approx("_x", grid, ACCURACY).alias("_g"))
    cuts = materialize(cuts.select(*keys, F.array_sort(F.array_distinct("_g")).alias("_g")), "grid")
    slotted = _with_slot(attach(present, cuts, keys, how="inner", stored=True), "_g", "_x").select(*keys, "_w", "_slot")
    mass = slotted.groupBy(*keys, "_slot").agg(F.sum("_w").alias("_c"))
    whole = Window.partitionBy(*keys)
    upto = mass.withColumn("_upto", F.sum("_c").over(whole.orderBy("_slot"))).withColumn(
        "_n", F.sum("_c").over(whole)
    )
    # slot s holds values in (g[s-1], g[s]]
    slot_of = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_slot")))
    spots = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    wanted = upto.groupBy(*keys, "_n").agg(
        *[slot_of(F.floor(s)).alias(f"_a{i}") for i, s in enumerate(spots)],
        *[slot_of(F.ceil(s)).alias(f"_b{i}") for i, s in enumerate(spots)],
    )
    edge = lambda i: F.when(i < 0, float("-inf")).otherwise(F.coalesce(F.get("_g", i), F.lit(float("inf"))))
    return wanted.join(cuts, keys).select(
        *keys,
        "_n",
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("prob"), edge(F.col(f"_a{i}") - 1).alias("lo"), edge(F.col(f"_b{i}")).alias("hi")
                )
                for i, p in enumerate(probs)
            ]
        ).alias("_brackets"),
    )


def _with_slot(df: DataFrame, cuts: str, x: str, out: str = "_slot") -> DataFrame:
    """Add how many of at most 2 * ``CELLS`` - 1 sorted cuts lie below ``x``, found by halving; 0 without cuts."""
    df, step = df.withColumn(out, F.lit(0)), CELLS
    while step:
        higher = F.get(cuts, F.col(out) + F.lit(step - 1)) < F.col(x)
        df, step = df.withColumn(out, F.col(out) + F.when(higher, step).otherwise(0)), step // 2
    return df


def linear(low: Column, high: Column, fraction: Column) -> Column:
    return low + fraction * (high - low)


def quantiles(
    values: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float], weight: str | None = None, most: int = MOST_RANKED
) -> DataFrame:
    """Linearly interpolated quantiles, one row per key and probability."""
    stats = order_statistics(values, keys, x, probs, weight, most)
    return stats.select(*keys, "prob", linear(F.col("low"), F.col("high"), F.col("fraction")).alias("quantile"))
