"""Ordered scans, positions, joins and quantiles against plain Python, with tiny segments."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabprep.operators import scale as sc
from tabprep.operators.numeric import iqr_bounds, numeric_parameters, prepare_numbers
from tabprep.operators.quantiles import _narrow_brackets, order_statistics, quantiles


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    # key "hot" owns most rows
    data = [("hot" if rng.random() < 0.8 else rng.choice("ab"), i, rng.choice([None, None, 1, 2, 3])) for i in range(500)]
    return data, spark.createDataFrame(data, "k string, i long, v int").repartition(7)


@pytest.mark.parametrize("inclusive", [True, False])
def test_scan_last(series, inclusive):
    data, df = series
    found = sc.scan_last(sc.chunked(df, "i", 3, "b"), ["k"], "b", ["i"], F.col("v"), "last", inclusive)
    seen, want = {}, {}
    for k, i, v in data:
        before = seen.get(k)
        if v is not None:
            seen[k] = v
        want[i] = seen.get(k) if inclusive else before
    assert {r.i: r["last"] for r in found.collect()} == want


def test_scan_sum(series):
    data, df = series
    found = sc.scan_sum(sc.chunked(df, "i", 4, "b"), ["k"], "b", ["i"], F.coalesce("v", F.lit(0)), "total")
    total, want = {}, {}
    for k, i, v in data:
        total[k] = total.get(k, 0) + (v or 0)
        want[i] = total[k]
    assert {r.i: r.total for r in found.collect()} == want


def test_positions(series):
    data, df = series
    placed = {r.i: r.pos for r in sc.positions(df, ["k"], ["i"]).collect()}
    want, n = {}, {}
    for k, i, _ in data:
        want[i] = n.get(k, 0)
        n[k] = want[i] + 1
    assert placed == want


@pytest.mark.parametrize("limit", [10, 0])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_attach_keeps_all_rows_on_both_paths(spark, series, limit, how):
    data, df = series
    data = data + [(None, 900, None)]
    df = df.union(spark.createDataFrame([(None, 900, None)], df.schema))
    side = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, w int")
    joined = sc.attach(df, side, ["k"], how=how, max_rows=limit)
    match = {"hot": 1, "a": 2}
    if how == "left":
        want = {i: match.get(k) for k, i, _ in data}
    elif how == "left_anti":
        want = {i: None for k, i, _ in data if k not in match}
    else:
        want = {i: match[k] if how == "inner" else None for k, i, _ in data if k in match}
    assert {r.i: r.w if "w" in joined.columns else None for r in joined.collect()} == want


def scans(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"Relation [{name}")


def test_chained_attach_reads_the_big_side_once(spark, series, tmp_path):
    _, df = series
    df.selectExpr("i as big_id", "k", "v").write.parquet(f"{tmp_path}/big")
    big = spark.read.parquet(f"{tmp_path}/big")
    side = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3)], "k string, w int")
    out = big
    for name in ("w1", "w2", "w3"):
        out = sc.attach(out, side.withColumnRenamed("w", name), ["k"], max_rows=0)
    assert scans(out, "big_id") == 1 and out.count() == big.count()


def test_bytes_decide_a_broadcast(series, spark):
    _, df = series
    side = spark.createDataFrame([("hot", "x" * 1000)], "k string, w string")
    plan = lambda limit: sc.attach(df, side, ["k"], max_bytes=limit)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(1 << 20) and "strategy=broadcast" not in plan(10)


def test_chunks_follow_ranks_not_positions(spark):
    sparse = spark.range(5000).select(F.xxhash64("id").alias("row_idx"))
    sizes = [r["count"] for r in sc.chunked(sparse, "row_idx", 500).groupBy("_chunk").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 800
    assert sc.chunked(sparse.limit(0), "row_idx", 500).count() == 0


@pytest.mark.parametrize("n", [1, 5, 6, 1000])
def test_first_rows_across_chunks(spark, n):
    data = [("s", i * 3) for i in range(40)] + [("t", i) for i in range(4)]
    df = spark.createDataFrame(data, "sheet_id string, row_idx long").repartition(5)
    got = rows(sc.first_rows(df, n, chunk_rows=7), "sheet_id", "row_idx")
    assert got == [("s", i * 3, i + 1) for i in range(min(n, 40))] + [("t", i, i + 1) for i in range(min(n, 4))]


def test_equal_share_buckets_keep_order(series):
    _, df = series
    got = rows(sc.equal_share_bucket(df, "i", 8).select("i", "_bucket"), "i")
    buckets = [b for _, b in got]
    assert buckets == sorted(buckets) and len(set(buckets)) == 8


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("size", [1, 2, 7, 1000, 30_000])
def test_quantiles_are_exact(spark, size, weight):
    rng = np.random.default_rng(size)
    values = np.round(rng.lognormal(0, 2, size), 2)
    values[rng.random(size) < 0.3] = 1.25  # one value holds a third of the rows
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(0, float(v)) for v in values], "k int, x double")
    if weight:
        df = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("w"))
    got = [r[2] for r in rows(quantiles(df, ["k"], "x", probs, weight), "prob")]
    assert np.allclose(got, np.quantile(values, probs))


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("most", [2, 40])
def test_quantiles_in_rounds(spark, weight, most):
    rng = np.random.default_rng(most)
    groups = {0: rng.lognormal(0, 3, 30_000), 1: rng.normal(0, 1, 200), 2: np.repeat(rng.normal(0, 1, 40), 500), 3: np.array([7.0])}
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([(k, float(v)) for k, values in groups.items() for v in values], "k int, x double")
    if weight:
        df = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("w"))
    got = [r[2] for r in rows(quantiles(df, ["k"], "x", probs, weight, most=most), "k", "prob")]
    assert np.allclose(got, np.concatenate([np.quantile(groups[k], probs) for k in sorted(groups)]))


def test_no_task_ranks_more_than_the_bound(spark):
    """Ten million distinct values of one group, in an order that equal-width cells could not part."""
    n, most = 10_000_000, 1000
    df = spark.range(n).select(F.lit("g").alias("k"), F.pow(F.lit(1.00001), F.pmod(F.col("id") * 7_368_787, F.lit(n)) / 10 - n / 20).alias("x"))
    inside, state = _narrow_brackets(df, ["k"], "x", [0.25, 0.5, 0.75], None, most)
    sizes = {r["prob"]: r["n"] for r in inside.groupBy("prob").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {r["prob"]: r["_size"] for r in state.collect()} and len(sizes) == 3 and all(2 <= s <= most for s in sizes.values())
    got = {r["prob"]: (r["low"], r["high"]) for r in order_statistics(df, ["k"], "x", [0.25, 0.5, 0.75], most=most).collect()}
    at = lambda i: 1.00001 ** (i / 10 - n / 20)
    for p, (low, high) in got.items():
        assert np.allclose([low, high], [at(int(np.floor(p * (n - 1)))), at(int(np.ceil(p * (n - 1))))], rtol=1e-12)


def test_numeric_preparation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(50, 10, 400)
    x[:5] = 900.0
    raw = [None if i % 7 == 0 else float(v) for i, v in enumerate(x)]
    df = spark.createDataFrame([("s", i, 0, v) for i, v in enumerate(raw)], "sheet_id string, row_idx long, col_idx int, number double")
    known = np.array([v for v in raw if v is not None])
    q1, q3 = np.quantile(known, [0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    median = np.median(np.clip(known, lo, hi))
    full = np.array([median if v is None else np.clip(v, lo, hi) for v in raw])
    bounds = iqr_bounds(df).first()
    assert np.allclose([bounds.lower, bounds.upper, bounds.median], [lo, hi, median])
    got = [r.value for r in prepare_numbers(df, numeric_parameters(df)).orderBy("row_idx").collect()]
    assert np.allclose(got, (full - full.mean()) / full.std())


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([("s", i, 0, 4.0) for i in range(5)], "sheet_id string, row_idx long, col_idx int, number double")
    assert {r.value for r in prepare_numbers(df, numeric_parameters(df)).collect()} == {0.0}


def test_slots_by_halving(spark):
    from bisect import bisect_left

    from tabprep.operators.quantiles import CELLS, _with_slot

    for cuts in ([], [0.0], [float(i) for i in range(CELLS + 1)], [float("-inf"), -1.5, 2.0, float("inf"), float("nan")]):
        xs = [-2.0, -1.5, 0.0, 0.5, 2.0, 255.5, 511.0, 512.0, 600.0, float("-inf")]
        df = spark.createDataFrame([(x, cuts) for x in xs], "x double, cuts array<double>")
        found = {r.x: r._slot for r in _with_slot(df, "cuts", "x").collect()}
        assert found == {x: bisect_left([c for c in cuts if c == c], x) for x in xs}


def test_bootstrap_weights_are_those_of_the_stable_unit(spark):
    """One replicate's mean by the definition: the number of Poisson steps that the row's unit reaches."""
    from hashlib import md5

    from tabprep.operators.evaluate import POISSON_STEPS, bootstrap_mean

    data = [(None if i % 97 == 0 else i, None if i % 31 == 5 else float(i * i % 1009)) for i in range(400)]
    got = bootstrap_mean(spark.createDataFrame(data, "k long, x double"), "k", "x", replicates=3, seed=5).first()
    means = []
    for r in (1, 2, 3):
        drawn = [(x, sum(int(md5((f"{r}:5" if k is None else f"{k}:{r}:5").encode()).hexdigest()[:13], 16) / 16**13 >= s for s in POISSON_STEPS)) for k, x in data if x is not None]
        means.append(sum(w * x for x, w in drawn) / sum(w for _, w in drawn))
    assert abs(got["mean"] - sum(means) / 3) < 1e-9 and min(means) <= got.low <= got.high <= max(means)
