import random
from hashlib import md5
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from acceptance.assignment import ticket_assignment_pools
from acceptance.assignment import tickets as order_tickets
from pyspark.sql import functions as F

from tabprep.operators import assign as asg
from tabprep.session import scratch_path, settings

TECH = "id string, name string, document string, regions array<string>, skills array<string>, availability string, workload int, max_workload int, projects array<string>, tier string"
PEOPLE = [
    ("ana", "Ana", "1.2-3", ["metro"], ["post-service", "batch-handling"], "ONLINE", 1, 5, ["project-1"], "L2"),
    ("bruno", "Bruno", "456", ["sur"], ["post-service"], "BUSY", 4, 4, ["project-1", "project-2"], "L1"),
    ("camila", "Camila", "789", ["metro"], ["batch-handling"], "ONLINE", 3, 6, ["project-2"], "L3"),
]
TICKET = "ticket_id string, project_id string, region string, required_skills array<string>, priority string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, TECH)


def tickets(spark, *items):
    return spark.createDataFrame(list(items), TICKET)


def test_hard_filter(spark, people):
    asked = asg.demands(tickets(spark, ("t1", "project-1", "metro", ["post-service"], "P2")))
    assert [r.id for r in asg.candidates(asked, people).collect()] == ["ana"]


def test_fallback_when_the_ranker_fails(spark, people):
    decided = asg.assign(tickets(spark, ("t1", "project-1", None, ["post-service"], "P2")), people, score=F.lit(None).cast("double"))
    d = decided.first()
    assert (d.strategy, d.technician_id) == ("deterministic-fallback", "ana")
    m = asg.assignment_metrics(decided).first()
    assert (m.ml_failures, m.fallback_decisions) == (0, 1)


def test_batch(spark, people):
    asked = tickets(
        spark, ("t1", "project-1", None, ["post-service"], "P2"), ("t2", "project-1", "", ["post-service"], "P1"),
        ("t3", "project-2", None, ["batch-handling"], "P2"), ("t4", "project-9", None, [], "P3"), ("t5", "project-1", "norte", [], "P3"),
    )
    decided = asg.assign(asked, people, pool=True)
    pools = {}
    for r in asg.pool_members(*asg.candidate_pools(asked, people)).collect():
        pools.setdefault(r.pool_id, []).append(r.id)
    got = {r.ticket_id: (r.technician_id, r.strategy, pools.get(r.pool_id, [])) for r in decided.collect()}
    assert got == {
        "t1": ("ana", "ml-ranking", ["ana"]), "t2": ("ana", "ml-ranking", ["ana"]), "t3": ("camila", "ml-ranking", ["camila"]),
        "t4": (None, "hard-stop", []), "t5": (None, "hard-stop", []),
    }
    m = asg.assignment_metrics(decided).first()
    assert (m.enqueued, m.processed, m.hard_stops) == (5, 5, 2)


def test_pools_of_many_buckets(spark):
    n = 70_000
    people = spark.range(n).selectExpr(
        "lpad(id, 6, '0') AS id", "'d' AS document", "array('m') AS regions", "if(id % 3 = 0, array('a', 'b'), array('a')) AS skills", "'ONLINE' AS availability",
        "0 AS workload", "1 AS max_workload", "array('p') AS projects", "'L1' AS tier",
    )
    asked = tickets(spark, ("x", "p", None, ["b"], "P1"), ("y", "p", "m", ["a"], "P1"), ("z", "p", None, ["c"], "P1"))
    decided = {r.ticket_id: r for r in asg.assign(asked, people, pool=True).collect()}
    pools, numbers = asg.candidate_pools(asked, people)
    assert pools.count() == 6 and decided["z"].pool_id is None
    members = asg.pool_members(pools, numbers).groupBy("pool_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.countDistinct("id").alias("d")).collect()
    assert {r.pool_id: (r.n, r.a, r.b, r.d) for r in members} == {
        decided["x"].pool_id: (23_334, "000000", "069999", 23_334), decided["y"].pool_id: (n, "000000", "069999", n),
    }
    assert (decided["x"].pool_size, decided["y"].pool_size) == (23_334, n)


def test_ties_go_to_lower_load_then_id(spark):
    same = [(i, "n", "d", ["m"], [], "ONLINE", 1, 4, ["p"], "L1") for i in ("b", "a", "c")]
    people = spark.createDataFrame(same, TECH)
    asked = tickets(spark, ("t", "p", "m", [], "P1"))
    assert asg.assign(asked, people).first().technician_id == "a"
    ranked = asg.rank_candidates(asg.candidates(asg.demands(asked), people))
    assert [r.id for r in ranked.orderBy("place").collect()] == ["a", "b", "c"]


def test_one_project_holding_most_tickets(spark, people):
    many = spark.range(20_000).select(
        F.concat(F.lit("t"), "id").alias("ticket_id"), F.when(F.col("id") % 3 > 0, "project-1").otherwise("project-2").alias("project_id"),
        F.lit(None).cast("string").alias("region"), F.array(F.lit("batch-handling")).alias("required_skills"), F.lit("P2").alias("priority"),
    )
    assert asg.demands(many).count() == 2
    per = {r.technician_id: r["count"] for r in asg.assign(many, people).groupBy("technician_id").count().collect()}
    assert per == {"ana": 13_333, "camila": 6_667}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tickets_are_hashed_to_demands(spark, people):
    """Tickets are neither sorted nor keyed one by one: only their wordings are."""
    seldom, usual = ("project-1", "", ["post-service", None, "batch-handling"], "P2"), ("project-1", None, ["batch-handling", "post-service", "post-service"], "P2")
    others = [("project-2", None, [], None), (None, None, None, "P1")]
    asked = tickets(spark, *[(f"t{i}", *d) for i, d in enumerate([seldom, usual, usual, usual, *others])])
    found = asg.demands(asked)
    assert plan(found).rindex("HashAggregate") > plan(found).rindex("Sort") and "lambda" not in plan(found)
    assert sorted((tuple(r) for r in found.drop("demand").collect()), key=str) == sorted([usual, *others], key=str)
    decided = {r.ticket_id: (r.technician_id, r.strategy) for r in asg.assign(asked, people).collect()}
    assert decided["t1"] == decided["t2"] == decided["t3"] == ("ana", "ml-ranking") and len(decided) == 6


def test_skills_of_tickets_without_lambdas(spark, tmp_path):
    made = {
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string", [(1, 1, "O", 3e5, "1-URGENT"), (2, 1, "F", None, None), (3, 2, None, 3e5, "5-LOW"), (4, 2, "P", 1.0, "2-HIGH"), (4, 2, "P", 1.0, "2-HIGH")]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 1, "BUILDING"), (2, 1, None)]),
        "nation": ("n_nationkey int, n_regionkey int", [(1, 1)]),
        "region": ("r_regionkey int, r_name string", [(1, "ASIA")]),
    }
    for name, (schema, data) in made.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    asked = order_tickets(spark, str(tmp_path))
    assert "lambda" not in plan(asked)
    skills = sorted((r.ticket_id, tuple(r.required_skills), r.region) for r in asked.collect())
    assert skills == [("1", ("batch-handling", "install"), "ASIA"), ("2", ("install",), None), ("3", ("batch-handling",), None), ("4", (), "ASIA"), ("4", (), "ASIA")]


def _random_sides(spark, seed, n, hot):
    """Demands and technicians; ``hot`` of both belong to one project."""
    pick = random.Random(seed)
    some = lambda names, most: [x for x in names if pick.random() < most]
    project = lambda: "big" if pick.random() < hot else f"p{pick.randrange(6)}"
    techs = [
        (f"t{i:04d}", "n", "d", pick.choice([some(["N", "S", "W"], 0.5), None, [None, "N"]]), some(["a", "b", "c", "d"], 0.6), pick.choice(["ONLINE", "BUSY", "OFFLINE"]),
         pick.randrange(4), pick.randrange(1, 5), list({project() for _ in range(2)}), pick.choice(["L1", "L2", "L3"]))
        for i in range(n)
    ]
    asked = [(f"k{i}", project(), pick.choice(["N", "S", "", None, "X"]), pick.choice([some(["a", "b", "c", "e"], 0.4), ["a", "a"], None]), pick.choice(["P1", "P2", None])) for i in range(n)]
    return asked, techs


def _pairs(asked, techs):
    out = set()
    for _, project, region, skills, priority in asked:
        for t in techs:
            fits = t[5] != "OFFLINE" and t[6] < t[7] and project in t[8] and (not region or region in (t[3] or []))
            if fits and skills is not None and set(skills) <= set(t[4]):
                out.add((project, region or "", tuple(sorted(set(skills))), priority or "", t[0]))
    return out


@pytest.mark.parametrize("most", [3, 65_536])
def test_posting_lists_against_all_pairs(spark, most):
    asked, techs = _random_sides(spark, 11, 150, 0.4)
    found = asg.candidates(asg.demands(tickets(spark, *asked)), spark.createDataFrame(techs, TECH), most)
    got = [(r.project_id, r.region or "", tuple(sorted(set(r.required_skills))), r.priority or "", r.id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(asked, techs)


def test_a_hot_project_is_dealt_over_slots(spark):
    asked, techs = _random_sides(spark, 12, 900, 0.9)
    people = asg.directory(spark.createDataFrame(techs, TECH))
    wanted = asg.demands(tickets(spark, *asked))
    longest = people.sizes.agg(F.max("_n")).first()[0]
    met = asg._fitting(wanted, people, most=20)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert longest > 200 and "_slot" in plan
    per_task = met.filter("project_id = 'big'").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1 and set(met.select("demand", "id").collect()) == set(asg._fitting(wanted, people).select("demand", "id").collect())


def test_ranking_without_a_window_task_and_with_partial_limits(spark):
    asked, techs = _random_sides(spark, 13, 200, 0.5)
    pairs = asg.candidates(asg.demands(tickets(spark, *asked)), spark.createDataFrame(techs, TECH))
    whole = asg.rank_candidates(pairs)
    assert "Window " not in whole._jdf.queryExecution().executedPlan().toString().replace("WindowGroupLimit", "")
    top = asg.rank_candidates(pairs, top=2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    listed = [(r.demand, r.place, r.id, r.score) for r in whole.filter("place <= 2").collect()]
    assert sorted(listed) == sorted((r.demand, r.place, r.id, r.score) for r in top.collect())
    groups = {}
    for r in whole.collect():
        groups.setdefault(r.demand, []).append((r.place, -r.score, r.workload / max(r.max_workload, 1), r.id))
    for rows_of in groups.values():
        rows_of.sort()
        assert [r[0] for r in rows_of] == [*range(1, len(rows_of) + 1)] and [r[1:] for r in rows_of] == sorted(r[1:] for r in rows_of)


def test_best_by_history(spark):
    asked, techs = _random_sides(spark, 14, 60, 0.5)
    pairs = asg.candidates(asg.demands(tickets(spark, *asked)), spark.createDataFrame(techs, TECH)).withColumn("kind", F.lit("x"))
    past = spark.createDataFrame([(t[0], "x") for t in techs[:30] for _ in range(int(t[0][1:]) % 4)], "technician_id string, kind string")
    every = {}
    for r in asg.history_rank(pairs, past, "kind").collect():
        every.setdefault(r.demand, []).append((-r.score, r.workload / max(r.max_workload, 1), r.id))
    best = asg.history_rank(pairs, past, "kind", top=3).collect()
    assert sorted((r.demand, r.place, r.id) for r in best) == sorted((d, n, x[2]) for d, found in every.items() for n, x in enumerate(sorted(found)[:3], 1))


def test_identity(spark, people):
    found = asg.match_identity(spark.createDataFrame([("1 23",), ("000",), (None,)], "identity_document string"), people)
    assert sorted(((r.technician_id or ""), r.policy) for r in found.collect()) == [("", "REVIEW"), ("", "REVIEW"), ("ana", "AUTO_ASSIGN")]


def test_tickets_of_a_pool_are_laid_out_together(spark):
    """60 pools dealt over the tickets in turn, a third of which are of one: a task meets few, the large one meets many tasks."""
    decided = spark.range(9_000).selectExpr("cast(id AS string) AS ticket_id", "if(id % 3 = 0, 'p', concat('p', id % 60)) AS pool_id", "repeat('x', 10) AS note")
    laid = asg.by_pool(decided, 30)
    met = laid.groupBy(F.spark_partition_id().alias("task"), "pool_id").count().collect()
    assert sum(r["count"] for r in met) == 9_000 and len(met) <= 41 + 30
    assert len({r.task for r in met if r.pool_id == "p"}) >= 8
    assert sorted(tuple(r) for r in laid.collect()) == sorted(tuple(r) for r in decided.collect())


def test_a_pool_of_more_text_than_a_dictionary_stands_in_a_file_once(spark):
    """95,000 technicians fit all of 300 tickets; each names them in 1.3 MB, which Parquet's dictionary does not take by itself."""
    sf = scratch_path(spark, "tables")
    spark.range(1).selectExpr("cast(0 AS int) AS r_regionkey", "'ASIA' AS r_name").write.parquet(f"{sf}/region.parquet")
    spark.range(1).selectExpr("cast(0 AS int) AS n_nationkey", "cast(0 AS int) AS n_regionkey").write.parquet(f"{sf}/nation.parquet")
    spark.range(1).selectExpr("1 AS c_custkey", "cast(0 AS int) AS c_nationkey", "'FURNITURE' AS c_mktsegment").write.parquet(f"{sf}/customer.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "1 AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice", "'1-URGENT' AS o_orderpriority").write.parquet(f"{sf}/orders.parquet")
    spark.range(95_000).selectExpr("70000000 + id * 14 AS s_suppkey", "cast(0 AS int) AS s_nationkey", "5000.0D AS s_acctbal").write.parquet(f"{sf}/supplier.parquet")
    pool = ",".join(sorted(f"tech-{70_000_000 + i * 14}" for i in range(95_000)))
    out = scratch_path(spark, "pools")
    with settings(spark, {asg.DICTIONARY_SIZE: str(asg.DICTIONARY_BYTES)}):
        ticket_assignment_pools(spark, sf).write.parquet(out)
        assert len(pool) > asg.DICTIONARY_BYTES and int(spark.conf.get(asg.DICTIONARY_SIZE)) > len(pool)
    files = [pq.ParquetFile(f).metadata for f in Path(out).glob("*.parquet")]
    held = sum(f.row_group(g).column(1).total_uncompressed_size for f in files for g in range(f.num_row_groups))
    assert len(files) <= 16 and held < 1.1 * len(pool) * len(files) < 300 * len(pool) / 5
    got = spark.read.parquet(out)
    assert got.select("ticket_id").distinct().count() == 300 == got.filter(F.md5("candidate_pool") == md5(pool.encode()).hexdigest()).count()


def test_the_room_for_texts_is_only_raised(spark):
    texts = lambda n, size: spark.range(n).selectExpr(f"if(id = 0, NULL, repeat('x', {size})) AS v")
    with settings(spark, {asg.DICTIONARY_SIZE: "3000000"}):
        for n, size, room in [(0, 1, 3_000_000), (3, 1_000_000, 3_000_000), (5, 1_000_000, 4_000_016), (3, 1_000_000, 4_000_016), (101, 1_000_000, asg.MOST_DICTIONARY_BYTES)]:
            asg.room_for_texts(texts(n, size), "v")
            assert int(spark.conf.get(asg.DICTIONARY_SIZE)) == room
    with settings(spark, {asg.DICTIONARY_SIZE: str(100 << 20)}):
        asg.room_for_texts(texts(101, 1_000_000), "v")
        assert int(spark.conf.get(asg.DICTIONARY_SIZE)) == 100 << 20
    with settings(spark, {asg.DICTIONARY_SIZE: "1"}):
        spark.conf.unset(asg.DICTIONARY_SIZE)
        asg.room_for_texts(texts(3, 10), "v")
        assert spark.conf.get(asg.DICTIONARY_SIZE, None) is None
