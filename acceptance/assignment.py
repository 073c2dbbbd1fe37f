"""Tickets are orders (region from the customer's nation), technicians are suppliers."""

import pandas as pd
from pyspark.sql import functions as F

from acceptance.base import query, table
from tabprep.operators import assign as asg
from tabprep.operators.scale import attach
from tabprep.session import materialize

#: Texts of all pools, as stored, that are sent to every task.
POOL_TEXT_BYTES = 64 << 20
_TICKET = {
    "ticket_id": "cast(o_orderkey as {s})",
    "project_id": "concat('project-', o_orderstatus)",
    "region": "case when o_orderpriority <> '5-LOW' then r_name end",
    "priority": "case when o_orderpriority = '1-URGENT' then 'P1' when o_orderpriority in ('2-HIGH', '3-MEDIUM') then 'P2' else 'P3' end",
}
_SKILLS = [("case when o_totalprice > 250000 then 'batch-handling' end"), ("case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'install' end")]
_TECH = {
    "id": "concat('tech-', s_suppkey)",
    "document": "concat(s_suppkey, '.', s_nationkey, '-K')",
    "availability": "case when s_acctbal < 0 then 'OFFLINE' when s_acctbal < 3000 then 'BUSY' else 'ONLINE' end",
    "workload": "cast(s_suppkey % 7 as int)",
    "max_workload": "cast(3 + s_nationkey % 5 as int)",
    "tier": "case when s_acctbal > 7000 then 'L3' when s_acctbal > 4000 then 'L2' else 'L1' end",
}
_PROJECTS = ["case when s_suppkey % 2 = 0 then 'project-O' end", "case when s_suppkey % 3 <> 0 then 'project-F' end", "case when s_nationkey > 12 then 'project-P' end"]
_HELD = ["case when s_suppkey % 4 <> 1 then 'batch-handling' end", "case when s_acctbal > 2000 then 'install' end", "'post-service'"]


def tickets(spark, sf):
    people = table(spark, sf, "customer").join(F.broadcast(_places(spark, sf)), F.expr("c_nationkey = n_nationkey"))
    rows = table(spark, sf, "orders").join(people, F.expr("o_custkey = c_custkey"))
    return rows.select(
        *[F.expr(e.format(s="string")).alias(c) for c, e in _TICKET.items()],
        # one compiled expression; array_compact would look at every row's array through a lambda
        F.concat(*[F.when(F.expr(e).isNotNull(), F.array(F.expr(e))).otherwise(F.array().cast("array<string>")) for e in _SKILLS]).alias("required_skills"),
        F.col("o_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("kind"),
    )


def _places(spark, sf):
    # nations and regions are the fixed 25- and 5-row tables
    return table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.expr("n_regionkey = r_regionkey"))


def technicians(spark, sf):
    rows = table(spark, sf, "supplier").join(F.broadcast(_places(spark, sf)), F.expr("s_nationkey = n_nationkey"))
    return rows.select(
        *[F.expr(e).alias(c) for c, e in _TECH.items()],
        F.array_compact(F.array(F.col("r_name"), F.expr("case when s_suppkey % 5 = 0 then 'ASIA' end"))).alias("regions"),
        F.array_compact(F.array(*[F.expr(e) for e in _HELD])).alias("skills"),
        F.array_compact(F.array(*[F.expr(e) for e in _PROJECTS])).alias("projects"),
    )


def _compact(parts):
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


ASSIGN_SQL = f"""tickets AS (SELECT {', '.join(f"{e.format(s='varchar')} AS {c}" for c, e in _TICKET.items())}, {_compact(_SKILLS)} AS required_skills, o_custkey, c_mktsegment AS kind
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  techs AS (SELECT {', '.join(f"{e} AS {c}" for c, e in _TECH.items())}, {_compact(["r_name", "case when s_suppkey % 5 = 0 then 'ASIA' end"])} AS regions,
    {_compact(_HELD)} AS skills, {_compact(_PROJECTS)} AS projects FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  want AS (SELECT DISTINCT project_id, region, required_skills, priority, kind FROM tickets),
  cand AS (SELECT w.*, t.id, t.workload, t.tier, t.workload / greatest(t.max_workload, 1) AS load, coalesce(list_contains(t.regions, w.region), false) AS near
    FROM want w JOIN techs t ON availability <> 'OFFLINE' AND workload < max_workload AND list_contains(projects, project_id)
      AND (region IS NULL OR list_contains(regions, region)) AND list_has_all(skills, required_skills)),
  ranked AS (SELECT *, CASE priority WHEN 'P1' THEN 1.2::DOUBLE WHEN 'P2' THEN 1.05::DOUBLE ELSE 1::DOUBLE END - load
    + CASE tier WHEN 'L3' THEN 1::DOUBLE WHEN 'L2' THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END + CASE WHEN near THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS score FROM cand)"""


def _decided(best, extra=""):
    return f"""WITH {ASSIGN_SQL}{extra}, dec AS (SELECT project_id, region, required_skills, priority, kind, {best} AS best, arg_min(id, struct_pack(a := workload, b := tier, c := id)) AS fallback,
      count(*) AS pool_size FROM ranked GROUP BY ALL),
    decisions AS (SELECT ticket_id, coalesce(best, fallback) AS technician_id, CASE WHEN pool_size IS NULL THEN 'hard-stop' WHEN best IS NOT NULL THEN 'ml-ranking'
      ELSE 'deterministic-fallback' END AS strategy, coalesce(pool_size, 0) AS pool_size FROM tickets t LEFT JOIN dec d ON t.project_id = d.project_id
      AND t.region IS NOT DISTINCT FROM d.region AND t.required_skills = d.required_skills AND t.priority = d.priority AND t.kind = d.kind)"""


_BEST = "arg_min(id, struct_pack(a := -score, b := load, c := id))"


@query(
    "assignment_candidates",
    f"WITH {ASSIGN_SQL} SELECT DISTINCT project_id, region, array_to_string(required_skills, ',') AS skills, priority, id FROM cand",
)
def assignment_candidates(spark, sf):
    pairs = asg.candidates(materialize(asg.demands(tickets(spark, sf)), "demands"), technicians(spark, sf))
    return pairs.select("project_id", "region", F.array_join("required_skills", ",").alias("skills"), "priority", "id")


@query(
    "ranked_candidates",
    f"""WITH {ASSIGN_SQL}, d AS (SELECT DISTINCT ON (project_id, region, required_skills, priority, id) * FROM ranked)
    SELECT project_id, region, array_to_string(required_skills, ',') AS skills, priority, id, round(score, 6) AS score,
    row_number() OVER (PARTITION BY project_id, region, required_skills, priority ORDER BY score DESC, load, id)::INTEGER AS place FROM d""",
)
def ranked_candidates(spark, sf):
    pairs = asg.candidates(materialize(asg.demands(tickets(spark, sf)), "demands"), technicians(spark, sf))
    return asg.rank_candidates(pairs).select(
        "project_id", "region", F.array_join("required_skills", ",").alias("skills"), "priority", "id", F.round("score", 6).alias("score"), "place"
    )


@query(
    "top_candidates",
    f"""WITH {ASSIGN_SQL}, d AS (SELECT DISTINCT ON (project_id, region, required_skills, priority, id) * FROM ranked),
    p AS (SELECT *, row_number() OVER (PARTITION BY project_id, region, required_skills, priority ORDER BY score DESC, load, id)::INTEGER AS place FROM d)
    SELECT project_id, region, array_to_string(required_skills, ',') AS skills, priority, id, place FROM p WHERE place <= 3""",
)
def top_candidates(spark, sf):
    pairs = asg.candidates(materialize(asg.demands(tickets(spark, sf)), "demands"), technicians(spark, sf))
    best = asg.rank_candidates(pairs, top=3)
    return best.select("project_id", "region", F.array_join("required_skills", ",").alias("skills"), "priority", "id", "place")


@query("ticket_assignment", _decided(_BEST) + " SELECT * FROM decisions")
def ticket_assignment(spark, sf):
    return asg.assign(tickets(spark, sf), technicians(spark, sf)).select("ticket_id", "technician_id", "strategy", "pool_size")


@query(
    "ticket_assignment_pools",
    _decided(_BEST) + """, pools AS (SELECT project_id, region, required_skills, priority, kind, string_agg(id, ',' ORDER BY id) AS candidate_pool FROM cand GROUP BY ALL)
    SELECT ticket_id, coalesce(candidate_pool, '') AS candidate_pool FROM tickets t LEFT JOIN pools d ON t.project_id = d.project_id
      AND t.region IS NOT DISTINCT FROM d.region AND t.required_skills = d.required_skills AND t.priority = d.priority AND t.kind = d.kind""",
)
def ticket_assignment_pools(spark, sf):
    asked, people = tickets(spark, sf), technicians(spark, sf)
    decided = asg.by_pool(asg.assign(asked, people, pool=True).select("ticket_id", "pool_id"))
    members = asg.pool_members(*asg.candidate_pools(asked, people))
    shown = materialize(members.groupBy("pool_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("candidate_pool")), "shown")
    asg.room_for_texts(shown, "candidate_pool")
    return attach(decided, shown, ["pool_id"], max_bytes=POOL_TEXT_BYTES, stored=True).select("ticket_id", F.coalesce("candidate_pool", F.lit("")).alias("candidate_pool"))


@query("fallback_assignment", _decided("NULL::VARCHAR") + " SELECT * FROM decisions")
def fallback_assignment(spark, sf):
    failed = asg.assign(tickets(spark, sf), technicians(spark, sf), score=F.lit(None).cast("double"))
    return failed.select("ticket_id", "technician_id", "strategy", "pool_size")


def _even_load(pairs):
    """A user's own ranker as a vectorised UDF: prefers free capacity, gives up on tier L1."""

    @F.pandas_udf("double")
    def free(workload: pd.Series, most: pd.Series, tier: pd.Series) -> pd.Series:
        return (most - workload).astype(float).where(tier != "L1")

    return pairs.withColumn("score", free("workload", "max_workload", "tier"))


@query(
    "custom_ranker_assignment",
    _decided(
        "arg_min(id, struct_pack(a := -free, b := load, c := id)) FILTER (free IS NOT NULL)"
    ).replace("load, coalesce(list_contains", "load, CASE WHEN t.tier <> 'L1' THEN (t.max_workload - t.workload)::DOUBLE END AS free, coalesce(list_contains")
    + " SELECT * FROM decisions",
)
def custom_ranker_assignment(spark, sf):
    decided = asg.assign(tickets(spark, sf), technicians(spark, sf), scorer=_even_load)
    return decided.select("ticket_id", "technician_id", "strategy", "pool_size")


@query(
    "assignment_metrics",
    _decided(_BEST) + """ SELECT count(*) AS enqueued, count(*) AS processed, 0::BIGINT AS ml_failures,
    count(*) FILTER (strategy = 'deterministic-fallback') AS fallback_decisions, count(*) FILTER (strategy = 'hard-stop') AS hard_stops FROM decisions""",
)
def assignment_metrics(spark, sf):
    return asg.assignment_metrics(asg.assign(tickets(spark, sf), technicians(spark, sf)))


def _failing_ranker(pairs):
    """Fails on urgent tickets, and ranks nobody for the next priority."""
    score = F.when(F.col("priority") != "P2", asg.ranking_score())
    return pairs.withColumn("score", score).withColumn("ranker_failed", F.col("priority") == "P1")


@query(
    "assignment_metrics_failing_ranker",
    _decided(_BEST) + """ SELECT count(*) AS enqueued, count(*) AS processed, count(*) FILTER (strategy <> 'hard-stop' AND priority = 'P1') AS ml_failures,
    count(*) FILTER (strategy <> 'hard-stop' AND priority IN ('P1', 'P2')) AS fallback_decisions, count(*) FILTER (strategy = 'hard-stop') AS hard_stops
    FROM decisions JOIN tickets USING (ticket_id)""",
)
def assignment_metrics_failing_ranker(spark, sf):
    return asg.assignment_metrics(asg.assign(tickets(spark, sf), technicians(spark, sf), scorer=_failing_ranker))


@query(
    "tickets_from_jobs",
    """SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, CAST(o_custkey AS VARCHAR) AS job_id, 'project-' || c_nationkey AS project_id,
    CASE WHEN c_acctbal > 0 THEN 'post-service' ELSE 'batch-handling' END AS skill, CASE WHEN c_acctbal > 0 THEN 'P1' ELSE 'P2' END AS priority,
    lower(o_orderstatus || o_custkey || 'k') AS identity_document FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def tickets_from_jobs(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("ticket_id"), F.col("o_custkey").cast("string").alias("job_id"), F.lit(None).cast("string").alias("region"),
        F.expr("concat(' ', o_orderstatus, '. ', o_custkey, '-K')").alias("identity_document"),
    )
    jobs = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"), F.expr("concat('project-', c_nationkey)").alias("project_id"),
        F.expr("case when c_acctbal > 0 then 'POST_SERVICE' else 'MASS_CREATE' end").alias("mode"),
    )
    return asg.build_tickets(rows, jobs).withColumn("skill", F.get("required_skills", F.lit(0))).drop("region", "required_skills")


@query(
    "identity_matches",
    f"""WITH {ASSIGN_SQL}, d AS (SELECT lower(regexp_replace(document, '[\\s.-]', '', 'g')) AS doc, min(id) AS id FROM techs GROUP BY 1)
    SELECT o_orderkey, d.id AS technician_id, CASE WHEN d.id IS NULL THEN 'REVIEW' ELSE 'AUTO_ASSIGN' END AS policy,
    CASE WHEN d.id IS NOT NULL THEN 0.78::DOUBLE END AS confidence FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN d ON d.doc = concat(o_custkey, c_nationkey, 'k')""",
)
def identity_matches(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).select(
        "o_orderkey", F.expr("concat(o_custkey, ' ', c_nationkey, '-k')").alias("identity_document")
    )
    return asg.match_identity(rows, technicians(spark, sf)).drop("identity_document")


@query(
    "history_ranking",
    f"""WITH {ASSIGN_SQL}, hist AS (SELECT 'tech-' || l_suppkey AS id, l_returnflag AS project_flag FROM lineitem),
      c AS (SELECT id, project_flag, count(*) AS n FROM hist GROUP BY ALL), a AS (SELECT project_flag, count(*) AS n FROM hist GROUP BY 1),
      u AS (SELECT DISTINCT ON (project_id, region, required_skills, priority, id) *, CASE project_id WHEN 'project-O' THEN 'N' WHEN 'project-F' THEN 'A' ELSE 'R' END AS project_flag FROM ranked)
    SELECT project_id, region, array_to_string(required_skills, ',') AS skills, priority, u.id, round(score + 0.5 * coalesce(c.n / a.n, 0), 6) AS score
    FROM u LEFT JOIN c ON c.id = u.id AND c.project_flag = u.project_flag LEFT JOIN a ON a.project_flag = u.project_flag""",
)
def history_ranking(spark, sf):
    pairs = asg.candidates(materialize(asg.demands(tickets(spark, sf)), "demands"), technicians(spark, sf)).withColumn(
        "flag", F.expr("case project_id when 'project-O' then 'N' when 'project-F' then 'A' else 'R' end")
    )
    past = table(spark, sf, "lineitem").select(F.expr("concat('tech-', l_suppkey)").alias("technician_id"), F.col("l_returnflag").alias("flag"))
    return asg.history_rank(pairs, past, "flag").select(
        "project_id", "region", F.array_join("required_skills", ",").alias("skills"), "priority", "id", F.round("score", 6).alias("score")
    )
