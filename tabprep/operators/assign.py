"""Assign tickets to technicians: hard filters, ranking, fallback, decisions and metrics.

Which technicians qualify depends only on what a ticket asks for (project, region, skills,
priority). Tickets are therefore reduced to their distinct demands first; the join with the
directory and the ranking run once per demand, and the outcome is joined back to the tickets. A
project with a third of all tickets costs no more than any other.

``tickets(ticket_id, project_id, region, required_skills ARRAY, priority)``
``technicians(id, document, regions ARRAY, skills ARRAY, availability, workload, max_workload,
projects ARRAY, tier)``. Workload is a snapshot: it is not changed by the assignments of a run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.text import normalize_document_id
from tabprep.operators.scale import attach, positions
from tabprep.session import materialize

DEMAND = ["project_id", "region", "required_skills", "priority"]
#: Key of a posting list, and rows of one that a task meets at a time.
POSTING = ["project_id", "_region", "_skill"]
POSTING_ROWS = 65_536
#: Most tasks that tickets are laid out over by their pool.
POOL_TASKS = 2_000
#: Bytes of texts that the dictionary of one Parquet file takes, and most that it is set to.
DICTIONARY_SIZE = "parquet.dictionary.page.size"
DICTIONARY_BYTES, MOST_DICTIONARY_BYTES = 1 << 20, 64 << 20

# Weights of the ranking score and outcomes of a decision.
PRIORITY_WEIGHT = {"P1": 1.2, "P2": 1.05}
OTHER_PRIORITY_WEIGHT = 1.0
TIER_WEIGHT = {"L3": 1.0, "L2": 0.9}
OTHER_TIER_WEIGHT = 0.75
REGION_BONUS = 0.1
RANKED, FALLBACK, HARD_STOP = "ml-ranking", "deterministic-fallback", "hard-stop"
RANKER_FAILED = "ranker-failed"
MATCH_CONFIDENCE = 0.78


def _demand_key() -> Column:
    """Text key of a demand; skills are a set. Null and empty region both mean no wish."""
    return F.concat_ws(
        "\x1f",
        F.coalesce("project_id", F.lit("\x00")),
        F.coalesce("region", F.lit("")),
        F.coalesce("priority", F.lit("")),
        # skills that are null leave no trace, so they may come first; this sort is compiled, array_sort is not
        F.array_join(F.sort_array(F.array_distinct("required_skills")), "\x1e"),
    )


def demands(tickets: DataFrame) -> DataFrame:
    """Distinct demands with their key; partial aggregation absorbs hot projects.

    Tickets are counted by wording first, which Spark hashes; picking a text or an array per key would sort all tickets.
    Of the wordings of one demand (e.g. its skills in another order) the most frequent stands for it.
    """
    wordings = tickets.groupBy(*DEMAND).agg(F.count(F.lit(1)).alias("_n")).withColumn("demand", _demand_key())
    return wordings.groupBy("demand").agg(F.max_by(F.struct(*DEMAND), F.struct("_n", *DEMAND)).alias("_d")).select("demand", "_d.*")


def _able(technicians: DataFrame) -> DataFrame:
    """Technicians with free capacity, one row per project."""
    able = technicians.filter((F.col("availability") != "OFFLINE") & (F.col("workload") < F.col("max_workload")))
    return able.withColumn("project_id", F.explode(F.array_distinct("projects")))


@dataclass(frozen=True)
class Directory:
    """Technicians, or classes of them, as posting lists: one row for each project, region and skill that may be asked for.

    ``_region`` and ``_skill`` are empty in the lists for any region and for no skill; ``sizes`` has the rows of each list.
    """

    postings: DataFrame
    sizes: DataFrame


def directory(technicians: DataFrame, classes: bool = False) -> Directory:
    """Index of the technicians with free capacity, or of their classes, stored for any number of demands."""
    able = technician_classes(technicians) if classes else _able(technicians)
    listed = lambda c: F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))))
    postings = materialize(able.withColumn("_region", listed("regions")).withColumn("_skill", listed("skills")), "postings")
    return Directory(postings, materialize(postings.groupBy(*POSTING).agg(F.count(F.lit(1)).alias("_n")), "sizes"))


def _fitting(wanted: DataFrame, people: Directory, most: int = POSTING_ROWS) -> DataFrame:
    """Demands with the technicians of their shortest posting list who also have the other skills.

    Every list holds those of one project with the region and one of the skills asked for, so project, region and
    one skill need no further test. Lists of more than ``most`` rows are dealt over slots and the demands on them are
    repeated for each, so a project with a third of both sides meets many tasks.
    """
    keyed = wanted.withColumn("_region", F.coalesce("region", F.lit("")))
    asked = F.when(F.size("required_skills") == 0, F.array(F.lit(""))).otherwise(F.array_distinct("required_skills"))
    choices = attach(keyed.select("demand", "project_id", "_region", F.explode(asked).alias("_skill")), people.sizes, POSTING, stored=True)
    shortest = choices.groupBy("demand").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_skill")).alias("_s"))
    # a list that does not exist is the shortest: nobody fits
    shortest = shortest.filter("_s.n > 0").select("demand", "_s._skill", F.ceil(F.col("_s.n") / most).alias("_slots"))
    placed = materialize(keyed.join(shortest, "demand"), "placed")
    used = placed.select(*POSTING, "_slots").distinct()
    dealt = attach(people.postings, used, POSTING, how="inner").withColumn("_slot", F.pmod(F.xxhash64("id"), F.col("_slots"))).drop("_slots")
    repeated = placed.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1))).drop("_slots")
    met = repeated.join(dealt, [*POSTING, "_slot"]).filter(F.size(F.array_except("required_skills", "skills")) == 0)
    return met.drop("_region", "_skill", "_slot")


def candidates(wanted: DataFrame, technicians: DataFrame | Directory, most: int = POSTING_ROWS) -> DataFrame:
    """Demand × technician pairs that pass every hard filter, for listings and rankers of one's own."""
    return _fitting(wanted, technicians if isinstance(technicians, Directory) else directory(technicians), most)


def technician_classes(technicians: DataFrame) -> DataFrame:
    """Technicians that no demand and no ranking can tell apart, as one row with the lowest id.

    Members of a class share project, regions, skills, tier and load, hence every filter and every
    score; the tie goes to the lowest id. Demands meet classes instead of people.
    """
    same = lambda c: F.array_sort(F.array_distinct(c)).alias(c)
    return _able(technicians).select(
        "project_id", same("regions"), same("skills"), "tier", "workload", "max_workload", "id"
    ).groupBy("project_id", "regions", "skills", "tier", "workload", "max_workload").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("members")
    )


def ranking_score() -> Column:
    """Priority weight − relative load + tier weight + region bonus."""
    def pick(column, weights, other):
        out = F
        for value, weight in weights.items():
            out = out.when(F.col(column) == value, weight)
        return out.otherwise(other)

    region = F.coalesce((F.col("region") != "") & F.expr("array_contains(regions, region)"), F.lit(False))
    return (
        pick("priority", PRIORITY_WEIGHT, OTHER_PRIORITY_WEIGHT)
        - load_share()
        + pick("tier", TIER_WEIGHT, OTHER_TIER_WEIGHT)
        + F.when(region, REGION_BONUS).otherwise(0.0)
    )


def load_share() -> Column:
    return F.col("workload") / F.greatest("max_workload", F.lit(1))


def rank_candidates(pairs: DataFrame, score: Column | None = None, top: int | None = None) -> DataFrame:
    """Place of each candidate of a demand: score, then lower load, then id (binary order).

    With ``top`` every task keeps the best ``top`` of each of its demands, and only those are shuffled and ranked again.
    Without it all candidates of all demands are sorted once by ranges, so a demand may have any number of them.
    """
    scored = pairs.withColumn("score", ranking_score() if score is None else score)
    if top is None:
        keys = {"_worse": -F.col("score"), "_load": load_share()}
        return positions(scored.withColumns(keys), ["demand"], [*keys, "id"], out="_pos").withColumn("place", (F.col("_pos") + 1).cast("int")).drop(*keys, "_pos")
    order = Window.partitionBy("demand").orderBy(F.desc("score"), load_share(), "id")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def decide(pairs: DataFrame, score: Column | None = None) -> DataFrame:
    """Best, fallback and pool size per demand in one grouped pass.

    A null score leaves a candidate out; a demand without any score falls back to the lowest workload, tier
    and id. So does one with a true ``ranker_failed`` (a column that a scorer may add), whatever its scores.
    """
    failed = F.col("ranker_failed") if "ranker_failed" in pairs.columns else F.lit(False)
    scored = pairs.withColumn("_score", ranking_score() if score is None else score).withColumn("_load", load_share())
    ranked = F.when(F.col("_score").isNotNull(), F.struct(-F.col("_score"), F.col("_load"), F.col("id")))
    return scored.groupBy("demand").agg(
        F.when(~F.coalesce(F.bool_or(failed), F.lit(False)), F.min_by("id", ranked)).alias("_best"),
        F.coalesce(F.bool_or(failed), F.lit(False)).alias("_failed"),
        F.min_by("id", F.struct("workload", "tier", "id")).alias("_fallback"),
        (F.sum("members") if "members" in pairs.columns else F.count(F.lit(1))).alias("pool_size"),
    )


def _pool_id() -> Column:
    return F.md5("demand")


def candidate_pools(tickets: DataFrame, technicians: DataFrame | Directory) -> tuple[DataFrame, DataFrame]:
    """Who may take which ticket, as compressed sets: ``pool_id, bucket, members`` and ``number, id`` of the technicians.

    Technicians are numbered in the order of their ids; a pool is one bitmap of ``members`` for each 32,768 numbers
    (``bucket``) that holds any, built with map-side partials. Tickets of one demand share a pool (``assign`` with
    ``pool=True`` tells its ``pool_id``), so nobody is listed per ticket. ``pool_members`` turns pools into rows.
    """
    people = technicians if isinstance(technicians, Directory) else directory(technicians)
    ids = people.postings.select("id").distinct()
    numbers = materialize(positions(ids, [], ["id"]).select((F.col("pos") + 1).alias("number"), "id"), "numbers")
    pairs = attach(_fitting(materialize(demands(tickets), "demands"), people).select("demand", "id"), numbers, ["id"], how="inner", stored=True)
    pools = pairs.groupBy(_pool_id().alias("pool_id"), F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("members")
    )
    return materialize(pools, "pools"), numbers


def pool_members(pools: DataFrame, numbers: DataFrame) -> DataFrame:
    """``pool_id, id`` of the given pools: technicians meet the bitmap of their numbers' bucket."""
    numbered = numbers.select("id", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("_bit"))
    byte = F.conv(F.hex(F.substr("members", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return pools.join(numbered, "bucket").filter(F.getbit(byte, F.col("_bit").cast("int") % 8) == 1).select("pool_id", "id")


def by_pool(decided: DataFrame, tasks: int | None = None) -> DataFrame:
    """Tickets of one pool side by side, a few pools to a task, before whole pools are written out per ticket.

    A file then repeats few texts, which its dictionary holds once each if it takes them (see ``room_for_texts``); in any
    other order it would hold the text of every ticket. A pool with most of the tickets is dealt over many tasks.
    """
    stored = materialize(decided, "decided")
    if tasks is None:
        pools = stored.agg(F.approx_count_distinct("pool_id")).first()[0]
        tasks = max(stored.sparkSession.sparkContext.defaultParallelism, min(POOL_TASKS, 2 * pools))
    return stored.repartitionByRange(tasks, "pool_id", "ticket_id")


def room_for_texts(texts: DataFrame, column: str) -> None:
    """Let the dictionaries of Parquet files hold ``texts``, up to ``MOST_DICTIONARY_BYTES`` of them.

    Parquet gives up the dictionary of a file at 1 MB, which the text of one large pool passes; every row of it would then
    hold its text again. What a query returns is written later, so the session keeps the setting, which is only ever
    raised; it tells how files are encoded, not what they hold. A file takes the memory of the texts it has.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length(column) + 4)).first()[0] or 0
    now = spark.conf.get(DICTIONARY_SIZE, None) or spark._jsc.hadoopConfiguration().get(DICTIONARY_SIZE) or DICTIONARY_BYTES
    if size > int(now):
        spark.conf.set(DICTIONARY_SIZE, str(max(int(now), min(size, MOST_DICTIONARY_BYTES))))


def needs_classes(score: Column | None = None, scorer: Callable | None = None, **_) -> bool:
    """Whether ``assign`` with these options meets classes of technicians: only the built-in ranking looks at nobody by name."""
    return score is None and scorer is None


def assign(
    tickets: DataFrame,
    technicians: DataFrame | Directory,
    score: Column | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    pool: bool = False,
) -> DataFrame:
    """One decision per ticket: ``technician_id, strategy, pool_size`` (and ``pool_id`` on request, see ``candidate_pools``).

    The built-in ranking works on classes of equal technicians. A ranker of one's own is either a column over
    ticket and technician fields or a function that adds a ``score`` column to the candidate pairs (e.g. with a
    pandas UDF), and ``ranker_failed`` if failing is to be told from ranking nobody. A ``Directory`` serves many calls;
    it must hold classes for the built-in ranking and technicians for the others (see ``needs_classes``).
    """
    wanted = materialize(demands(tickets), "demands")
    people = technicians if isinstance(technicians, Directory) else directory(technicians, needs_classes(score, scorer))
    pairs = _fitting(wanted, people)
    if scorer is not None:
        pairs, score = scorer(pairs), F.col("score")
    outcome = wanted.select("demand").join(decide(pairs, score), "demand", "left")
    decided = outcome.select(
        "demand",
        F.coalesce("_best", "_fallback").alias("technician_id"),
        F.when(F.col("pool_size").isNull(), HARD_STOP).when(F.col("_best").isNotNull(), RANKED).otherwise(FALLBACK).alias("strategy"),
        F.coalesce("pool_size", F.lit(0)).alias("pool_size"),
        *([F.when(F.col("pool_size") > 0, _pool_id()).alias("pool_id")] if pool else []),
        F.when(F.col("pool_size").isNull(), F.array(F.lit("availability-region-or-project")))
        .when(F.col("_failed"), F.array(F.lit("lowest-load-and-tier"), F.lit(RANKER_FAILED)))
        .when(F.col("_best").isNull(), F.array(F.lit("lowest-load-and-tier")))
        .otherwise(F.array().cast("array<string>"))
        .alias("notes"),
    )
    keyed = tickets.withColumn("demand", _demand_key())
    return attach(keyed, decided, ["demand"]).drop("demand")


def assignment_metrics(decisions: DataFrame) -> DataFrame:
    """Counters of one run: rankers that failed, and all fallbacks (failed or nobody ranked)."""
    return decisions.agg(
        F.count(F.lit(1)).alias("enqueued"),
        F.count("strategy").alias("processed"),
        F.count_if(F.array_contains("notes", RANKER_FAILED)).alias("ml_failures"),
        F.count_if(F.col("strategy") == FALLBACK).alias("fallback_decisions"),
        F.count_if(F.col("strategy") == HARD_STOP).alias("hard_stops"),
    )


def build_tickets(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Assignment tickets from created tickets and their import job: skills and priority by mode.

    ``rows(ticket_id, job_id, region, identity_document)``, ``jobs(job_id, project_id, mode)``.
    """
    mass = F.col("mode") == "MASS_CREATE"
    return attach(rows, jobs.select("job_id", "project_id", "mode"), ["job_id"], how="inner").select(
        "ticket_id",
        "job_id",
        "project_id",
        "region",
        F.array(F.when(mass, "batch-handling").otherwise("post-service")).alias("required_skills"),
        F.when(F.col("mode") == "POST_SERVICE", "P1").otherwise("P2").alias("priority"),
        normalize_document_id(F.col("identity_document")).alias("identity_document"),
    )


def match_identity(rows: DataFrame, technicians: DataFrame) -> DataFrame:
    """Technician of each row by identity document, compared without blanks, dots and dashes."""
    known = technicians.groupBy(normalize_document_id(F.col("document")).alias("_doc")).agg(F.min("id").alias("technician_id"))
    matched = attach(rows.withColumn("_doc", normalize_document_id(F.col("identity_document"))), known, ["_doc"])
    return matched.drop("_doc").withColumn(
        "policy", F.when(F.col("technician_id").isNotNull(), "AUTO_ASSIGN").otherwise("REVIEW")
    ).withColumn("confidence", F.when(F.col("technician_id").isNotNull(), F.lit(MATCH_CONFIDENCE)))


def history_rank(pairs: DataFrame, history: DataFrame, kind: str, weight: float = 0.5, top: int | None = None) -> DataFrame:
    """Add ``score``: the ranking score plus the share of past tickets of this kind per technician.

    ``history(technician_id, <kind>)`` lists past assignments. With ``top`` only the best of each demand stay, with their
    ``place``; shares are joined before, so that no other pair is shuffled by demand.
    """
    counts = history.groupBy(F.col("technician_id").alias("id"), kind).agg(F.count(F.lit(1)).alias("_n"))
    totals = history.groupBy(kind).agg(F.count(F.lit(1)).alias("_all"))
    shares = counts.join(totals, kind).select("id", kind, (F.col("_n") / F.col("_all")).alias("_share"))
    joined = attach(pairs, shares, ["id", kind])
    scored = joined.withColumn("score", ranking_score() + weight * F.coalesce("_share", F.lit(0.0))).drop("_share")
    return scored if top is None else rank_candidates(scored, F.col("score"), top)
