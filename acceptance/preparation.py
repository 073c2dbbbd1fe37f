"""Table preparation, evaluation, streams and the preview and run plans."""

from pyspark.sql import functions as F

from acceptance.assignment import ASSIGN_SQL, technicians, tickets
from acceptance.base import CLEANED_SQL, PARSED_SQL, cleaned_sql, corpus, query, table
from acceptance.fixed import TEMPLATES
from acceptance.rules import _J, jobs
from acceptance.semantics import BEST_SQL, POS_SQL, classified_sql
from tabprep.operators import clean as cl
from tabprep.operators import evaluate as ev
from tabprep.operators import forests as fr
from tabprep.operators import profile as pf
from tabprep.operators import structure as st
from tabprep.operators import tables as tl
from tabprep.operators.scale import equal_share_bucket
from tabprep.session import FREE_SHUFFLES, materialize, scratch_path, settings
from tabprep.sources.tables import as_sheet, union_sheets
from tabprep.streaming import streams as sm


def _merged(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "'events' as sheet_id", "event_id as row_idx", "0 as col_idx", "nullif(event_type, 'error') as value", "value < 40 as merged"
    )


@query(
    "merged_cell_fill",
    """SELECT event_id AS row_idx, coalesce(nullif(event_type, 'error'), CASE WHEN value < 40 THEN last_value(nullif(event_type, 'error') IGNORE NULLS) OVER (ORDER BY event_id) END) AS value FROM events""",
)
def merged_cell_fill(spark, sf):
    return tl.fill_merged(_merged(spark, sf)).select("row_idx", "value")


@query(
    "merged_cell_fill_across",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS v, length(text) < 500 AS m FROM conversations)
    SELECT conv_id AS row_idx, turn AS col_idx, coalesce(v, CASE WHEN m THEN last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) END) AS value FROM c""",
)
def merged_cell_fill_across(spark, sf):
    cells = table(spark, sf, "conversations").selectExpr(
        "'conv' as sheet_id", "conv_id as row_idx", "turn as col_idx", "case when role = 'user' then text end as value", "length(text) < 500 as merged"
    )
    return tl.fill_merged(cells, axis="columns").select("row_idx", "col_idx", "value")


@query(
    "flattened_hierarchy",
    """WITH r AS (SELECT event_id, CASE WHEN value > 150 THEN 'A' || user_id END AS l1, CASE WHEN value BETWEEN 80 AND 150 THEN 'B' || user_id END AS l2, CASE WHEN event_type = 'click' THEN props END AS l3 FROM events),
    s AS (SELECT event_id, last_value(CASE WHEN l1 IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS r1, last_value(l1 IGNORE NULLS) OVER w AS v1,
      last_value(CASE WHEN l2 IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS r2, last_value(l2 IGNORE NULLS) OVER w AS v2,
      last_value(CASE WHEN l3 IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS r3, last_value(l3 IGNORE NULLS) OVER w AS v3 FROM r WINDOW w AS (ORDER BY event_id))
    SELECT event_id AS row_idx, v1 AS level_1, CASE WHEN r2 >= coalesce(r1, -1) THEN v2 END AS level_2, CASE WHEN r3 >= greatest(coalesce(r1, -1), coalesce(r2, -1)) THEN v3 END AS level_3 FROM s""",
)
def flattened_hierarchy(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "'events' as sheet_id", "event_id as row_idx", "case when value > 150 then concat('A', user_id) end as level_1",
        "case when value between 80 and 150 then concat('B', user_id) end as level_2", "case when event_type = 'click' then props end as level_3",
    )
    return tl.flatten_levels(rows, ["level_1", "level_2", "level_3"]).drop("sheet_id")


_CANONICAL = ["name", "nationkey", "acctbal", "mktsegment"]


def _people(spark, sf):
    buyers = table(spark, sf, "customer").selectExpr("c_custkey as k", "c_name as name", "c_nationkey as nationkey", "c_acctbal as acctbal", "c_mktsegment as mktsegment")
    sellers = table(spark, sf, "supplier").selectExpr("s_suppkey as k", "s_acctbal as acctbal", "s_name as name", "s_nationkey as nationkey")
    return union_sheets([as_sheet(buyers, "customer", "k", buyers.columns[1:]), as_sheet(sellers, "supplier", "k", sellers.columns[1:])])


@query(
    "canonical_table",
    """SELECT 'customer' AS sheet_id, c_custkey AS row_idx, c_name AS name, c_nationkey::VARCHAR AS nationkey, c_acctbal::VARCHAR AS acctbal, c_mktsegment AS mktsegment FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey::VARCHAR, s_acctbal::VARCHAR, NULL FROM supplier""",
)
def canonical_table(spark, sf):
    return tl.canonical_rows(_people(spark, sf), _CANONICAL)


@query(
    "header_dictionary",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS header FROM documents) SELECT header, count(DISTINCT doc_id) AS sheets FROM l GROUP BY 1""",
)
def header_dictionary(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("sheet_id"), F.explode(F.split("text", "\n")).alias("header"))
    return tl.header_dictionary(lines)


def _structured(spark, sf):
    from acceptance.layout import _endless

    return tl.structural_features(st.table_rows(_endless(spark, sf)).drop("_places"), F.get("cells", F.lit(2)).isNotNull())


@query(
    "structural_features",
    """WITH r AS (SELECT event_id AS row_idx, 2 + (event_type IN ('click', 'view') AND value > 20)::INT + (event_type = 'signup')::INT AS filled, event_type IN ('click', 'view') AND value > 20 AS sub
      FROM events WHERE event_type <> 'error'), p AS (SELECT *, lag(row_idx) OVER (ORDER BY row_idx) AS prev FROM r)
    SELECT row_idx, round(row_idx / max(row_idx) OVER (), 6) AS row_rel, row_idx - last_value(CASE WHEN prev IS NULL OR prev < row_idx - 1 THEN row_idx END IGNORE NULLS) OVER (ORDER BY row_idx) AS dist_to_header,
      row_idx - last_value(CASE WHEN sub THEN row_idx END IGNORE NULLS) OVER (ORDER BY row_idx) AS dist_to_subtotal, filled / 4 AS filled_share FROM p""",
)
def structural_features(spark, sf):
    return _structured(spark, sf).select("row_idx", F.round("row_rel", 6).alias("row_rel"), "dist_to_header", "dist_to_subtotal", "filled_share")


@query(
    "row_type_classification",
    f"""WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' ELSE 'other' END AS kind, ('0x' || substr(md5(event_id || ':0'), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE < 0.8 AS train FROM events WHERE event_type <> 'error')
    SELECT kind AS class, count(*) AS support, TRUE AS beats_majority FROM r WHERE NOT train GROUP BY 1""",
)
def row_type_classification(spark, sf):
    """The label is the kind of event, which is not among the features; the filled share tells it only in part."""
    kinds = table(spark, sf, "events").select(F.col("event_id").alias("row_idx"), F.expr("case event_type when 'click' then 'click' when 'view' then 'view' else 'other' end").alias("kind"))
    rows = ev.split(_structured(spark, sf).join(kinds, "row_idx"), "row_idx")
    features = ["row_rel", "dist_to_header", "dist_to_subtotal", "filled_share"]
    scored = materialize(fr.classify_rows(rows.filter("part = 'train'"), rows.filter("part = 'test'"), features, "kind"), "scored")
    right, rows = scored.agg(F.avg((F.col("kind") == F.col("predicted")).cast("double")), F.count(F.lit(1))).first()
    most = scored.groupBy("kind").count().agg(F.max("count")).first()[0] / rows
    return ev.class_scores(scored, "kind", "predicted").select("class", "support", F.lit(right >= most).alias("beats_majority"))


_NET = "l_quantity * (1 - l_discount) * 100"
_MASKED = f"CASE WHEN l_tax < 0.07 THEN {_NET} END"


@query(
    "forest_imputation",
    f"""SELECT l_quantity, count(*) AS n, count({_MASKED}) AS observed, round(sum({_MASKED}), 2) AS observed_sum, 0 AS still_missing, TRUE AS beats_mean FROM lineitem GROUP BY 1""",
)
def forest_imputation(spark, sf):
    """Observed prices stay, missing ones are filled, and the hidden true prices are met better than by the mean."""
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_quantity", "l_discount", "cast(l_partkey as double) as part", f"cast({_NET} as double) as truth", f"cast({_MASKED} as double) as price",
        "l_tax < 0.07 as seen",
    )
    mean = lines.agg(F.avg("price")).first()[0]
    filled = materialize(fr.impute_forest(lines, "price", ["l_quantity", "l_discount", "part"]), "filled")
    error = lambda guess: F.sum(F.pow(guess - F.col("truth"), 2))
    better = filled.filter("not seen").agg(error(F.col("price")) < error(F.lit(mean))).first()[0]
    known = F.when(F.col("seen"), F.col("price"))
    counted = filled.groupBy("l_quantity").agg(
        F.count(F.lit(1)).alias("n"), F.count(known).alias("observed"), F.round(F.sum(known), 2).alias("observed_sum"),
        F.count_if(F.col("price").isNull()).cast("int").alias("still_missing"),
    )
    return counted.withColumn("beats_mean", F.lit(better))


_UNIT = "(('0x' || substr(md5({k} || ':{s}'), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE)"


@query("stable_split", f"SELECT o_orderkey, CASE WHEN {_UNIT.format(k='o_orderkey', s=11)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM orders")
def stable_split(spark, sf):
    return ev.split(table(spark, sf, "orders"), "o_orderkey", seed=11).select("o_orderkey", "part")


@query(
    "class_weights",
    "WITH c AS (SELECT c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1) SELECT c_custkey, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6)::DOUBLE AS weight FROM customer JOIN c ON g = c_mktsegment",
)
def class_weights(spark, sf):
    return ev.class_weights(table(spark, sf, "customer"), "c_mktsegment").select("c_custkey", F.round("weight", 6).alias("weight"))


@query(
    "oversampled_classes",
    "WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT doc_id, toxic, unnest(range(1, greatest((SELECT max(n) FROM c) // n, 1) + 1))::INTEGER AS copy FROM labels JOIN c USING (toxic)",
)
def oversampled_classes(spark, sf):
    return ev.oversample(table(spark, sf, "labels"), "toxic").select("doc_id", "toxic", "copy")


@query(
    "masked_imputation",
    f"""WITH m AS (SELECT o_orderpriority AS g, o_totalprice AS x, {_UNIT.format(k='o_orderkey', s=0)} < 0.1 AS h FROM orders), a AS (SELECT g, avg(x) FILTER (NOT h) AS guess FROM m GROUP BY 1)
    SELECT g AS o_orderpriority, count(*) AS hidden, round(avg(abs(x - guess)), 3) AS mae, round(sqrt(avg((x - guess) * (x - guess))), 3) AS rmse FROM m JOIN a USING (g) WHERE h GROUP BY 1""",
)
def masked_imputation(spark, sf):
    scores = ev.masked_imputation_error(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice")
    return scores.withColumn("mae", F.round("mae", 3)).withColumn("rmse", F.round("rmse", 3))


_GUESS = "WITH g AS (SELECT quality AS label, (n_chars > 1500)::INT AS predicted FROM documents JOIN labels USING (doc_id))"


def _guesses(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("predicted"))
    return docs.join(table(spark, sf, "labels"), "doc_id").withColumnRenamed("quality", "label")


@query("confusion_matrix", _GUESS + " SELECT label, predicted, count(*) AS n FROM g GROUP BY ALL")
def confusion_matrix(spark, sf):
    return ev.confusion(_guesses(spark, sf), "label", "predicted")


@query(
    "class_scores",
    _GUESS + """, k AS (SELECT c, count(*) FILTER (label = c AND predicted = c) AS tp, count(*) FILTER (label = c) AS support, count(*) FILTER (predicted = c) AS said FROM g, (VALUES (0), (1)) v(c) GROUP BY 1)
    SELECT c::VARCHAR AS class, support, round(tp / said, 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (said + support), 6) AS f1 FROM k""",
)
def class_scores(spark, sf):
    scores = ev.class_scores(_guesses(spark, sf), "label", "predicted")
    return scores.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "bootstrap_interval",
    """WITH d AS (SELECT r, o_totalprice AS x, ('0x' || substr(md5(o_orderkey || ':' || r || ':0'), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE AS u FROM orders, range(1, 201) t(r)),
    w AS (SELECT r, x, (u >= 0.36787944)::INT + (u >= 0.73575888)::INT + (u >= 0.91969860)::INT + (u >= 0.98101184)::INT + (u >= 0.99634015)::INT + (u >= 0.99940582)::INT
      + (u >= 0.99991676)::INT + (u >= 0.99998975)::INT AS k FROM d), m AS (SELECT r, sum(k * x) / sum(k) AS m FROM w GROUP BY r)
    SELECT round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""",
)
def bootstrap_interval(spark, sf):
    found = ev.bootstrap_mean(table(spark, sf, "orders"), "o_orderkey", "o_totalprice")
    return found.select(*[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


_HALVES = "unpivoted AS (SELECT 'value' AS metric, value AS v, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'a' ELSE 'b' END AS s FROM events UNION ALL SELECT 'user', user_id, CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END FROM events)"


@query(
    "distribution_drift",
    f"""WITH {_HALVES}, c AS (SELECT metric, v, count(*) FILTER (s = 'a') AS a, count(*) FILTER (s = 'b') AS b FROM unpivoted GROUP BY 1, 2),
    r AS (SELECT metric, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY metric) AS na, sum(b) OVER (PARTITION BY metric) AS nb FROM c WINDOW w AS (PARTITION BY metric ORDER BY v))
    SELECT metric, round(max(abs(ca / na - cb / nb)), 6) AS distance, max(na)::BIGINT AS size_a, max(nb)::BIGINT AS size_b FROM r GROUP BY 1""",
)
def distribution_drift(spark, sf):
    events = table(spark, sf, "events")
    halves = events.selectExpr("'value' as metric", "value as v", "case when ts < timestamp_ntz '2024-01-16 00:00:00' then 'a' else 'b' end as s").unionByName(
        events.selectExpr("'user' as metric", "cast(user_id as double) as v", "case when event_type in ('click', 'view') then 'a' else 'b' end as s")
    )
    return ev.ks_distance(halves, "metric", "v", "s").withColumn("distance", F.round("distance", 6))


@query(
    "online_quality",
    """SELECT CAST(ts AS DATE) AS day, round(avg((event_type = 'error')::INT), 6) AS undetermined_rate, round(avg((value > 60)::INT), 6) AS value_rate, count(*) AS n,
    concat_ws(',', CASE WHEN avg((event_type = 'error')::INT) > 0.2 THEN 'undetermined' END, CASE WHEN avg((value > 60)::INT) > 0.3 THEN 'value' END) AS alerts FROM events GROUP BY 1""",
)
def online_quality(spark, sf):
    rows = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    rated = ev.online_quality(rows, ["day"], F.col("event_type") == "error", {"value": F.col("value") > 60}, {"undetermined": 0.2, "value": 0.3})
    return rated.select(
        "day", F.round("undetermined_rate", 6).alias("undetermined_rate"), F.round("value_rate", 6).alias("value_rate"), "n", F.array_join("alerts", ",").alias("alerts")
    )


_MONEY = """case when o_orderstatus = 'F' then concat('US$ ', o_totalprice) when o_orderpriority = '1-URGENT' then concat(o_totalprice, ' €') when o_totalprice > 300000 then replace(cast(o_totalprice as {s}), '.', ',') else cast(o_totalprice as {s}) end"""
_DAY = "concat(day(o_orderdate), '/', month(o_orderdate), '/', year(o_orderdate))"


def _messy(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_MONEY.format(s="string")).alias("amount"), F.expr(_DAY).alias("day"))
    return as_sheet(rows, "orders", "o_orderkey", ["amount", "day"])


@query(
    "mixed_formats",
    f"""WITH v AS (SELECT 0 AS col_idx, {_MONEY.format(s='varchar')} AS v FROM orders UNION ALL SELECT 1, {_DAY} FROM orders),
    f AS (SELECT col_idx, CASE WHEN regexp_matches(v, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN 'date-text' WHEN v LIKE 'US$%' THEN 'money:USD' WHEN v LIKE '%€' THEN 'money:EUR' WHEN contains(v, ',') THEN 'decimal-comma' ELSE 'number' END AS format FROM v)
    SELECT col_idx, format, round(count(*) / sum(count(*)) OVER (PARTITION BY col_idx), 6) AS share, col_idx = 0 AS mixed FROM f GROUP BY 1, 2""",
)
def mixed_formats(spark, sf):
    found = tl.mixed_formats(pf.value_histogram(_messy(spark, sf)))
    return found.select("col_idx", "format", F.round("share", 6).alias("share"), "mixed")


@query(
    "decimal_comma_normalization",
    f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' THEN CAST(o_totalprice AS VARCHAR) ELSE {_MONEY.format(s='varchar')} END AS amount FROM orders",
)
def decimal_comma_normalization(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(_MONEY.format(s="string")).alias("a")).select(
        "o_orderkey", tl.normalize_decimal_comma(F.col("a")).alias("amount")
    )


# --- streams --------------------------------------------------------------------------------------------
def _as_stream(df, batches: int, order: str):
    """The whole table written in order and read back as a stream of ``batches`` batches.

    Every core writes and reads a file of each batch, however large the table; rows of one place are dealt over files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "arrivals")
    files = spark.sparkContext.defaultParallelism
    with settings(spark, FREE_SHUFFLES):
        df.repartitionByRange(batches * files, F.col(order), F.xxhash64(*df.columns)).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _in_time_order(df, ts: str, parts: int):
    """As ``_as_stream``, but written one part after the other, so that no row arrives late."""
    spark = df.sparkSession
    path = scratch_path(spark, "arrivals")
    sliced = equal_share_bucket(df, ts, parts)
    for part in range(parts):
        sliced.filter(F.col("_bucket") == part).drop("_bucket").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _finish(query_handle):
    try:
        query_handle.awaitTermination()
    finally:
        query_handle.stop()


_DECISIONS = f"""WITH {ASSIGN_SQL}, dec AS (SELECT project_id, region, required_skills, priority, kind, arg_min(id, struct_pack(a := -score, b := load, c := id)) AS best FROM ranked GROUP BY ALL)
    SELECT ticket_id, best AS technician_id, CASE WHEN best IS NULL THEN 'hard-stop' ELSE 'ml-ranking' END AS strategy FROM tickets t LEFT JOIN dec d ON t.project_id = d.project_id
      AND t.region IS NOT DISTINCT FROM d.region AND t.required_skills = d.required_skills AND t.priority = d.priority AND t.kind = d.kind"""


@query("streamed_assignment", _DECISIONS)
def streamed_assignment(spark, sf):
    out = scratch_path(spark, "decisions")
    _finish(sm.assign_stream(_as_stream(tickets(spark, sf), 3, "ticket_id"), technicians(spark, sf), out))
    return spark.read.parquet(out).select("ticket_id", "technician_id", "strategy")


@query(
    "streamed_assignment_metrics",
    f"WITH d AS ({_DECISIONS}) SELECT count(*) AS enqueued, count(*) AS processed, count(*) FILTER (strategy = 'hard-stop') AS hard_stops FROM d",
)
def streamed_assignment_metrics(spark, sf):
    out, metrics = scratch_path(spark, "decisions"), scratch_path(spark, "metrics")
    _finish(sm.assign_stream(_as_stream(tickets(spark, sf), 3, "ticket_id"), technicians(spark, sf), out, metrics))
    return spark.read.parquet(metrics).agg(*[F.sum(c).alias(c) for c in ("enqueued", "processed", "hard_stops")])


@query(
    "streamed_ticket_creation",
    "SELECT l_returnflag AS job_id, min(l_orderkey) AS l_orderkey, count(DISTINCT sha256(concat_ws(chr(31), 'v' || l_orderkey, 'v' || l_linenumber))) AS tickets FROM lineitem GROUP BY 1",
)
def streamed_ticket_creation(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_returnflag as job_id", "l_orderkey as row_idx", "l_orderkey", "l_linenumber", "l_suppkey")
    out = scratch_path(spark, "tickets")
    _finish(sm.ticket_stream(_as_stream(rows, 3, "l_suppkey").drop("l_suppkey"), ["l_orderkey", "l_linenumber"], out))
    made = spark.read.parquet(out)
    return made.groupBy("job_id").agg(F.min("row_idx").alias("l_orderkey"), F.countDistinct("ticket_id").alias("tickets"))


@query(
    "streamed_job_state",
    """SELECT user_id AS job_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) FILTER (event_type <> 'error') AS status,
    arg_max(props, struct_pack(a := ts, b := event_id)) FILTER (event_type = 'error') AS errors_ref, min(ts) AS first_update, max(ts) AS updated_at FROM events GROUP BY 1""",
)
def streamed_job_state(spark, sf):
    log = table(spark, sf, "events").selectExpr(
        "user_id as job_id", "ts", "event_id as seq", "nullif(event_type, 'error') as status", "case when event_type = 'error' then props end as errors_ref"
    )
    out = scratch_path(spark, "states")
    _finish(sm.job_state_stream(_as_stream(log, 3, "seq"), ["status", "errors_ref"], ["ts", "seq"], out))
    return sm.latest_states(spark, out)


@query(
    "streamed_quality",
    """WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, value FROM events)
    SELECT window_start, event_type, count(*) AS n, round(avg(value), 9) AS mean FROM w GROUP BY 1, 2
    HAVING window_start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def streamed_quality(spark, sf):
    readings = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = scratch_path(spark, "windows")
    _finish(sm.append_stream(sm.quality_stream(_in_time_order(readings, "ts", 3), "ts", ["event_type"], "6 hours", "1 hour"), out))
    found = spark.read.parquet(out)
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean", 9).alias("mean"))


# --- plans ------------------------------------------------------------------------------------------------
_TEMPLATE_ROWS = ", ".join(f"({i}, '{t}', {b}::DOUBLE)" for i, (t, _, b) in enumerate(TEMPLATES))
_PREVIEW_SQL = f"""{cleaned_sql()}, catalogue AS (SELECT sheet_id, col_idx, header FROM kept), {classified_sql('catalogue')}, {BEST_SQL}, {POS_SQL},
  geo AS (SELECT sheet_id, address_column IS NOT NULL AND NOT missing_required AS geo_ok FROM best JOIN pos USING (sheet_id, pos_column) UNION ALL
    SELECT b.sheet_id, false FROM best b WHERE pos_column IS NULL),
  shape AS (SELECT sheet_id, count(*) AS columns, count(DISTINCT header) AS anchors FROM catalogue GROUP BY 1),
  rate AS (SELECT *, round(least(0.95, greatest(0.35, 0.12 + least(anchors, 3) * 0.08 + CASE WHEN columns >= 8 THEN 0.2 WHEN columns >= 4 THEN 0.1 ELSE 0.04 END)), 2)::DOUBLE AS sure FROM shape),
  sig AS (SELECT sheet_id, CASE WHEN sure < 0.5 OR columns < 3 THEN 'MNAR' WHEN sure > 0.72 THEN 'MAR' ELSE 'MCAR' END AS signal FROM rate),
  summ AS (SELECT sheet_id, avg(confidence) AS conf, count(*) FILTER (type IN ('date', 'number', 'text')) AS keys, count(DISTINCT type) AS types FROM classified GROUP BY 1),
  tmpl(ord, tid, base) AS (VALUES {_TEMPLATE_ROWS}),
  sug AS (SELECT sheet_id, tid, round(least(0.99, base + CASE WHEN keys >= 2 AND conf > 0.62 THEN 0.06 ELSE 0 END + CASE WHEN types >= 4 THEN 0.03 ELSE 0 END
    - CASE WHEN conf < 0.45 THEN 0.08 ELSE 0 END), 3) AS score, ord FROM summ, tmpl),
  placed AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, ord) AS k FROM sug),
  dec AS (SELECT sheet_id, arg_min(tid, k) AS top_template, arg_min(score, k)::DOUBLE AS top_score, bool_and(score < 0.7) AS propose_new FROM placed GROUP BY 1)
  SELECT sheet_id, pos_column, geo_ok, signal, top_template, top_score, propose_new FROM pos JOIN geo USING (sheet_id) JOIN sig USING (sheet_id) JOIN dec USING (sheet_id)"""


@query("sheet_preview", _PREVIEW_SQL)
def sheet_preview(spark, sf):
    from tabprep.plans.preview import preview

    shown = preview(corpus(spark, sf))
    return shown.insights.select("sheet_id", "pos_column", "geo_ok", "signal", "top_template", "top_score", "propose_new")


_RUN_ROWS = "l_orderkey AS job_id, l_partkey * 10 + l_linenumber AS row_idx, l_partkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN 'ERROR' ELSE 'OK' END AS status"


@query(
    "import_run",
    f"""WITH {_J}, ok AS (SELECT job_id FROM j WHERE version IS NOT NULL AND NOT (mode = 'MASS_CREATE' AND insights AND signal = 'MNAR') AND insights AND has_pos AND NOT pos_required AND NOT (has_geo AND NOT geo_ok)),
    r AS (SELECT {_RUN_ROWS} FROM lineitem), t AS (SELECT job_id, count(DISTINCT (l_partkey, l_linenumber)) AS tickets FROM r WHERE status <> 'ERROR' AND job_id::VARCHAR IN (SELECT job_id FROM ok) GROUP BY 1)
    SELECT j.job_id, CASE WHEN ok.job_id IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status, coalesce(tickets, 0) AS tickets FROM j LEFT JOIN ok USING (job_id) LEFT JOIN t ON t.job_id::VARCHAR = j.job_id""",
)
def import_run(spark, sf):
    done = _import(spark, sf)[0]
    made = done.decisions.groupBy("job_id").agg(F.count(F.lit(1)).alias("tickets"))
    return done.jobs.join(made, "job_id", "left").select("job_id", "status", F.coalesce("tickets", F.lit(0)).alias("tickets"))


def _import(spark, sf):
    from tabprep.plans.run import run

    rows = table(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey as string) as job_id", "l_partkey * 10 + l_linenumber as row_idx", "l_partkey", "l_linenumber",
        "case when l_discount > 0.08 then 'ERROR' else 'OK' end as status", "cast(null as string) as region", "cast(l_suppkey as string) as identity_document",
    )
    return run(jobs(spark, sf).withColumn("project_id", F.lit("project-O")), rows, ["l_partkey", "l_linenumber"], technicians(spark, sf)), rows


@query(
    "import_trace",
    f"""WITH {_J}, ok AS (SELECT job_id FROM j WHERE version IS NOT NULL AND NOT (mode = 'MASS_CREATE' AND insights AND signal = 'MNAR') AND insights AND has_pos AND NOT pos_required AND NOT (has_geo AND NOT geo_ok)),
    r AS (SELECT {_RUN_ROWS} FROM lineitem)
    SELECT job_id::VARCHAR AS job_id, row_idx, CASE WHEN status = 'ERROR' THEN 'skipped' WHEN job_id::VARCHAR IN (SELECT job_id FROM ok) THEN 'ticket' ELSE 'blocked' END AS outcome,
      status <> 'ERROR' AND job_id::VARCHAR IN (SELECT job_id FROM ok) AS decided FROM r""",
)
def import_trace(spark, sf):
    done, rows = _import(spark, sf)
    return done.trace(rows, ["l_partkey", "l_linenumber"]).select("job_id", "row_idx", "outcome", F.col("strategy").isNotNull().alias("decided"))


_DAILY = "WITH cells AS (" + " UNION ALL ".join(
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS sheet_id, event_id AS row_idx, {i} AS col_idx, '{c}' AS header, CAST({c} AS VARCHAR) AS value FROM events"
    for i, c in enumerate(("event_type", "value", "props"))
) + ")," + CLEANED_SQL + "," + PARSED_SQL


@query(
    "cleaned_profile_by_day",
    _DAILY + """ SELECT sheet_id, header, round(nums / filled, 6) AS numeric_ratio, round(dts / filled, 6) AS date_ratio,
    round(boos / filled, 6) AS boolean_ratio, round(dist / filled, 6) AS unique_ratio FROM counts""",
)
def cleaned_profile_by_day(spark, sf):
    """Many small sheets at once: one per day, profiled in one job."""
    events = table(spark, sf, "events")
    sheets = as_sheet(events, F.to_date("ts").cast("string"), "event_id", ["event_type", "value", "props"])
    cleaned = cl.clean(sheets).sheets
    profiled = pf.profile(cleaned.headers, pf.column_counts(pf.value_marks(cleaned)))
    ratios = [F.round(f"{k}_ratio", 6).alias(f"{k}_ratio") for k in ("numeric", "date", "boolean", "unique")]
    return profiled.select("sheet_id", "header", *ratios)
