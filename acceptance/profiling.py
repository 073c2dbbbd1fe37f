from pyspark.sql import functions as F

from acceptance.base import cleaned_sql, coerced_sql, corpus, query, table
from tabprep.operators import categorical as ct
from tabprep.operators import clean as cl
from tabprep.operators import numeric as nm
from tabprep.operators import profile as pf
from tabprep.operators.scale import attach
from tabprep.operators.quantiles import quantiles
from tabprep.session import materialize
from tabprep.sources.tables import to_cells

r6 = lambda c: F.round(c, 6).alias(c)


def _typed(spark, sf, names=None):
    sheets = cl.clean(corpus(spark, sf, names)).sheets
    histogram = pf.stored_histogram(sheets)
    types = materialize(pf.infer_types(sheets.headers, pf.column_counts(pf.histogram_marks(histogram))), "types")
    return sheets, types, pf.coerce_histogram(histogram, types)


@query(
    "column_profile",
    coerced_sql() + """ SELECT sheet_id, header, round(nums / filled, 6) AS numeric_ratio, round(dts / filled, 6) AS date_ratio,
    round(boos / filled, 6) AS boolean_ratio, round(dist / filled, 6) AS unique_ratio FROM counts""",
)
def column_profile(spark, sf):
    sheets = cl.clean(corpus(spark, sf)).sheets
    profiled = pf.profile(sheets.headers, pf.column_counts(pf.value_marks(sheets)))
    return profiled.select("sheet_id", "header", *[r6(f"{k}_ratio") for k in ("numeric", "date", "boolean", "unique")])


@query(
    "column_pattern_counts_one_pass",
    coerced_sql() + " SELECT sheet_id, col_idx, n_rows AS \"rows\", filled, nums AS numeric, dts AS dates, boos AS booleans"
    " FROM (SELECT *  EXCLUDE (col_idx), row_number() OVER (PARTITION BY sheet_id ORDER BY col_idx) - 1 AS col_idx FROM counts)",
)
def column_pattern_counts_one_pass(spark, sf):
    counts = pf.column_counts_approx(cl.clean(corpus(spark, sf)).sheets)
    return counts.drop("distinct_values").withColumn("col_idx", F.col("col_idx").cast("long"))


@query("column_types", coerced_sql() + " SELECT sheet_id, header, kind, boolean_like FROM typed")
def column_types(spark, sf):
    return _typed(spark, sf)[1].drop("col_idx")


@query(
    "coerced_cells",
    coerced_sql() + " SELECT sheet_id, row_idx, header, round(num, 4) AS number, txt AS text FROM coerced",
)
def coerced_cells(spark, sf):
    sheets, types, _ = _typed(spark, sf)
    cells = attach(pf.coerce(to_cells(sheets), types), sheets.headers, ["sheet_id", "col_idx"], how="inner")
    return cells.select("sheet_id", "row_idx", "header", F.round("number", 4).alias("number"), "text")


_MISSING = coerced_sql() + """, miss AS (SELECT sheet_id, col_idx, header,
  round(count(CASE WHEN num IS NULL AND txt IS NULL THEN 1 END) / count(*), 6) AS missingness FROM coerced GROUP BY ALL)"""


@query("column_missingness", _MISSING + " SELECT sheet_id, header, missingness FROM miss")
def column_missingness(spark, sf):
    sheets, _, typed = _typed(spark, sf)
    return pf.missingness(sheets.headers, typed).select("sheet_id", "header", r6("missingness"))


@query(
    "top_missing_columns",
    _MISSING + """ SELECT sheet_id, header, missingness, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY sheet_id ORDER BY missingness DESC, col_idx) AS rank FROM miss) WHERE rank <= 3""",
)
def top_missing_columns(spark, sf):
    sheets, _, typed = _typed(spark, sf)
    top = pf.top_missing(pf.missingness(sheets.headers, typed), 3)
    return top.select("sheet_id", "header", r6("missingness"), F.col("rank").cast("long").alias("rank"))


_BOUNDS = """, qs AS (SELECT sheet_id, col_idx, header, quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.75) AS q3
    FROM coerced WHERE kind <> 'categorical' GROUP BY ALL),
  bounds AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qs),
  capped AS (SELECT c.*, lo, hi, CASE WHEN num IS NOT NULL THEN least(greatest(num, lo), hi) END AS cap
    FROM coerced c JOIN bounds b USING (sheet_id, col_idx)),
  meds AS (SELECT sheet_id, col_idx, quantile_cont(cap, 0.5) AS med FROM capped GROUP BY ALL),
  filled AS (SELECT c.*, m.med, coalesce(cap, med) AS imp FROM capped c JOIN meds m USING (sheet_id, col_idx)),
  mom AS (SELECT sheet_id, col_idx, avg(imp) AS mean, stddev_pop(imp) AS sd FROM filled GROUP BY ALL)"""


@query(
    "outlier_summary",
    coerced_sql() + _BOUNDS + """ SELECT sheet_id, header, round(lo, 3) AS lower_cap, round(hi, 3) AS upper_cap,
    count(CASE WHEN num < lo OR num > hi THEN 1 END) AS capped_values FROM capped GROUP BY sheet_id, header, lo, hi""",
)
def outlier_summary(spark, sf):
    sheets, types, typed = _typed(spark, sf)
    numbers = materialize(typed.filter("kind <> 'categorical'"), "numbers")
    bounds = materialize(nm.iqr_bounds(numbers, "n"), "bounds")
    found = nm.outlier_summary(numbers, bounds, "n").join(types, ["sheet_id", "col_idx"])
    return found.select(
        "sheet_id", "header", F.round("lower_cap", 3).alias("lower_cap"), F.round("upper_cap", 3).alias("upper_cap"), "capped_values"
    )


@query(
    "profile_summary",
    coerced_sql() + _BOUNDS + """, out AS (SELECT sheet_id, count(CASE WHEN num < lo OR num > hi THEN 1 END) AS total_capped
      FROM capped GROUP BY 1),
    dims AS (SELECT sheet_id, sum(CASE WHEN kind = 'categorical' THEN greatest(d - 1, 0) ELSE 1 END)::BIGINT AS feature_dims,
      any_value(r) AS total_rows FROM (SELECT sheet_id, col_idx, kind, count(DISTINCT txt) AS d, count(*) AS r FROM coerced GROUP BY ALL)
      GROUP BY 1)
    SELECT sheet_id, total_capped, least(total_rows, 25) AS feature_rows, feature_dims FROM dims JOIN out USING (sheet_id)""",
)
def profile_summary(spark, sf):
    from tabprep.plans.prepare import prepare_summary

    return prepare_summary(corpus(spark, sf))


@query(
    "imputed_scaled_numbers",
    coerced_sql() + _BOUNDS + """ SELECT f.sheet_id, f.row_idx, f.header,
    round((imp - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 4) AS value FROM filled f JOIN mom USING (sheet_id, col_idx)""",
)
def imputed_scaled_numbers(spark, sf):
    sheets, types, typed = _typed(spark, sf)
    parameters = nm.numeric_parameters(materialize(typed.filter("kind <> 'categorical'"), "numbers"), "n")
    cells = pf.coerce(to_cells(sheets), types).filter("kind <> 'categorical'")
    ready = attach(nm.prepare_numbers(cells, parameters), sheets.headers, ["sheet_id", "col_idx"], how="inner")
    return ready.select("sheet_id", "row_idx", "header", F.round("value", 4).alias("value"))


def _prices(spark, sf):
    """lineitem prices as numeric cells, one sheet per return flag."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sheet_id"),
        F.col("l_orderkey").alias("row_idx"),
        F.lit(0).alias("col_idx"),
        F.expr("case when l_linestatus = 'O' or l_quantity > 5 then l_extendedprice end").alias("number"),
    )


_PRICES = """WITH p AS (SELECT l_returnflag AS sheet_id, l_orderkey AS row_idx,
  CASE WHEN l_linestatus = 'O' OR l_quantity > 5 THEN l_extendedprice END AS x FROM lineitem)"""


@query(
    "price_quantiles",
    _PRICES + """ SELECT sheet_id, unnest([0.05, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS prob,
    round(unnest(quantile_cont(x, [0.05, 0.25, 0.5, 0.75, 0.99])), 4) AS quantile FROM p GROUP BY sheet_id""",
)
def price_quantiles(spark, sf):
    found = quantiles(_prices(spark, sf), ["sheet_id"], "number", [0.05, 0.25, 0.5, 0.75, 0.99])
    return found.withColumn("quantile", F.round("quantile", 4))


@query(
    "price_capping",
    _PRICES + """, b AS (SELECT sheet_id, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM p GROUP BY 1)
    SELECT sheet_id, row_idx, round(CASE WHEN x IS NOT NULL THEN least(greatest(x, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END, 3)
    AS number FROM p JOIN b USING (sheet_id)""",
)
def price_capping(spark, sf):
    prices = _prices(spark, sf)
    capped = nm.iqr_cap(prices, materialize(nm.iqr_bounds(prices), "bounds"))
    return capped.select("sheet_id", "row_idx", F.round("number", 3).alias("number"))


@query(
    "price_median_imputation",
    _PRICES + """, b AS (SELECT sheet_id, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM p GROUP BY 1),
    c AS (SELECT sheet_id, row_idx, CASE WHEN x IS NOT NULL THEN least(greatest(x, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS y
          FROM p JOIN b USING (sheet_id)), m AS (SELECT sheet_id, quantile_cont(y, 0.5) AS med FROM c GROUP BY 1)
    SELECT sheet_id, row_idx, round(coalesce(y, med), 3) AS number FROM c JOIN m USING (sheet_id)""",
)
def price_median_imputation(spark, sf):
    prices = _prices(spark, sf)
    filled = nm.impute_median(prices, materialize(nm.iqr_bounds(prices), "bounds"))
    return filled.select("sheet_id", "row_idx", F.round("number", 3).alias("number"))


@query(
    "price_minmax",
    _PRICES + """ SELECT sheet_id, row_idx, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS number
    FROM p WINDOW w AS (PARTITION BY sheet_id)""",
)
def price_minmax(spark, sf):
    return nm.minmax(_prices(spark, sf)).select("sheet_id", "row_idx", r6("number"))


@query(
    "price_mean_imputation",
    _PRICES + " SELECT sheet_id, row_idx, round(coalesce(x, avg(x) OVER (PARTITION BY sheet_id)), 3) AS number FROM p",
)
def price_mean_imputation(spark, sf):
    return nm.impute_mean(_prices(spark, sf)).select("sheet_id", "row_idx", F.round("number", 3).alias("number"))


_MODE = """, hist AS (SELECT sheet_id, col_idx, header, txt, count(*) AS c FROM coerced WHERE kind = 'categorical' AND txt IS NOT NULL GROUP BY ALL),
  modes AS (SELECT sheet_id, col_idx, header, txt AS "mode" FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, col_idx
    ORDER BY c DESC, txt) AS k FROM hist) WHERE k = 1)"""


@query("column_modes", coerced_sql() + _MODE + ' SELECT sheet_id, header, "mode" FROM modes')
def column_modes(spark, sf):
    _, types, typed = _typed(spark, sf)
    return ct.modes(typed).join(types, ["sheet_id", "col_idx"]).select("sheet_id", "header", "mode")


@query(
    "mode_imputation",
    coerced_sql() + _MODE + """ SELECT c.sheet_id, c.row_idx, c.header, coalesce(txt, "mode") AS text FROM coerced c
    JOIN modes m USING (sheet_id, col_idx) WHERE kind = 'categorical'""",
)
def mode_imputation(spark, sf):
    sheets, types, typed = _typed(spark, sf)
    cells = pf.coerce(to_cells(sheets), types).filter("kind = 'categorical'")
    filled = attach(ct.impute_mode(cells, ct.modes(typed)), sheets.headers, ["sheet_id", "col_idx"], how="inner")
    return filled.select("sheet_id", "row_idx", "header", "text")


_VOCAB = _MODE + """, vocab AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, col_idx ORDER BY txt) - 1 AS pos FROM hist)"""


@query("category_vocabulary", coerced_sql() + _VOCAB + " SELECT sheet_id, header, txt AS category, pos FROM vocab")
def category_vocabulary(spark, sf):
    _, types, typed = _typed(spark, sf)
    vocab = ct.vocabulary(typed.filter("kind = 'categorical'"))
    return vocab.join(types, ["sheet_id", "col_idx"]).select("sheet_id", "header", "category", "pos")


@query(
    "one_hot_segments",
    """SELECT c_custkey, CAST(c_mktsegment = s AS INT)::DOUBLE AS hit, s AS segment FROM customer,
    (SELECT DISTINCT c_mktsegment AS s FROM customer) WHERE s > (SELECT min(c_mktsegment) FROM customer) AND c_mktsegment = s""",
)
def one_hot_segments(spark, sf):
    cells = table(spark, sf, "customer").select(
        F.lit("customer").alias("sheet_id"), F.lit(0).alias("col_idx"), F.col("c_custkey").alias("row_idx"),
        F.col("c_mktsegment").alias("text"), F.lit(1).alias("n"),
    )
    hot = ct.one_hot(cells.drop("n"), ct.vocabulary(cells))
    return hot.select(F.col("row_idx").alias("c_custkey"), F.col("text").alias("segment"), F.lit(1.0).alias("hit"))


_NAMES = _VOCAB + """, sizes AS (SELECT t.sheet_id, t.col_idx, t.header, kind, CASE WHEN kind = 'categorical' THEN
    coalesce((SELECT max(pos) FROM vocab v WHERE v.sheet_id = t.sheet_id AND v.col_idx = t.col_idx), 0) ELSE 1 END AS width FROM typed t),
  starts AS (SELECT *, sum(width) OVER (PARTITION BY sheet_id ORDER BY kind = 'categorical', col_idx) - width AS start FROM sizes),
  names AS (SELECT sheet_id, col_idx, NULL AS txt, start::BIGINT AS feature_idx, 'numeric__' || header AS name FROM starts WHERE kind <> 'categorical'
    UNION ALL SELECT v.sheet_id, v.col_idx, v.txt, (start + pos - 1)::BIGINT, 'categorical__' || v.header || '_' || CASE WHEN length(v.txt) > 64 THEN 'md5:' || md5(v.txt) ELSE v.txt END FROM vocab v
    JOIN starts USING (sheet_id, col_idx) WHERE pos > 0)"""


@query("feature_names", coerced_sql() + _NAMES + " SELECT sheet_id, feature_idx, name FROM names")
def feature_names(spark, sf):
    _, types, typed = _typed(spark, sf)
    vocab = materialize(ct.vocabulary(typed.filter("kind = 'categorical'")), "vocab")
    return ct.feature_names(types, vocab).select("sheet_id", "feature_idx", "name")


_MATRIX = _BOUNDS + _NAMES + """, matrix AS (SELECT f.sheet_id, f.row_idx, feature_idx,
    (imp - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS value FROM filled f JOIN mom USING (sheet_id, col_idx)
    JOIN names n ON n.sheet_id = f.sheet_id AND n.col_idx = f.col_idx
  UNION ALL SELECT c.sheet_id, c.row_idx, n.feature_idx, 1.0 FROM coerced c JOIN modes m USING (sheet_id, col_idx) JOIN names n
    ON n.sheet_id = c.sheet_id AND n.col_idx = c.col_idx AND n.txt = coalesce(c.txt, m."mode") WHERE c.kind = 'categorical')"""


@query(
    "feature_matrix",
    coerced_sql() + _MATRIX + " SELECT sheet_id, row_idx, feature_idx, round(value, 4) AS value FROM matrix",
)
def feature_matrix(spark, sf):
    sheets, types, typed = _typed(spark, sf)
    matrix, _ = ct.feature_matrix(pf.coerce(to_cells(sheets), types), typed, types)
    return matrix.select("sheet_id", "row_idx", "feature_idx", F.round("value", 4).alias("value"))


@query(
    "feature_preview",
    coerced_sql() + _MATRIX + """, head AS (SELECT sheet_id, row_idx, row_number() OVER (PARTITION BY sheet_id ORDER BY row_idx)
      AS preview_idx FROM (SELECT DISTINCT sheet_id, row_idx FROM cleaned))
    SELECT h.sheet_id, preview_idx, n.feature_idx, round(coalesce(m.value, 0), 4) AS value FROM head h JOIN names n USING (sheet_id)
    LEFT JOIN matrix m ON m.sheet_id = h.sheet_id AND m.row_idx = h.row_idx AND m.feature_idx = n.feature_idx WHERE preview_idx <= 25""",
)
def feature_preview(spark, sf):
    from tabprep.plans.prepare import prepare

    shown = prepare(corpus(spark, sf)).preview()
    return shown.select(
        "sheet_id", F.col("preview_idx").cast("long").alias("preview_idx"), F.posexplode("features").alias("feature_idx", "value")
    ).select("sheet_id", "preview_idx", F.col("feature_idx").cast("long").alias("feature_idx"), F.round("value", 4).alias("value"))


@query(
    "ordinal_priority",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
    WHEN '2-HIGH' THEN 3 END AS priority_code FROM orders""",
)
def ordinal_priority(spark, sf):
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
    return table(spark, sf, "orders").select(
        "o_orderkey", ct.ordinal_encode(F.col("o_orderpriority"), order).alias("priority_code")
    )


@query("hashed_categories", "SELECT CAST(('0x' || substr(md5(c_name), 1, 15))::UBIGINT % 64 AS INTEGER) AS bucket, count(*) AS n FROM customer GROUP BY 1")
def hashed_categories(spark, sf):
    return table(spark, sf, "customer").groupBy(ct.hash_encode(F.col("c_name"), 64).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
