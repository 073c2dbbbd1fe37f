"""Header semantics over two catalogues that grow with the data: labels derived from events (one
sheet per user and day), and every line of every document."""

from pyspark.sql import functions as F

from acceptance import fixed as lx
from acceptance.base import any_of, query, table
from tabprep.functions.text import normalize_text
from tabprep.operators import headers as hd
from tabprep.operators import mapping as mp
from tabprep.session import materialize
from tabprep.sources.tables import as_sheet

_LABELS = {
    "click": ["Fecha", "Fecha de visita", "Created date", "Día agendado"],
    "view": ["Dirección cliente", "Address line", "Latitud", "Longitud"],
    "purchase": ["Monto total", "Cantidad", "POS", "TID terminal"],
    "error": ["Foto del equipo", "RUT técnico", "Activo", "Ok flag"],
    "signup": ["Cliente", "Nombre empresa", "Razón social", "Comentario"],
}
_BANDS = ["value < 15", "value < 35", "value < 70", "true"]
LABEL = (
    "case event_type "
    + " ".join(
        f"when '{kind}' then case " + " ".join(f"when {b} then '{label}'" for b, label in zip(_BANDS, labels)) + " end"
        for kind, labels in _LABELS.items()
    )
    + " end"
)
SHEET = "concat('u', user_id, '-', cast(ts as date))"
CATALOGUE = f"catalogue AS (SELECT concat('u', user_id, '-', cast(cast(ts as date) as varchar)) AS sheet_id, event_id AS col_idx, {LABEL} AS header FROM events)"
LINES = """lines AS (SELECT CAST(doc_id AS VARCHAR) AS sheet_id, unnest(string_split(text, chr(10))) AS header,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS col_idx FROM documents)"""


def catalogue(spark, sf):
    return table(spark, sf, "events").select(
        F.expr(SHEET).alias("sheet_id"), F.col("event_id").alias("col_idx"), F.expr(LABEL).alias("header")
    )


def lines(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("sheet_id"), F.posexplode(F.split("text", "\n")).alias("col_idx", "header")
    ).withColumn("col_idx", F.col("col_idx").cast("long"))


_TOKENS = "list_filter(regexp_split_to_array(lower(header), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _signal(words):
    return f"len(list_filter(tokens, lambda t: regexp_matches(t, '{any_of(words)}')))"


def features_sql(source):
    counts = ", ".join(f"{_signal(words)} AS {name}_signal" for name, words in lx.SIGNALS.items())
    return f"""feats AS (SELECT *, {counts}, greatest(length(array_to_string(tokens, '')) - 18, 0) / 10 AS length_penalty
      FROM (SELECT *, {_TOKENS} AS tokens FROM {source}))"""


def scores_sql(source):
    inputs = [f"{n}_signal" for n in lx.SIGNALS] + ["length_penalty"]
    dot = lambda row, names: " + ".join(f"({w}::DOUBLE) * {x}" for w, x in zip(row, names))
    hidden = ", ".join(f"greatest({dot(r, inputs)} + {b}, 0) AS h{i}" for i, (r, b) in enumerate(zip(lx.HIDDEN_WEIGHTS, lx.HIDDEN_BIAS)))
    hs = [f"h{i}" for i in range(5)]
    logits = ", ".join(f"{dot(r, hs)} + {b} AS z{i}" for i, (r, b) in enumerate(zip(lx.OUTPUT_WEIGHTS, lx.OUTPUT_BIAS)))
    total = " + ".join(f"exp(z{i})" for i in range(6))
    share = lambda i: f"round(p{i} * pow(10, 5 - floor(log10(p{i})))) / pow(10, 5 - floor(log10(p{i})))"
    return (
        features_sql(source)
        + f", hid AS (SELECT *, {hidden} FROM feats), logit AS (SELECT *, {logits} FROM hid),"
        + " probs AS (SELECT *, " + ", ".join(f"exp(z{i}) / ({total}) AS p{i}" for i in range(6)) + " FROM logit),"
        + " scored AS (SELECT *, " + ", ".join(f"{share(i)} AS s{i}" for i in range(6)) + " FROM probs)"
    )


_BEST = "greatest(s0, s1, s2, s3, s4, s5)"


def classified_sql(source):
    kinds = " ".join(f"WHEN s{i} = {_BEST} THEN '{t}'" for i, t in enumerate(lx.SCORED_TYPES))
    return (
        scores_sql(source)
        + f""", classified AS (SELECT sheet_id, col_idx, header, tokens, CASE WHEN photo THEN 'photo' WHEN address THEN 'address' ELSE CASE {kinds} END END AS type,
        CASE WHEN photo THEN 0.93 WHEN address THEN 0.88 ELSE {_BEST} END AS confidence FROM (
        SELECT *, regexp_matches(lower(header), '{any_of(lx.PHOTO_WORDS)}') AS photo,
          regexp_matches(lower(header), '{any_of(lx.ADDRESS_WORDS)}') AS address FROM scored))"""
    )


@query(
    "header_tokens",
    f"WITH {LINES} SELECT sheet_id, col_idx, len(t) AS tokens, list_aggregate(list_transform(t, lambda x: length(x)), 'sum')::BIGINT AS letters,"
    f" t[1] AS first_token, t[-1] AS last_token FROM (SELECT *, {_TOKENS} AS t FROM lines)",
)
def header_tokens(spark, sf):
    from tabprep.functions.text import tokenize

    split = lines(spark, sf).withColumn("t", tokenize(F.col("header")))
    return split.select(
        "sheet_id", "col_idx", F.size("t").cast("long").alias("tokens"), F.length(F.array_join("t", "")).cast("long").alias("letters"),
        F.get("t", F.lit(0)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"),
    )


@query(
    "special_header_types",
    f"WITH {LINES} SELECT sheet_id, col_idx, CASE WHEN regexp_matches(lower(header), '{any_of(lx.PHOTO_WORDS)}') THEN 'photo'"
    f" WHEN regexp_matches(lower(header), '{any_of(lx.ADDRESS_WORDS)}') THEN 'address' END AS type FROM lines",
)
def special_header_types(spark, sf):
    return lines(spark, sf).select("sheet_id", "col_idx", hd.special_type(F.col("header")).alias("type"))


_SIGNAL_NAMES = [f"{n}_signal" for n in lx.SIGNALS]


@query(
    "header_signals",
    f"WITH {LINES}, {features_sql('lines')} SELECT sheet_id, col_idx, {', '.join(f'{n}::DOUBLE AS {n}' for n in _SIGNAL_NAMES)},"
    " length_penalty FROM feats",
)
def header_signals(spark, sf):
    return hd.lexical_features(lines(spark, sf)).drop("header", "tokens")


@query(
    "header_type_scores",
    f"WITH {LINES}, {scores_sql('lines')} SELECT sheet_id, col_idx, "
    + ", ".join(f"s{i} AS {t}" for i, t in enumerate(lx.SCORED_TYPES)) + " FROM scored",
)
def header_type_scores(spark, sf):
    scored = hd.score_types(lines(spark, sf))
    return scored.select(
        "sheet_id", "col_idx", *[F.get("scores", F.lit(i))["score"].alias(t) for i, t in enumerate(lx.SCORED_TYPES)]
    )


@query(
    "column_classes",
    f"WITH {CATALOGUE}, {classified_sql('catalogue')} SELECT sheet_id, col_idx, header, type, confidence::DOUBLE AS confidence FROM classified",
)
def column_classes(spark, sf):
    return hd.classify_columns(catalogue(spark, sf)).select(
        "sheet_id", "col_idx", "header", "type", "confidence"
    )


def keyword_sql(words, score):
    hits = " + ".join(f"contains(lower(header), '{k}')::INT" for k in words)
    return (
        f"CASE WHEN {hits} = 0 THEN 0 WHEN contains(lower(header), 'pos') OR contains(lower(header), 'tpv') THEN 0.88"
        f" WHEN {hits} >= 2 THEN 0.76 ELSE 0.64 END AS {score}"
    )


_FAMILIES = {"pos": lx.POS_KEYWORDS, **lx.LOCATION_KEYWORDS}
BEST_SQL = (
    "kw AS (SELECT *, " + ", ".join(keyword_sql(w, f"{n}_s") for n, w in _FAMILIES.items()) + " FROM catalogue), best AS (SELECT sheet_id, "
    + ", ".join(
        f"arg_min(header, struct_pack(a := -{n}_s, b := col_idx)) FILTER ({n}_s > 0) AS {n}_column, max({n}_s)::DOUBLE AS {n}_score"
        for n in _FAMILIES
    )
    + " FROM kw GROUP BY 1)"
)


@query("keyword_columns", f"WITH {CATALOGUE}, {BEST_SQL} SELECT * FROM best")
def keyword_columns(spark, sf):
    return hd.keyword_best(catalogue(spark, sf), _FAMILIES)


@query(
    "identity_columns",
    f"WITH {CATALOGUE} SELECT sheet_id, arg_min(header, col_idx) FILTER (regexp_matches(lower(header), '{any_of(lx.IDENTITY_KEYWORDS)}'))"
    " AS identity_column FROM catalogue GROUP BY 1",
)
def identity_columns(spark, sf):
    return hd.identity_column(catalogue(spark, sf))


POS_SQL = """pos AS (SELECT b.sheet_id, pos_column, round(CASE WHEN pos_column IS NULL THEN 0.32 ELSE least(0.95, pos_score + 0.05) END, 2)
    AS pos_confidence, pos_column IS NULL AS missing_required, CASE WHEN pos_column IS NULL THEN 'pos-not-found' WHEN t.type <> 'number'
    THEN 'pos-not-numeric' ELSE '' END AS warnings FROM best b LEFT JOIN (SELECT DISTINCT header, type FROM classified) t ON t.header = pos_column)"""
_ALL_SQL = f"WITH {CATALOGUE}, {classified_sql('catalogue')}, {BEST_SQL}, {POS_SQL}"


@query(
    "pos_detection",
    _ALL_SQL + """ SELECT *, CASE WHEN pos_column IS NULL THEN '<POS requerido>' ELSE '{{' || pos_column || '}},{{' || pos_column || '}}-alt' END AS sample_values,
    CASE WHEN pos_column IS NULL THEN '' ELSE 'POS-' || upper(pos_column) || ',POS-' || upper(pos_column) || '-SITE' END AS normalized_samples FROM pos""",
)
def pos_detection(spark, sf):
    found = hd.detect_pos(hd.classify_columns(catalogue(spark, sf)))
    for c in ("sample_values", "normalized_samples", "warnings"):
        found = found.withColumn(c, F.array_join(c, ","))
    return found


@query(
    "geolocation_check",
    _ALL_SQL + """ SELECT b.sheet_id, address_column, latitude_column, longitude_column,
    round(greatest(address_score, latitude_score, longitude_score, 0.35), 2)::DOUBLE AS geo_confidence,
    address_column IS NOT NULL AND NOT missing_required AS geo_ok, concat_ws(',', CASE WHEN address_column IS NULL THEN 'address-missing' END,
    CASE WHEN latitude_column IS NULL OR longitude_column IS NULL THEN 'coordinates-missing' END, CASE WHEN missing_required THEN 'pos-required' END)
    AS issues FROM best b JOIN pos USING (sheet_id)""",
)
def geolocation_check(spark, sf):
    heads = catalogue(spark, sf)
    found = hd.validate_geo(heads, hd.detect_pos(hd.classify_columns(heads)))
    return found.withColumn("issues", F.array_join("issues", ","))


@query(
    "title_templates",
    _ALL_SQL + f""" SELECT sheet_id, coalesce('POS {{{{' || pos_column || '}}}} - Incidencia reportada', '{lx.TITLE_WITHOUT_POS}') AS title_template FROM pos""",
)
def title_templates(spark, sf):
    return hd.title_hint(hd.detect_pos(hd.classify_columns(catalogue(spark, sf))))


@query(
    "ticket_titles",
    "SELECT CAST(o_custkey AS VARCHAR) AS sheet_id, o_orderkey AS row_idx, 'POS ' || o_orderkey || ' - ' || o_orderpriority || ' / ' ||"
    " coalesce(nullif(o_orderstatus, 'O'), '') AS title FROM orders",
)
def ticket_titles(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderkey").alias("POS"),
        F.col("o_orderpriority").alias("Prioridad"), F.expr("nullif(o_orderstatus, 'O')").alias("Estado"),
    )
    sheets = as_sheet(orders, F.col("o_custkey"), "o_orderkey", ["POS", "Prioridad", "Estado"])
    hints = sheets.headers.select("sheet_id").distinct().withColumn("title_template", F.lit("POS {{POS}} - {{Prioridad}} / {{Estado}}"))
    return hd.render_titles(sheets, hints)


@query(
    "normalized_text",
    "SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^A-Za-z0-9_\\s]', '', 'g'), ' ' || chr(10)) AS normalized FROM documents",
)
def normalized_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalize_text(F.col("text")).alias("normalized"))


def _quote(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _keywords(spark):
    return {r.field_id: r.keywords for r in mp.field_table(spark).collect()}


# Label and synonyms of each field, normalised by hand for the SQL side.
_FIELD_WORDS = {
    "cliente": ["cliente", "client", "cliente final", "razon social", "empresa", "compania", "customer", "account"],
    "direccion": ["direccion", "address", "ubicacion", "ubicacion", "domicilio", "calle", "dir", "localidad", "direccion cliente"],
    "fecha_visita": ["fecha de visita", "fecha", "visit date", "fecha programada", "fecha agendada", "programacion", "fecha cita", "schedule date"],
    "tecnico": ["tecnico asignado", "tecnico", "technician", "ingeniero", "responsable", "operario", "asignado"],
}
_SCORE = "list_sum(list_transform(words, lambda k: CASE WHEN norm = k THEN 2 WHEN contains(norm, k) THEN 1 ELSE 0 END))"
_FIELD_ROWS = ", ".join(f"('{f}', {i}, {_quote(_FIELD_WORDS[f])})" for i, f in enumerate(lx.PRIORITY))
CANDIDATES = f"""cols AS (SELECT sheet_id, header, min(col_idx) AS col_idx,
    trim(regexp_replace(lower(strip_accents(header)), '[^a-z0-9_\\s]', '', 'g')) AS norm FROM catalogue GROUP BY sheet_id, header),
  cand AS (SELECT sheet_id, header, col_idx, field_id, prio, {_SCORE} AS score FROM cols, (VALUES {_FIELD_ROWS}) f(field_id, prio, words)
    WHERE {_SCORE} > 0),
  queue AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, prio, field_id, col_idx) AS k FROM cand)"""


@query(
    "field_match_scores",
    f"WITH {CATALOGUE}, {CANDIDATES} SELECT sheet_id, header, field_id, score::INTEGER AS score FROM cand",
)
def field_match_scores(spark, sf):
    fields = mp.field_table(spark)
    labels = mp.distinct_columns(catalogue(spark, sf)).withColumn("_n", normalize_text(F.col("header")))
    scores = [
        labels.select(
            "sheet_id", "header", F.lit(f).alias("field_id"),
            mp.match_score(F.col("_n"), F.array(*[F.lit(w) for w in words])).alias("score"),
        )
        for f, words in _keywords(fields.sparkSession).items()
    ]
    out = scores[0]
    for s in scores[1:]:
        out = out.union(s)
    return out.filter("score > 0")


def mapped_sql():
    """Four rounds suffice for four fields: in every round the head of the free queue is taken."""
    steps, taken = [], None
    for i in range(4):
        free = "" if taken is None else (
            f" WHERE NOT EXISTS (SELECT 1 FROM {taken} t WHERE t.sheet_id = q.sheet_id AND (t.field_id = q.field_id OR t.header = q.header))"
        )
        pick = f"pick{i} AS (SELECT sheet_id, field_id, header FROM (SELECT q.*, row_number() OVER (PARTITION BY sheet_id ORDER BY k) AS r FROM queue q{free}) WHERE r = 1)"
        steps.append(pick)
        if taken is None:
            taken = "pick0"
        else:
            steps.append(f"taken{i} AS (SELECT * FROM {taken} UNION ALL SELECT * FROM pick{i})")
            taken = f"taken{i}"
    return (
        f"{CATALOGUE}, {CANDIDATES}, " + ", ".join(steps)
        + f", mapped AS (SELECT s.sheet_id, f.field_id, t.header FROM (SELECT DISTINCT sheet_id FROM catalogue) s, (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in lx.PRIORITY)}) f(field_id)"
        f" LEFT JOIN {taken} t ON t.sheet_id = s.sheet_id AND t.field_id = f.field_id)"
    )


@query("field_mapping", f"WITH {mapped_sql()} SELECT * FROM mapped")
def field_mapping(spark, sf):
    return mp.map_fields(catalogue(spark, sf), mp.field_table(spark))


TYPED_MAP = f"""WITH {mapped_sql()}, {classified_sql('catalogue')},
  tm AS (SELECT m.sheet_id, m.field_id, m.header, c.type FROM mapped m LEFT JOIN (SELECT DISTINCT header, type FROM classified) c
    ON lower(c.header) = lower(m.header))"""


def typed_mapping(spark, sf):
    heads = catalogue(spark, sf)
    return mp.stored_mapping(heads, hd.classify_columns(heads))


@query("mapped_field_types", TYPED_MAP + " SELECT * FROM tm")
def mapped_field_types(spark, sf):
    return typed_mapping(spark, sf)


@query(
    "mapping_gaps",
    TYPED_MAP + """ SELECT sheet_id, coalesce(string_agg(field_id, ',' ORDER BY field_id) FILTER (header IS NULL AND field_id <> 'tecnico'), '') AS missing_required,
    coalesce(string_agg(field_id, ',' ORDER BY field_id) FILTER (header IS NOT NULL AND type IS NULL AND field_id <> 'tecnico'), '') AS untyped_required,
    count(*) FILTER (field_id <> 'tecnico' AND (header IS NULL OR type IS NULL)) = 0 AS ok FROM tm GROUP BY 1""",
)
def mapping_gaps(spark, sf):
    gaps = mp.mapping_gaps(typed_mapping(spark, sf), mp.field_table(spark))
    return gaps.withColumn("missing_required", F.array_join("missing_required", ",")).withColumn(
        "untyped_required", F.array_join("untyped_required", ",")
    )


@query(
    "mapping_summary",
    TYPED_MAP + """, shape AS (SELECT sheet_id, count(*) AS table_count, sum(c)::BIGINT AS column_count FROM (SELECT sheet_id, count(*) AS c
      FROM catalogue GROUP BY 1) GROUP BY 1)
    SELECT sheet_id, table_count, column_count, count(header) AS matched_fields, count(type) AS typed_fields,
    (column_count < 3)::BIGINT AS blocker_count FROM tm JOIN shape USING (sheet_id) GROUP BY ALL""",
)
def mapping_summary(spark, sf):
    heads = catalogue(spark, sf)
    tables = heads.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("columns"))
    blockers = tables.select(
        "sheet_id", F.array_compact(F.array(F.when(F.col("columns") < 3, "too-few-columns"))).alias("blockers")
    )
    return mp.preview_summary(tables, typed_mapping(spark, sf), materialize(blockers, "blockers"))
