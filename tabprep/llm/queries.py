"""The registered queries of the text operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm import (
    decontaminate, exact_dedup, language, licenses, merkle, packing, pieces, pii, quality, resampling, simhash, span_dedup, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op4_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""")
def op4_exact_dedup(spark, sf_dir):
    found = exact_dedup.content_sort(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256")


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack_power_of_two(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


@query("op3_packing")
def op3_packing(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def learned_languages(docs: DataFrame) -> language.LanguageModel:
    taught = docs.filter(~F.coalesce(held_out(), F.lit(False)))
    return language.fit(taught, F.col("text"), F.col("lang"))


@query("op2_language_mixture")
def op2_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, learned_languages(docs), keep=["doc_id"])
    return found.select(
        "row.doc_id", F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score",
        F.concat_ws(",", F.transform("mixture", lambda m: F.concat(m["lang"], F.lit(":"), F.round(m["share"], 3)))).alias("mixture"),
    )


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id", "representative")


@query("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return leaks.select("row.doc_id", "item_id", "distance", "budget", F.col("end").alias("match_end"))


URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


@query("op8_url_filter")
def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_filter.judge(pages, url_filter.train(url_filter.labelled_urls(spark)), URL_RULES)
    return found.select("row.page_id", "host", "path", "rule", "verdict", "score")


@query("op5_quality")
def op5_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~held_out()))
    found = quality.score(docs, model, keep=["doc_id"])
    return found.select(
        "row.doc_id", F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _starts(phrase: str, label: str) -> str:
    words = phrase.split()
    here = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words))
    return f"list_transform(list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {here}), lambda i: struct_pack(at := i - 1, label := '{label}'))"


_TEMPLATES = ", ".join(
    f"({k}, '{label}', [{', '.join(chr(39) + w + chr(39) for w in sorted(set(licenses.words_of(text))))}])"
    for k, (label, text) in enumerate(licenses.TEMPLATES)
)


@query("op10_license_scan", f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format("t")} AS w FROM d),
p AS (SELECT doc_id, len(w) AS n_words, list_concat(list_concat({_starts("cc by", "cc-by")}, {_starts("general public license", "gpl")}), {_starts("all rights reserved", "reserved")}) AS places FROM w),
base AS (SELECT doc_id, n_words, len(places) AS n_base, list_min(list_transform(places, lambda x: x.at)) AS first_word, list_max(list_transform(places, lambda x: x.at)) AS last_word,
  list_sort(list_distinct(list_transform(places, lambda x: x.label))) AS names FROM p),
lines AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS k, unnest(string_split(t, chr(10))) AS line FROM d),
template(id, label, need) AS (VALUES {_TEMPLATES}),
met AS (SELECT doc_id, k, label, len(list_intersect(need, list_distinct({_WORDS.format("line")}))) AS shared, len(need) AS size FROM lines, template),
hits AS (SELECT *, shared = max(shared) OVER (PARTITION BY doc_id, k) AS closest FROM met WHERE shared >= 0.8 * size - 1e-9),
own AS (SELECT doc_id, count(*) AS n_blocks, max(shared / size) AS best, list_distinct(list(label) FILTER (closest)) AS names FROM hits GROUP BY 1)
SELECT b.doc_id, b.n_words, b.n_base, b.first_word, b.last_word, array_to_string(b.names, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(b.names, coalesce(o.names, [])))), ',') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(o.best, 0.0) END::DOUBLE AS score, coalesce(o.n_blocks, 0) AS n_blocks
FROM base b LEFT JOIN own o ON b.doc_id = o.doc_id""")
def op10_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        (F.size("blocks") + F.size("wrapped")).cast("long").alias("n_blocks"),
    )


#: The key of the registered query; in use it comes from a secret store.
PSEUDONYM_KEY = "acceptance-key"


@query("op7_pii_pseudonyms")
def op7_pii_pseudonyms(spark, sf_dir):
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY, keep=["doc_id"])
    return found.select("row.doc_id", "text", "n_found", "n_replaced")


@query("op9_sentence_spans")
def op9_sentence_spans(spark, sf_dir):
    found = span_dedup.repeated_stretches(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("stretches").cast("long").alias("n_stretches"),
        F.aggregate("stretches", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("stretches", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("removed"),
    )


#: Unsigned CRC-32 of ``bytes`` (a list of numbers), bit by bit: the table of all bytes, then one lookup a byte.
_CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen({0})), lambda k: ('0x' || substr(hex({0}), (2 * k + 1)::INT, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295)"""


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(({name})::VARCHAR) || ':' || ({name})::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


_RAISE = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
_SIBLING = "coalesce(nodes[xor({0}, 1) + 1], '')"


@query("op11_merkle_manifest", f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS tampered, doc_id::VARCHAR AS name FROM documents),
leaves AS (SELECT doc_id, tree, leaf, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  CASE WHEN {_CRC.format("name")} % 7 = 0 THEN tampered ELSE leaf END AS offered FROM d, crc_table),
up AS (SELECT tree, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY tree
  UNION ALL SELECT tree, level + 1, {_RAISE} FROM up WHERE len(nodes) > 1),
subroots AS (SELECT tree, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE len(nodes) = 1),
over AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_RAISE} FROM over WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM over WHERE len(nodes) = 1),
path AS (SELECT tree, pos, level AS step, pos >> level AS at, {_SIBLING.format("(pos >> level)")} AS other FROM leaves JOIN up USING (tree) WHERE len(nodes) > 1
  UNION ALL SELECT tree, pos, height + level, place >> level, {_SIBLING.format("(place >> level)")} FROM leaves JOIN subroots USING (tree), over WHERE len(nodes) > 1),
fold AS (SELECT tree, pos, 0 AS step, offered AS digest FROM leaves
  UNION ALL SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN p.at % 2 = 0 THEN f.digest || p.other ELSE p.other || f.digest END)
  FROM fold f JOIN path p ON f.tree = p.tree AND f.pos = p.pos AND f.step = p.step),
folded AS (SELECT tree, pos, arg_max(digest, step) AS folded_root FROM fold GROUP BY ALL),
proofs AS (SELECT tree, pos, string_agg(other, '' ORDER BY step) AS proof FROM path GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) CROSS JOIN top JOIN folded USING (tree, pos) LEFT JOIN proofs USING (tree, pos)""")
def op11_merkle_manifest(spark, sf_dir):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    found = merkle.manifest(
        table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
        changed=tampered, changes={"n_chars": F.col("n_chars") + 1},
    )
    proof = F.array_join(F.transform("proof", lambda step: F.concat(step["left"], step["right"])), "")
    return found.select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_BUCKETS, _PERCENT, _LEAST, _SEED = 10_000, 10, 20, 2024


@query("op12_importance_resampling", f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
found AS (SELECT doc_id, unnest(w) AS word FROM d), wanted AS (SELECT unnest(w) AS word FROM b),
words AS (SELECT DISTINCT word FROM (SELECT word FROM found UNION ALL SELECT word FROM wanted)),
hashed AS (SELECT word, {_CRC.format("word")} % 10000 AS bucket FROM words, crc_table),
raw AS (SELECT bucket, count(*)::DOUBLE AS s FROM found JOIN hashed USING (word) GROUP BY 1),
target AS (SELECT bucket, count(*)::DOUBLE AS t FROM wanted JOIN hashed USING (word) GROUP BY 1),
total AS (SELECT (SELECT count(*) FROM found)::DOUBLE AS ss, (SELECT count(*) FROM wanted)::DOUBLE AS tt),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM raw LEFT JOIN target USING (bucket), total),
sums AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM found JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN drawn ON s.doc_id = drawn.doc_id""")
def op12_importance_resampling(spark, sf_dir):
    weighted = resampling.importance_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"], buckets=_BUCKETS)
    found = resampling.resample(weighted, "doc_id", _PERCENT, _LEAST, _SEED)
    return found.select("row.doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


@query("op13_sentencepiece")
def op13_sentencepiece(spark, sf_dir):
    import public_tokenizers

    found = pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.element_at("bounds", -1).alias("source_bytes"),
    )
