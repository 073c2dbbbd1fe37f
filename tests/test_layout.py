import numpy as np
import pytest
from conftest import rows

from tabprep.operators import headers as hd
from tabprep.operators import structure as st
from tabprep.operators import tables as tl
from tabprep.operators import templates as tp
from test_cleaning import sheet


def test_tables_split_at_blank_rows(spark):
    data = [
        ["Cliente", "Monto", None], ["Ana", "1", None], ["Luz", None, None],
        [None, None, None],
        [None, "Fecha", "Tel"], [None, "2024", "5"],
        [None, None, None], [None, None, None],
        ["solo", None, None],
    ]
    for chunk in (1, 2, 100):
        tables = st.detect_tables(sheet(spark, ["a", "b", "c"], data), chunk_rows=chunk)
        got = rows(tables.select("table_start", "header_range", "data_range", "data_rows"), "table_start")
        assert got == [(0, "A1:B1", "A2:B3", 2), (4, "B5:C5", "B6:C6", 1), (8, "A9:A9", None, 0)]
        columns = st.table_columns(tables)
        assert rows(columns.select("header", "data_range"), "table_start", "col_idx") == [
            ("Cliente", "A2:A3"), ("Monto", "B2:B3"), ("Fecha", "B6:B6"), ("Tel", "C6:C6"), ("solo", None),
        ]
        assert rows(st.anchors(columns).select("label", "cell"), "label")[0] == ("Cliente", "A1")


def test_column_letters(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 51, 701, 702, 16383)], "i int")
    assert [r[0] for r in df.select(st.column_letters(F.col("i"))).collect()] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]


def _classes(spark, *items):
    return spark.createDataFrame([("s", i, h, t, c) for i, (h, t, c) in enumerate(items)], "sheet_id string, col_idx int, header string, type string, confidence double")


KNOWN = [(0, "anchor-hash::formula-fp", "template-historic", "v1")]


def _matched(spark, anchor, *labels):
    columns = spark.createDataFrame([("s", 0, h) for h in labels], "sheet_id string, table_start int, header string")
    marks = spark.createDataFrame([("s", anchor, "formula-fp")], "sheet_id string, anchor_hash string, formula_fingerprint string")
    known = spark.createDataFrame(KNOWN, "ord int, prefix string, template_id string, template_version_id string")
    return st.match_fingerprints(st.fingerprints(columns, marks), known)


def test_known_fingerprint_is_a_strong_match(spark):
    matched = _matched(spark, "anchor-hash", "Fecha", "Cliente", "Monto", "Dirección", "Ticket")
    assert matched.first().fingerprint == "anchor-hash::formula-fp::cliente|dirección|fecha|monto|ticket"
    classes = _classes(spark, ("Fecha", "date", 0.74), ("Cliente", "text", 0.71), ("Monto", "number", 0.69))
    decided = tp.decide_template(tp.score_templates(tp.class_summary(classes), matched)).first()
    assert decided.strong_template == "template-historic" and decided.top_score > 0.9 and not decided.propose_new
    hint = tp.repeat_hint(matched, classes).first()
    assert hint.confirmed_date_columns == ["Fecha"] and hint.template_exists and hint.note == "confirm-dates"


def test_new_template_is_proposed_when_all_scores_are_low(spark):
    classes = _classes(spark, ("a", "text", 0.2))
    scored = tp.score_templates(tp.class_summary(classes), _matched(spark, "other", "a"), [("t", "v1", 0.6)])
    decided = tp.decide_template(scored).first()
    assert decided.propose_new and decided.top_score == 0.52 and decided.rationale == "below-similarity-bar"
    assert tp.template_outcome(tp.decide_template(scored)).first().outcome == "propose"


def test_missingness_signal(spark):
    shape = "sheet_id string, tables int, columns int, anchors int, formats int, formulas int"
    found = {r.sheet_id: r for r in tp.missingness_signal(spark.createDataFrame([("rich", 2, 7, 3, 3, 2), ("empty", 0, 0, 0, 0, 0)], shape)).collect()}
    assert found["rich"].signal == "MAR" and found["rich"].imputation_permitted and found["rich"].confidence == 0.77
    assert found["empty"].signal == "MNAR" and not found["empty"].imputation_permitted and len(found["empty"].blockers) == 4


def _cosines(spark, vectors, catalog, kind="long"):
    v = spark.createDataFrame([(i, x) for i, x in enumerate(vectors)], "sheet_id long, vector array<double>")
    c = spark.createDataFrame([(i if kind == "long" else f"t{i:03d}", x) for i, x in enumerate(catalog)], f"template_id {kind}, vector array<double>")
    return v, c


@pytest.mark.parametrize("block,kind", [(1, "long"), (5, "string"), (1000, "long")])
def test_similar_sheets_in_blocks(spark, block, kind):
    rng = np.random.default_rng(1)
    vectors, catalog = rng.normal(size=(70, 5)), rng.normal(size=(37, 5))
    catalog[7] = 3 * catalog[4]  # a tie everywhere
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-np.round(unit(vectors) @ unit(catalog).T, 9), axis=1, kind="stable")[:, :4]
    v, c = _cosines(spark, vectors.tolist(), catalog.tolist(), kind)
    got = tp.similar_sheets(v, c, k=4, block_rows=block)
    assert [int(str(r.template_id).lstrip("t")) for r in got.orderBy("sheet_id", "rank").collect()] == best.ravel().tolist()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "Broadcast" not in plan and "Cartesian" not in plan


def test_odd_vectors(spark):
    v, c = _cosines(spark, [[1.0, 0.0], None, [], [0.0, None], [2.0, 0.0, 0.0]], [[5.0], [0.0, 1.0], None])
    got = {(r.sheet_id, r.rank): (r.template_id, r.similarity) for r in tp.similar_sheets(v, c, k=2).collect()}
    assert got[(0, 1)] == (0, 1.0) == got[(4, 1)] and got[(0, 2)] == (1, 0.0)
    assert [got[(i, 1)] for i in (1, 2, 3)] == [(0, 0.0)] * 3
    assert tp.similar_sheets(v, c.limit(0)).count() == 0 and tp.similar_sheets(v.limit(0), c).count() == 0


def _prefix_match(prints, known):
    out = {}
    for i, text in prints:
        hits = [(o, t) for o, p, t in known if p is not None and text is not None and text.startswith(p)]
        out[i] = min(hits)[1] if hits else None
    return out


def _known(spark, known):
    return spark.createDataFrame([(o, p, t, "v") for o, p, t in known], "ord int, prefix string, template_id string, template_version_id string")


def _check_prefixes(spark, prints, known):
    df = spark.createDataFrame(prints, "sheet_id int, fingerprint string")
    got = st.match_fingerprints(df, _known(spark, known))
    assert {r.sheet_id: r.template_id for r in got.collect()} == _prefix_match(prints, known)


def test_prefixes_of_five_thousand_lengths(spark):
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("ab|:"), 5200))
    ranks = rng.permutation(5000).tolist()
    known = [(ranks[n - 1], text[:n], f"t{n}") for n in range(1, 5001)]
    prints = [(i, text[: int(n)] + extra) for i, (n, extra) in enumerate(zip(rng.integers(0, 5200, 60), ["", "a", "zz", "é"] * 15))]
    _check_prefixes(spark, prints, known)


def test_random_prefixes(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aébé😀"), int(rng.integers(0, 6))))
    known = [(i, word(), f"t{i}") for i in range(40)] + [(99, None, "none")]
    prints = [(i, word() + word()) for i in range(400)] + [(400 + i, "aaa") for i in range(300)] + [(1000, None)]
    _check_prefixes(spark, prints, known[1:] + [(50, "aaa", "first")])
    _check_prefixes(spark, prints, [(7, "", "all"), (3, "aé", "some")])
    _check_prefixes(spark, prints, [])
    _check_prefixes(spark, [], known)


def test_fingerprint_of_a_million_tables(spark):
    n = 1_000_000
    columns = spark.range(n).selectExpr("'s' AS sheet_id", "id * 3 AS table_start", "concat('H', id % 7) AS header")
    marks = spark.createDataFrame([("s", "a", "f"), ("t", None, None)], "sheet_id string, anchor_hash string, formula_fingerprint string")
    found = {r.sheet_id: r for r in st.fingerprints(columns, marks, longest=100).collect()}
    assert found["s"].fingerprint == ("a::f" + "".join(f"::h{i % 7}" for i in range(60)))[:100]
    assert found["t"].fingerprint == "unknown-anchor::unknown-formula" and found["t"].tables_hash is None
    moved = columns.withColumn("table_start", n * 3 - columns["table_start"])
    shifted = columns.withColumn("table_start", columns["table_start"] + 5)
    hashes = [st.fingerprints(df, marks, longest=100).filter("sheet_id = 's'").first().tables_hash for df in (moved, shifted)]
    assert hashes[0] != found["s"].tables_hash == hashes[1]


def test_merged_ranges_are_filled(spark):
    cells = spark.createDataFrame(
        [("s", 0, 0, "A", True), ("s", 1, 0, None, True), ("s", 2, 0, None, False), ("s", 3, 0, "B", False)],
        "sheet_id string, row_idx long, col_idx int, value string, merged boolean",
    )
    assert [r.value for r in tl.fill_merged(cells, chunk_rows=1).orderBy("row_idx").collect()] == ["A", "A", None, "B"]


def test_levels_reset_below_a_new_parent(spark):
    data = [("s", 0, "N", None), ("s", 1, None, "x"), ("s", 2, None, None), ("s", 3, "S", None), ("s", 4, None, "y")]
    flat = tl.flatten_levels(spark.createDataFrame(data, "sheet_id string, row_idx long, a string, b string"), ["a", "b"], chunk_rows=2)
    assert rows(flat.select("a", "b", "row_idx"), "row_idx") == [("N", None, 0), ("N", "x", 1), ("N", "x", 2), ("S", None, 3), ("S", "y", 4)]


def test_signature_ignores_order_and_repeats(spark):
    def sign(*labels):
        return st.signature(spark.createDataFrame([("s", x) for x in labels], "sheet_id string, header string"), "header", "h").first().h

    assert sign("a", "b", "a") == sign("b", "a") != sign("a", "c")


def test_classes_feed_the_summary(spark):
    heads = spark.createDataFrame([("s", 0, "Fecha"), ("s", 1, "Foto")], "sheet_id string, col_idx int, header string")
    assert tp.class_summary(hd.classify_columns(heads)).first().type_count == 2
