import zlib
from collections import defaultdict

import pytest
from llm.conftest import SF
from llm.test_decontaminate import brute
from llm.test_packing import ids_of
from llm.test_simhash import groups_of, plain_fingerprint

import __spark_entry__
import corpus_pipeline
from tabprep.llm.packing import piece_lengths


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with all that the stages act on, beside a benchmark of their own."""
    folder = tmp_path_factory.mktemp("tables")
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"]) < 2500][:40]
    items = [(1, rows[0]["text"][:200]), (2, rows[7]["text"][50:250]), (3, "short"), (4, None)]
    made = [tuple(r) for r in rows]
    made += [(1000 + r["doc_id"], r["text"].upper() if r["text"].isascii() else r["text"], None, None, None) for r in rows[3:9]]
    made += [(2000, None, "en", "s", 0), (2001, "", None, None, None), (2002, "12 34 !?", "en", "s", 8), (None, rows[9]["text"], "en", "s", 1)]
    made += [(3000, rows[12]["text"] + " " + items[0][1].replace("e", "x", 3), "en", "s", 1)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), made, items


def expected(made, items):
    docs = [(i, t) for i, t, *_ in made if any(c.isalpha() for c in t or "")]
    by_text = defaultdict(list)
    for i, t in docs:
        by_text["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)].append((i, t))
    docs = [max(group, key=lambda d: -1 if d[0] is None else d[0]) for group in by_text.values()]
    docs.sort(key=lambda d: d[0])
    member = groups_of([plain_fingerprint(t) for _, t in docs])
    docs = [d for k, d in enumerate(docs) if member[k] == k]
    leaks = {i for i, _, _ in brute(docs, items)}
    out = set()
    for i, t in docs:
        if i not in leaks:
            ids, at = ids_of(t), 0
            for n in piece_lengths(len(ids), 2048):
                out.add((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
                at += n
    return out, leaks


def test_run_against_brute_force(spark, small):
    folder, made, items = small
    got = corpus_pipeline.run(spark, folder).collect()
    want, leaks = expected(made, items)
    assert leaks and {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want
    assert len({r["sequence_id"] for r in got}) == len(got) == len(want)


def test_stages_return_the_columns_of_documents(spark, small):
    folder, *_ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before, name
        before = after


def test_empty_table(spark, small, tmp_path):
    folder, *_ = small
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 11)}
