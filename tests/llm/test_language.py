import corpus_pipeline
import numpy as np
from llm.conftest import sample
from pyspark.sql import functions as F

from tabprep.llm.language import BUCKETS, LanguageModel, fit, identify, infer
from tabprep.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op2_language_mixture"](spark, SF).join(truth, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_mixtures_get_their_shares(spark, documents):
    model = fit(documents, F.col("text"), F.col("lang"))
    text = {r["lang"]: r["text"] for r in documents.filter("n_chars > 3000").collect()}
    half = {l: " ".join(t.split()[:200]) for l, t in text.items()}
    docs = sample(spark, [half["en"], half["en"] + "\n" + half["fr"], half["de"] + " " + " ".join(half["en"].split()[:50])])
    got = [r["mixture"] for r in identify(docs, model).collect()]
    assert [m["lang"] for m in got[0]] == ["en"]
    assert {m["lang"] for m in got[1]} == {"en", "fr"} and all(abs(m["share"] - 0.5) < 0.1 for m in got[1])
    assert [m["lang"] for m in got[2]] == ["de", "en"] and abs(got[2][0]["share"] - 0.8) < 0.1


def test_odd_rows(odd, none, documents):
    model = fit(documents, F.col("text"), F.col("lang"))
    got = identify(odd, model).collect()
    undecided = {i for i, r in enumerate(odd.collect()) if not any(c.isalpha() for c in r["text"] or "")}
    assert {i for i, r in enumerate(got) if r["lang_pred"] == "und"} == undecided
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") and 0 <= r["score"] <= 1 for r in got)
    assert [tuple(r["row"]) for r in got] == [tuple(r) for r in odd.collect()]
    assert identify(none, model).count() == 0
    nothing = fit(none, F.col("text"), F.col("lang"))
    assert {r["lang_pred"] for r in identify(odd, nothing).collect()} == {"und"}


def test_a_text_does_not_read_its_neighbours():
    rng = np.random.default_rng(0)
    model = LanguageModel(["a", "b"], np.log(rng.random((BUCKETS, 2))).astype(np.float32))
    texts = [b"abc def", b"", b"ghi", b"x y z w"]
    together, _ = infer(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    apart = np.concatenate([infer(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts])
    assert np.allclose(together, apart)


def test_mixtures_of_more_than_three_languages():
    rng = np.random.default_rng(1)
    p = rng.random((BUCKETS, 6)) ** 8 + 1e-6
    model = LanguageModel(list("abcdef"), np.log(p / p.sum(axis=0)).astype(np.float32))
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    one = [infer(model, np.frombuffer(w.encode(), np.uint8), np.array([0, 6]))[0][0] for w in vocabulary]
    words = [[w for w, share in zip(vocabulary, one) if share.argmax() == k][:200] for k in range(6)]
    texts = [" ".join(w for k in range(m) for w in words[k]).encode() for m in (1, 4, 5)]
    shares, _ = infer(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    for m, share in zip((1, 4, 5), shares):
        assert set(np.flatnonzero(share)) == set(range(m)) and np.abs(share[:m] - 1 / m).max() < 0.05


def test_stage_keeps_documents_if_no_language_is_given(spark):
    docs = sample(spark, ["Some words", "12 !", None, "слово"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [0, 3]
