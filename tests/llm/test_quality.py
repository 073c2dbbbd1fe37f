import numpy as np
from pyspark.sql import functions as F

from tabprep.llm import quality
from tabprep.llm.quality import WORD_BUCKETS, FactorisationMachine, features, fit_rows, score, train
from tabprep.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]), np.array([float(len(t)) for t in texts])


def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op5_quality"](spark, SF).filter("held_out").join(labels, "doc_id")
    by = {r["quality"]: r["p"] for r in got.groupBy("quality").agg(F.avg("predicted").alias("p")).collect()}
    assert by[1] > 0.93 and by[0] < 0.35


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(4)
    width = WORD_BUCKETS + len(quality.STRUCTURE)
    model = FactorisationMachine(0.3, rng.normal(size=width), rng.normal(size=(width, 8)), np.zeros(len(quality.STRUCTURE)), np.ones(len(quality.STRUCTURE)))
    x = features(*block(["a b c a", "", "d e f. G!", "one"]))
    for i, got in enumerate(model.logits(x)):
        mine = x.row == i
        column = np.concatenate([x.bucket[mine], np.arange(WORD_BUCKETS, width)])
        value = np.concatenate([x.value[mine], np.clip(x.dense[i], -5, 5)])
        want = 0.3 + value @ model.linear[column]
        for j in range(len(column)):
            for k in range(j):
                want += value[j] * value[k] * (model.factors[column[j]] @ model.factors[column[k]])
        assert np.isclose(got, want)


def test_words_hash_alike_wherever_they_stand():
    alone = features(*block(["some words here"]))
    among = features(*block(["x y", "some words here", "z"]))
    mine = among.row == 1
    assert alone.bucket.tolist() == among.bucket[mine].tolist() and np.allclose(alone.value, among.value[mine])
    assert np.allclose(alone.dense[0], among.dense[1])


def test_training_learns_an_interaction():
    rng = np.random.default_rng(1)
    none = np.zeros(len(quality.STRUCTURE))
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([10 + a, 20 + b]), np.array([0.7, 0.7]), none))
        labels.append(float(a == b))
    model = fit_rows(rows, np.array(labels))
    logit = {}
    for a in (0, 1):
        for b in (0, 1):
            x = quality.Features(np.zeros(2, np.int64), np.array([10 + a, 20 + b]), np.array([0.7, 0.7]), none[None])
            logit[a, b] = model.logits(x)[0]
    assert min(logit[0, 0], logit[1, 1]) > 1 > -1 > max(logit[0, 1], logit[1, 0])


def test_odd_rows(spark, odd, none, documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    model = train(documents, labels, train_rows=50)
    got = score(odd, model).collect()
    assert [tuple(r["row"]) for r in got] == [tuple(r) for r in odd.collect()]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert score(none, model).count() == 0
    untaught = train(none, labels)
    assert {r["score"] for r in score(odd, untaught).collect()} == {0.5}


def test_the_sample_is_bounded_and_repeatable(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    first, again = (train(documents.repartition(n), labels, train_rows=40) for n in (3, 5))
    assert np.array_equal(first.factors, again.factors) and first.bias == again.bias
