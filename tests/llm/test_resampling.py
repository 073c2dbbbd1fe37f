import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.conftest import SF, sample

from tabprep.llm.queries import QUERIES
from tabprep.llm.resampling import bucket_gains, hashed_features, importance_weights, ngram_pattern, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, shortest, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, shortest=1, longest=1, size=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % size
    found = [(i, *features(t, shortest, longest)) for i, t in docs]
    raw = Counter(bucket(f) for _, _, fs in found for f in fs)
    want = Counter(bucket(f) for t in target for f in features(t, shortest, longest)[1])
    s_all, t_all = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s_all + size) / ((raw[b] + 1) * (t_all + size)))) for b in raw}
    out = []
    for i, words, fs in found:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def made(docs, target, shortest=1, longest=1, buckets=10_000, **draw):
    weighted = importance_weights(docs, target, keep=["doc_id"], shortest=shortest, longest=longest, buckets=buckets)
    got = resample(weighted, **draw).select("row.doc_id", "n_features", "weight", "score", "rank")
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("shortest,longest,buckets", [(1, 1, 10_000), (1, 3, 500), (2, 2, 100_000)])
def test_documents_against_brute_force(spark, documents, shortest, longest, buckets):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs, target = [(r["doc_id"], r["text"]) for r in documents.collect()], [r["text"] for r in benchmark.collect()]
    assert made(documents, benchmark, shortest, longest, buckets) == brute(docs, target, shortest, longest, buckets)


def test_query_against_brute_force(spark, documents):
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_importance_resampling"](spark, SF).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in documents.collect()], target)


def test_overlapped_runs_of_words():
    line = b"a bc d e\xc3\xa9 f"
    for n in range(1, 7):
        words = line.split()
        assert [m[0] for m in ngram_pattern(n).finditer(line, overlapped=True)] == [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_odd_rows(spark, odd, none):
    target = sample(spark, ["same text and words", None, ""])
    docs, wanted = [(r["doc_id"], r["text"]) for r in odd.collect()], ["same text and words", None, ""]
    assert made(odd, target, 1, 2, percent=50, least_words=1) == brute(docs, wanted, 1, 2, percent=50, least=1)
    assert made(odd, none) == brute(docs, [])
    assert made(none, target) == []
    weighted = importance_weights(odd, target)
    assert sorted(map(str, (tuple(r["row"]) for r in weighted.collect()))) == sorted(map(str, (tuple(r) for r in odd.collect())))


def test_equal_scores_go_by_identifier(spark):
    docs = sample(spark, ["one two three"] * 40, [7] * 20 + [3] * 20)
    got = resample(importance_weights(docs, docs, keep=["doc_id"]), percent=75, least_words=1)
    ranks = sorted((r["rank"], r["row"]["doc_id"], r["score"]) for r in got.filter("rank is not null").collect())
    assert [r[0] for r in ranks] == list(range(1, 31)) and [r[1:] for r in ranks] == sorted((r[1:] for r in ranks), key=lambda x: -x[1])


def test_a_feature_of_the_target_gains():
    gains = bucket_gains(np.array([10, 10, 0]), np.array([10, 0, 0]))
    assert gains[0] > 0 > gains[1] and gains.tolist() == [math.floor(1000 * math.log(a)) for a in (11 * 23 / (11 * 13), 1 * 23 / (11 * 13), 1 * 23 / (1 * 13))]


def test_a_very_long_word(spark):
    got = hashed_features(sample(spark, ["x" * 3_000_000 + " y"]), buckets=7).first()
    assert got["n_words"] == 2 and len(got["features"]) == 8
