import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from llm.conftest import sample

from tabprep.llm.components import components
from tabprep.llm.simhash import drop_near_copies, fingerprint, link_variants, near_groups, near_links


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints):
    """Smallest index reachable over at most three differing bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def check(docs, **options):
    data = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in data]
    member = groups_of(prints)
    least = {}
    for r, g in zip(data, member):
        if r["doc_id"] is not None:
            least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    want = sorted(((r["doc_id"], f"{p:016x}", least.get(g)) for r, p, g in zip(data, prints, member)), key=str)
    got = near_groups(docs, carry=docs.columns, **options).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    assert sum(r["representative"] for r in got) == len(set(member))
    assert all(r["doc_id"] == r["component_id"] for r in got if r["representative"])


def test_fingerprint_is_the_bitwise_majority():
    for text in ("", " \t\n", "one", "one two", "One TWO three four", "É x y z\x0bw a a a a"):
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_odd_rows(odd, none):
    check(odd)
    assert near_groups(none).count() == 0
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns


def test_documents(spark, documents):
    rng = random.Random(5)
    texts = [r["text"] for r in documents.limit(60).collect()]
    changed = [t.replace(rng.choice(t.split()), "changed", 1) for t in texts]
    check(sample(spark, texts + changed, extra=False))


def random_links(spark, near, full_variant):
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for center in list(prints)[:near]:
        for _ in range(40):
            one = center
            for b in rng.sample(range(64), rng.randint(1, 4)):
                one ^= 1 << b
            prints.add(one)
    prints = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    links = near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), full_variant)
    roots = {r["u"]: r["v"] for r in components(links).collect()}
    member = groups_of([p & (1 << 64) - 1 for p in prints])
    assert [roots.get(p, p) for p in prints] == [prints[g] for g in member]


def test_links_connect_what_brute_force_connects(spark):
    random_links(spark, 8, 4096)


def test_full_variants_are_cut_finer_without_loss(spark):
    random_links(spark, 4, 8)


def test_a_variant_across_batches_is_seen_whole():
    fps = np.arange(40, dtype=np.int64)
    key = np.repeat([1, 2], [35, 5])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 3]), pa.array(fps[a : a + 3])], names=["key", "fp"]) for a in range(0, 40, 3)]
    pairs = {p for b in link_variants(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert {v for _, v in pairs if v < 35} == {0}
    assert {u for u, _ in pairs} == set(range(1, 35)) | {36, 37, 38, 39}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}
