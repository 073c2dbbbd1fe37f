import hashlib
import random
import zlib

import pytest
from llm.conftest import SF, sample
from pyspark.sql import functions as F

from tabprep.llm.merkle import Level, Segment, build_levels, height, manifest, resumed
from tabprep.llm.queries import QUERIES

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    for f in FIELDS:
        v = row[f]
        if v is None:
            out += "-"
        else:
            v = str(v + more if f == "n_chars" else v)
            out += f"{len(v.encode())}:{v}"
    return sha(out)


def tree(nodes, fanout):
    """Root, and for each leaf the siblings from the bottom up as (those before, those after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for i, place in enumerate(at):
            run = runs[place // fanout]
            paths[i].append((run[: place % fanout], run[place % fanout + 1 :]))
            at[i] = place // fanout
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def brute(found, fanout, tampered):
    groups = {}
    for r in found:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        members = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = (members, *tree([leaf(r) for r in members], fanout))
    root, tops = tree([trees[n][1] for n in names], fanout)
    out = []
    for name, above in zip(names, tops):
        members, subroot, paths = trees[name]
        for place, (r, path) in enumerate(zip(members, paths)):
            digest = leaf(r, 1) if tampered(r) and r["n_chars"] is not None else leaf(r)
            for left, right in path + above:
                digest = sha("".join(left + [digest] + right))
            proof = "".join("".join(left + right) for left, right in path + above)
            out.append((r["doc_id"], place, leaf(r), subroot, root, sha(proof), digest))
    return sorted(out, key=str)


def made(docs, **options):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    got = manifest(docs, FIELDS, "lang", "doc_id", changed=tampered, changes={"n_chars": F.col("n_chars") + 1}, **options)
    return sorted(
        (
            (r["row"]["doc_id"], r["position"], r["leaf"], r["subroot"], r["root"], sha("".join(s["left"] + s["right"] for s in r["proof"])), r["folded_root"])
            for r in got.collect()
        ),
        key=str,
    )


def touched(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0


@pytest.mark.parametrize("fanout,nodes", [(2, 1024), (2, 4), (3, 9), (5, 5)])
def test_documents_against_brute_force(documents, fanout, nodes):
    assert made(documents, fanout=fanout, segment_nodes=nodes) == brute(documents.collect(), fanout, touched)


def test_query_finds_what_was_tampered_with(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op11_merkle_manifest"](spark, SF).collect()}
    found = documents.collect()
    assert len(got) == len(found)
    assert {i for i, r in got.items() if not r["verified"]} == {r["doc_id"] for r in found if touched(r)} != set()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17])
def test_groups_of_any_size(spark, n):
    langs = [f"l{i % 3}" if i < n else None for i in range(n + 2)] + ["é"]
    docs = sample(spark, [f"text {i}" for i in range(n + 3)], langs=langs)
    assert made(docs, segment_nodes=2) == brute(docs.collect(), 2, touched)


def test_odd_rows(odd, none):
    assert made(odd) == brute(odd.collect(), 2, touched)
    assert made(odd, segment_nodes=2) == made(odd)
    assert made(none) == []
    kept = manifest(odd, FIELDS, "lang", "doc_id", keep=odd.columns)
    assert sorted(tuple(r["row"]) for r in kept.drop("proof").collect() if r["row"]["doc_id"]) == sorted(tuple(r) for r in odd.collect() if r["doc_id"])


def test_one_huge_group_meets_no_single_task(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS lang", "'s' AS source", "id AS n_chars", "'same' AS text")
    got = manifest(docs, FIELDS, "lang", "doc_id", segment_nodes=64).select("row.doc_id", "position", F.size("proof").alias("steps"), (F.col("root") == F.col("folded_root")).alias("ok"))
    assert got.filter("doc_id = position AND steps = 15 AND ok").count() == 20_000


def test_only_the_right_side_is_hashed_again():
    random.seed(5)
    nodes = [sha(str(random.random())) for _ in range(7)]
    level = Level.of(nodes, 4)
    for at in range(7):
        run = nodes[at - at % 4 : at - at % 4 + 4]
        new = sha(f"new {at}")
        want = sha("".join(run[: at % 4] + [new] + run[at % 4 + 1 :]))
        assert resumed(level.states[at // 4][at % 4], new, level.siblings(at, 4)[1]) == want
    assert height(7, 4) == 2 and build_levels(nodes, 2, 4)[-1].parents == [sha(sha("".join(nodes[:4])) + sha("".join(nodes[4:])))]
    segment = Segment(nodes, 2, 4, [{"left": "ab", "right": "cd"}])
    assert segment.fold(6, nodes[6]) == sha("ab" + build_levels(nodes, 2, 4)[-1].parents[0] + "cd")
