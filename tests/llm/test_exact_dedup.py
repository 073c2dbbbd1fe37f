import hashlib
import string
from collections import defaultdict

from conftest import rows

from tabprep.llm.exact_dedup import content_sort, drop_exact_copies

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected(found, pick):
    groups = defaultdict(list)
    for i, t in found:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def check(docs, keep, **options):
    found = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = content_sort(docs, keep=keep, carry=docs.columns, **options).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == expected(
        found, max if keep == "largest" else min
    )
    kept = defaultdict(list)
    for r in got:
        if r["kept"]:
            kept[r["text_sha256"]].append(r)
    assert len(kept) == len({r["text_sha256"] for r in got})
    assert all(len(rs) == 1 and rs[0]["doc_id"] == rs[0]["keep_id"] for rs in kept.values())


def test_odd_rows(odd):
    check(odd, "largest")
    check(odd, "smallest")


def test_large_groups_are_cut_and_joined_again(spark, odd):
    many = odd.unionByName(odd).unionByName(odd)
    check(many, "largest", hot_rows=2)
    check(many, "smallest", hot_rows=2)


def test_documents(documents):
    check(documents, "largest")
    check(documents, "largest", hot_rows=1)


def test_columns_stay(odd, none):
    assert drop_exact_copies(odd).columns == odd.columns
    assert rows(drop_exact_copies(none)) == []
    assert drop_exact_copies(odd).count() == 9
