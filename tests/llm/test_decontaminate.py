import random

import numpy as np
from conftest import rows
from llm.conftest import sample

from tabprep.llm.decontaminate import Pattern, budget, drop_leaks, find_leaks, normalised, pieces


def distances(item, text):
    """Last row of the semi-global edit distance table."""
    text = np.array([ord(c) for c in text], np.int64)
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (text != ord(c)), row[1:] + 1)))
        row = np.minimum.accumulate(new - place) + place
    return row


def brute(docs, items, rate=0.08):
    out = set()
    for i, text in docs:
        text = normalised(text or "")
        for number, item in items:
            item = normalised(item or "")
            if len(item) >= 30:
                row = distances(item, text)
                if row.min() <= budget(len(item), rate):
                    out.add((i, number, int(row.min())))
            elif item and f" {item} " in f" {text} ":
                out.add((i, number, 0))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        chars[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "q"])
    return "".join(chars)


def test_distance_is_exact():
    rng = random.Random(3)
    for _ in range(500):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 40)))
        row = distances(item, text)
        assert Pattern(item).best_end(text) == (row.min(), int(row.argmin()))


def test_pieces_cover_the_item():
    for n, k in ((30, 2), (31, 4), (100, 8)):
        got = pieces("x" * n, k)
        assert len(got) == k + 1 and sum(len(p) for _, p in got) == n and max(len(p) for _, p in got) - min(len(p) for _, p in got) <= 1


def test_edited_items_against_brute_force(spark, documents):
    rng = random.Random(8)
    texts = [r["text"][:1500] for r in documents.limit(30).collect()]
    items = [(i, t[200:450]) for i, t in enumerate(texts[:8])] + [(90, "too short"), (91, None), (None, texts[0][:300])]
    docs = []
    for i, t in enumerate(texts):
        item = items[i % 8][1]
        docs.append(t[:600] + " " + edited(rng, item, i % 12 * 3).upper() + "!! " + t[600:])
    found = find_leaks(sample(spark, docs), bench(spark, items)).collect()
    got = {(r["row"]["doc_id"], r["item_id"], r["distance"]) for r in found}
    assert got == brute(list(enumerate(docs)), [x for x in items if x[0] is not None])
    assert 20 < len(got) and any(d > 0 for _, _, d in got)
    blocks = find_leaks(sample(spark, docs), bench(spark, items), block_chars=400).collect()
    assert {(r["row"]["doc_id"], r["item_id"], r["distance"]) for r in blocks} == got
    clean = {r["doc_id"] for r in drop_leaks(sample(spark, docs), bench(spark, items), block_chars=900).collect()}
    assert clean == set(range(30)) - {i for i, _, _ in got}


def test_odd_rows(spark, odd, none):
    items = bench(spark, [(1, "word and more words here word and more words"), (2, None), (3, "")])
    got = find_leaks(odd, items).collect()
    assert sorted(r["row"]["doc_id"] for r in got) == [14, 15] and {r["item_id"] for r in got} == {1}
    kept = drop_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert rows(find_leaks(none, items)) == [] and rows(find_leaks(odd, bench(spark, []))) == []
    assert drop_leaks(odd, bench(spark, [])).count() == odd.count()


def test_equal_items_count_once(spark):
    text = "one two three four five six seven eight nine ten"
    got = find_leaks(sample(spark, [text, text]), bench(spark, [(7, text), (4, text)])).collect()
    assert sorted((r["row"]["doc_id"], r["item_id"], r["distance"]) for r in got) == [(0, 4, 0), (1, 4, 0)]


def test_short_items_are_found_exactly(spark):
    items = [(1, "What is the capital of France?"), (2, "法国的首都是哪一个城市请回答"), (3, "pi"), (4, "?!")]
    texts = ["Q: what is the CAPITAL of France - Paris", "what is the capitol of France", "somewhat is the capital of francey", "问题法国的首都是哪一个城市请回答吧", "pie, api", "a pi"]
    found = find_leaks(sample(spark, texts), bench(spark, items)).collect()
    assert sorted((r["row"]["doc_id"], r["item_id"], r["distance"], r["budget"], r["end"]) for r in found) == [(0, 1, 0, 0, 31), (3, 2, 0, 0, 16), (5, 3, 0, 0, 4)]
    assert {r["doc_id"] for r in drop_leaks(sample(spark, texts), bench(spark, items)).collect()} == {1, 2, 4}


def test_short_items_and_identifiers_of_any_type(spark):
    rng = random.Random(8)
    words = "what is the capital of france a an 42 日本 é".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    items = [(f"q{k}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for k in range(25)] + [("empty", "?!"), ("none", None)]
    unique = {normalised(t or ""): i for i, t in sorted(items, reverse=True)}
    items = [(i, t) for i, t in items if unique.get(normalised(t or "")) == i]
    named = spark.createDataFrame(items, "item_id string, text string")
    for block in (10, 4_000_000):
        found = find_leaks(sample(spark, texts), named, carry=["doc_id"], block_chars=block)
        got = {(r["row"]["doc_id"], r["item_id"], r["distance"]) for r in found.collect()}
        assert got == brute(list(enumerate(texts)), items) and len(got) > 50
        assert {r["doc_id"] for r in drop_leaks(sample(spark, texts), named, block_chars=block).collect()} == set(range(120)) - {i for i, _, _ in got}
