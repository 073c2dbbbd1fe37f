import random
import re

from llm.conftest import SF, sample

from tabprep.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, TemplateIndex, scan, word_frequency, words_of
from tabprep.llm.queries import QUERIES


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base(text):
    words = plain_words(text)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def blocks(text, templates=TEMPLATES):
    out = set()
    for number, line in enumerate((text or "").split("\n")):
        have = set(plain_words(line))
        for label, template in templates:
            want = set(plain_words(template))
            if want and len(want & have) >= CONTAINMENT * len(want) - 1e-9:
                out.add((number, label, round(len(want & have) / len(want), 9)))
    return out


def check(docs):
    texts = [r["text"] for r in docs.collect()]
    for text, r in zip(texts, scan(docs).collect(), strict=True):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        assert {(b["block"], b["label"], round(b["containment"], 9)) for b in r["blocks"]} == blocks(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_documents_against_brute_force(documents):
    check(documents.coalesce(1))


def test_query(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op10_license_scan"](spark, SF).collect()}
    for d in documents.collect():
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(d["text"])


def test_notices_with_words_added_and_left_out(spark):
    rng = random.Random(6)
    texts = []
    for _, template in TEMPLATES * 6:
        words = template.split()
        for _ in range(rng.randint(0, 4)):
            words.pop(rng.randrange(len(words))) if len(words) > 1 and rng.random() < 0.6 else words.insert(rng.randrange(len(words)), "other")
        texts.append("First line.\n" + " ".join(words) + "\nCC BY, cc-by all rights reserved ALL rights, reserved")
    check(sample(spark, texts))


def test_filters_lose_nothing_in_any_order():
    rng = random.Random(9)
    letters = "abcdefghij"
    for _ in range(300):
        templates = [(str(i), " ".join(rng.sample(letters, rng.randint(1, 8)))) for i in range(4)]
        index = TemplateIndex.build(templates, {c: rng.randint(0, 3) for c in letters}, 0.8)
        block = rng.choices(letters + "xyz", k=rng.randint(0, 14))
        got = {(index.labels[t], round(s, 9)) for t, s in index.matches(block)}
        assert got == {(label, share) for _, label, share in blocks(" ".join(block), templates)}


def test_odd_rows(odd, none):
    check(odd.coalesce(1))
    assert scan(none).count() == 0 and scan(odd, templates=()).count() == odd.count()


def test_frequency_counts_lines_of_all_documents(spark):
    docs = sample(spark, ["license a\nLicense license\nb", None, "", "license"])
    assert word_frequency(docs, {"license", "b", "never"}) == {"license": 3, "b": 1}
    assert words_of("É-x_Y9") == ["É", "x", "y9"]


MIT = """// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General
# Public License as published by"""


def test_wrapped_notices(spark):
    texts = ["Begin.\n" + MIT, BSD + "\nEnd.", GPL, MIT + "\n\n" + BSD, "Licensed under CC\nBY-NC 4.0", "free of charge\nto any person", MIT.replace("\n//", "") + "\nPermission is hereby"]
    got = scan(sample(spark, texts)).collect()
    assert [r["labels"] for r in got] == ["mit", "bsd", "gpl,gpl-3.0", "bsd,mit", "cc-by,cc-by-nc-4.0", "", "mit"]
    assert [len(r["wrapped"]) > 0 for r in got] == [True] * 5 + [False] * 2 and [r["score"] for r in got] == [1.0] * 5 + [0.0, 1.0]
    check(sample(spark, texts))


def test_widest_wrapping(spark):
    texts = ["\n".join(template.split()) for _, template in TEMPLATES]
    for (label, _), r in zip(TEMPLATES, scan(sample(spark, texts)).collect(), strict=True):
        assert label in r["labels"].split(",") and label in {w["label"] for w in r["wrapped"]} and r["score"] == 1.0
