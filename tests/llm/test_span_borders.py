"""Passages that repeat are found whatever stands around them."""

import random

from llm.conftest import sample

from tabprep.llm.span_dedup import repeated_stretches

RNG = random.Random(5)


def words(n, own):
    return [f"{own}{RNG.randrange(10**6)}" for _ in range(n)]


def removed(spark, texts):
    found = {r["id"]: [(s["start"], s["end"]) for s in r["stretches"]] for r in repeated_stretches(sample(spark, texts)).collect()}
    return {i: [texts[i][a:b] for a, b in v] for i, v in found.items()}


def test_short_lines_of_a_repeated_passage(spark):
    lines = "\n".join(" ".join(words(4, "l")) for _ in range(20))
    single = ", ".join(words(5, "n")) + ".\n" + "\n".join(words(12, "w"))
    assert removed(spark, [lines, "Another start here\n" + lines + "\nand its end", single, "Other. Text!\n" + single]) == {1: [lines], 3: [single]}


def test_the_last_short_sentences_go_too(spark):
    passage = " ".join(" ".join(words(n, "t")) + "." for n in (8, 3, 4, 7))
    assert removed(spark, [passage, "Before it. " + passage]) == {1: [passage]}


def test_passage_without_stops_at_any_offset(spark):
    passage = words(60, "p")
    texts = [" ".join(words(40, "a") + passage + words(40, "b"))] + [" ".join(words(n, "c") + passage + words(30, "d")) for n in range(1, 25)]
    got = removed(spark, texts)
    assert set(got) == set(range(1, 25))
    shared = " ".join(passage)
    assert all(len(v) == 1 and v[0] in shared and len(v[0].split()) >= 15 for v in got.values())


def test_a_fragment_before_or_after_a_passage(spark):
    passage = " ".join(" ".join(words(17, "s")) + "." for _ in range(3))
    assert removed(spark, [passage, "Yes. " + passage, "Well then! " + passage + " No. Why?"]) == {1: [passage], 2: [passage]}


def test_other_scripts(spark):
    chinese = "我们昨天去了北京的一个大公园。那里有很多漂亮的花和树！你想不想跟我们一起再去一次？"
    hindi = "यह पहला वाक्य है जो बहुत लंबा है। यह दूसरा वाक्य है जो यहाँ है। तीसरा वाक्य भी यहाँ पर है।"
    assert removed(spark, [chinese, "今天天气很好。" + chinese + "再见。", hindi, "नमस्ते। " + hindi]) == {1: [chinese], 3: [hindi]}
