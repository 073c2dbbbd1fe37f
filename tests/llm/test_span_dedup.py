from collections import defaultdict

from llm.conftest import SF, sample

from tabprep.llm.queries import QUERIES
from tabprep.llm.span_dedup import drop_repeats, repeated_stretches, sentences, spans


def runs_of(found):
    """Places (first sentence, last) of the runs: for each start and for each end the shortest with 3 sentences and 15 words."""
    n, words, out = len(found), [0], set()
    for _, _, w in found:
        words.append(words[-1] + len(w))
    for a in range(n):
        for b in range(a + 3, n + 1):
            if words[b] - words[a] >= 15:
                out.add((a, b))
                break
    for b in range(3, n + 1):
        for a in range(b - 3, -1, -1):
            if words[b] - words[a] >= 15:
                out.add((a, b))
                break
    if not out and n >= 3:
        out = {(0, n)}
    return sorted(out)


def brute(docs):
    """Character ranges to remove per row of ``docs``; the first place is in the row with the smallest identifier."""
    seen, later = {}, defaultdict(list)
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    for k in order:
        if docs[k][1] is None:
            continue
        found = sentences(docs[k][1])
        for a, b in runs_of(found):
            run = tuple(tuple(words) for _, _, words in found[a:b])
            if run in seen:
                later[k].append((found[a][0], found[b - 1][1]))
            seen.setdefault(run, k)
    out = {}
    for k, places in later.items():
        merged = []
        for a, b in sorted(places):
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out[k] = merged
    return out


def ranges(df):
    return {r["id"]: [[s["start"], s["end"]] for s in r["stretches"]] for r in df.collect()}


def test_sentences_cover_the_text(documents):
    for r in documents.collect():
        found = sentences(r["text"])
        assert "".join("".join(r["text"][a:b].split()) for a, b, _ in found) == "".join(r["text"].split())
        assert all(len(words) <= 20 and "".join(r["text"][a:b].lower().split()) == "".join(words) for a, b, words in found)


def test_documents_against_brute_force(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {docs[k][0]: v for k, v in brute(docs).items()}
    assert want and ranges(repeated_stretches(documents)) == want
    got = {r["doc_id"]: r["removed"] for r in QUERIES["op9_sentence_spans"](spark, SF).collect()}
    assert got == {i: ",".join(f"{a}-{b}" for a, b in v) for i, v in want.items()}
    texts = {r["doc_id"]: r["text"] for r in drop_repeats(documents).collect()}
    for i, text in docs:
        for a, b in reversed(want.get(i, [])):
            text = text[:a] + text[b:]
        assert texts[i] == text


PASSAGE = " ".join(f"This is sentence number {n} of the passage that many share." for n in "one two three four five six".split())


def test_a_shared_passage_stays_once(spark):
    own = [f"Document {i} begins with words of its own kind, number {i}. " for i in range(5)]
    docs = [o + PASSAGE + f" And {i} ends." for i, o in enumerate(own)] + [PASSAGE + "\n" + PASSAGE, "A clean one. With little text. And nothing else."]
    got = {r["doc_id"]: r["text"] for r in drop_repeats(sample(spark, docs)).collect()}
    assert got[0] == docs[0] and got[6] == docs[6] and got[5].strip() == ""
    assert all(PASSAGE not in got[i] and "begins" in got[i] and f"{i} ends" in got[i] for i in range(1, 5))


def test_one_long_sentence_is_cut(spark):
    long = " ".join(f"word{i}" for i in range(70))
    got = ranges(repeated_stretches(sample(spark, [long, "other\n" + long])))
    assert got == {1: [[6, 6 + len(long)]]}


def test_odd_rows(spark, odd, none):
    kept = drop_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert {r["doc_id"]: r["text"] for r in kept.filter("doc_id in (8, 9, 12)").collect()} == {8: None, 9: "", 12: "é"}
    assert [len(r["text"]) for r in kept.filter("doc_id in (14, 15)").orderBy("doc_id").collect()][1] <= 30
    assert repeated_stretches(none).count() == 0 and drop_repeats(none).count() == 0


def test_rows_of_one_identifier_are_told_apart(spark):
    docs = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (None, PASSAGE), (0, "Other."), (None, "One word. Two more. Three here."), (7, "One word. Two more. Three here.")]
    df = sample(spark, [t for _, t in docs], [i for i, _ in docs]).coalesce(1)
    got = sorted((str(r["doc_id"]), r["text"] in (PASSAGE, "One word. Two more. Three here.")) for r in drop_repeats(df).collect())
    assert got == [("0", False), ("1", False), ("1", True), ("2", False), ("7", True), ("None", False), ("None", False)]
    assert len(ranges(repeated_stretches(df))) == len({str(docs[k][0]) for k in brute(docs)}) == 3


def test_short_texts_that_repeat_whole(spark):
    short = "Call us now. We are open. Come in!"
    docs = [short, short + " Or write a letter.", short, "call us  NOW.\nwe are open. come in!", "Call us now. We are open."]
    want = {k: [[a, b] for a, b in v] for k, v in brute(list(enumerate(docs))).items()}
    assert ranges(repeated_stretches(sample(spark, docs))) == want == {2: [[0, len(short)]], 3: [[0, len(docs[3])]]}


def test_few_runs_held_at_a_time(spark, documents):
    plain = {r["id"]: r["stretches"] for r in repeated_stretches(documents).collect()}
    assert {r["id"]: r["stretches"] for r in repeated_stretches(documents, held=7).collect()} == plain


def test_a_passage_in_most_rows_leaves_a_task_once(spark):
    own = spark.range(0, 3000, 1, 7).selectExpr("id AS doc_id", f"concat('Row ', id, ' is here. ', \"{PASSAGE}\", ' End of ', id, '.') AS text")
    met = spans(own, "doc_id", "text").filter("NOT later").groupBy("high", "low").count()
    assert met.agg({"count": "max"}).first()[0] == 7
    assert repeated_stretches(own).count() == 2999


def test_a_passage_in_most_rows_of_any_order(spark):
    own = spark.range(3000).selectExpr("id AS doc_id", f"concat('Row ', id, ' is here. ', \"{PASSAGE}\", ' End of ', id, '.') AS text")
    assert {r["id"] for r in repeated_stretches(own.repartition(7)).collect()} == {*range(1, 3000)}
