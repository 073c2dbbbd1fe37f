"""Repeated passages: every run of several consecutive sentences is hashed, and all but its first place is removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.text import byte_blocks, packed
from tabprep.session import materialize

#: Sentences that a run has at least, and words that it takes further sentences to reach.
RUN = 3
LEAST_WORDS = 15
#: Runs that a task compares among each other.
HELD_RUNS = 200_000
#: A sentence ends at a stop and at a line's end. One of more words than this is cut.
LONG_SENTENCE = 20
#: Of so many consecutive words of a long sentence, at least one ends a piece of it.
CUT_WINDOW = 8

#: Full stops, question and exclamation marks of Latin, Greek, CJK, Arabic, Indic, Armenian, Ethiopic, Burmese, Khmer, Tibetan and Mongolian.
_STOPS = ".!?\u2026\u203c\u2047\u2048\u2049\u3002\uff0e\uff61\uff01\uff1f\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u1368\u104b\u17d4\u17d5\u0f0d\u0f0e\u1803\u1809"
_FRAGMENT = re.compile(rf"(?:[^\s{_STOPS}][^{_STOPS}\n]*[{_STOPS}]*|[{_STOPS}]+)")
#: Letters of scripts that put no blanks between words (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han); each counts as a word.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_SPACED = re.compile(r"\S+")
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))


def _cuts(words: list[str]) -> list[int]:
    """Ends of the pieces of a long sentence: after each word whose hash (with the word before) is the last smallest of
    some ``CUT_WINDOW`` consecutive ones. Whether a cut stands depends on no word further away than that."""
    hashes = [_word_hash(word) for word in words]
    # of equal hashes the later one is smaller
    values = [((x * 0x9E3779B1 ^ y * 0x85EBCA6B) & 0xFFFFFFFF) << 32 | 0xFFFFFFFF - i for i, (x, y) in enumerate(zip([0, *hashes], hashes))]
    out, least = [], -1
    for end in range(CUT_WINDOW, len(words) + 1):
        if least < end - CUT_WINDOW:
            least = values.index(min(values[end - CUT_WINDOW : end]), end - CUT_WINDOW)
        elif values[end - 1] < values[least]:
            least = end - 1
        if not out or out[-1] != least + 1:
            out.append(least + 1)
    return out if out[-1] == len(words) else [*out, len(words)]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of the sentences; together they cover all of the text but white space.

    Each stretch up to a stop or line's end is one, however short; pieces of one over ``LONG_SENTENCE`` words stand for it.
    """
    out: list[tuple[int, int, list[str]]] = []
    unspaced = _ANY_UNSPACED.search(text) is not None
    for found in _FRAGMENT.finditer(text):
        part = found[0]
        words = _TOKEN.findall(part.lower()) if unspaced else part.lower().split()
        first, last = found.span()
        if len(words) > LONG_SENTENCE:
            tokens = list(_TOKEN.finditer(part)) if unspaced else list(_SPACED.finditer(part))
            words = [token[0].lower() for token in tokens]
            begin = 0
            for end in _cuts(words):
                out.append((first + tokens[begin].start(), first + tokens[end - 1].end(), words[begin:end]))
                begin = end
        else:
            out.append((first, last - len(part) + len(part.rstrip()) if part[-1].isspace() else last, words))
    return out


def _runs(text: str, size: int, least: int) -> Iterator[tuple[bytes, int, int]]:
    """(128-bit hash, start, end) of the runs: from each sentence on, and up to each sentence, the fewest sentences
    that are ``size`` at least and have ``least`` words. So each sentence of a passage that long is in a run inside it.
    A text of ``size`` sentences or more but fewer words is one run."""
    found = sentences(text)
    digests = b"".join(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")) for _, _, words in found)
    before = [0, *accumulate(len(words) for _, _, words in found)]
    n, j, i, places = len(found), 0, 0, set()
    for start in range(n):
        j = max(j, start + size)
        while j <= n and before[j] - before[start] < least:
            j += 1
        if j > n:
            break
        places.add((start, j))
    for end in range(size, n + 1):
        while i + 1 <= end - size and before[end] - before[i + 1] >= least:
            i += 1
        if before[end] - before[i] >= least:
            places.add((i, end))
    if size <= n and before[n] < least:
        places.add((0, n))
    for start, end in sorted(places):
        yield xxhash.xxh3_128_digest(digests[16 * start : 16 * end]), found[start][0], found[end - 1][1]


class _Seen:
    """Runs of a number of rows, and which of them are not the first place of theirs among these rows."""

    def __init__(self) -> None:
        self.rows, self.keys, self.owner, self.start, self.end = [], [], [], [], []

    def add(self, identifier, uid: int, runs: Iterator[tuple[bytes, int, int]]) -> None:
        before = len(self.keys)
        for key, a, b in runs:
            self.keys.append(key)
            self.start.append(a)
            self.end.append(b)
        self.owner += [len(self.rows)] * (len(self.keys) - before)
        self.rows.append((identifier is None, identifier, uid))

    def columns(self, kind: pa.DataType) -> list[pa.Array]:
        """high, low, later, identifier, row, start, end; a later place has its row and start for a hash, which spreads such rows."""
        high, low = np.frombuffer(b"".join(self.keys), "<i8").reshape(-1, 2).T
        owner, start = np.array(self.owner, np.int64), np.array(self.start, np.int64)
        uid = np.array([row[2] for row in self.rows], np.int64)[owner]
        rank = np.empty(len(self.rows), np.int64)
        rank[sorted(range(len(self.rows)), key=self.rows.__getitem__)] = np.arange(len(self.rows))
        order = np.lexsort((start, rank[owner], low, high))
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        later = np.zeros(len(order), bool)
        later[order[1:]] = same
        ids = pa.array([row[1] for row in self.rows], kind).take(pa.array(owner))
        return [
            pa.array(np.where(later, uid, high)), pa.array(np.where(later, start, low)), pa.array(later), ids, pa.array(uid),
            pa.array(start, pa.int32()), pa.array(self.end, pa.int32()),
        ]


def spans(
    docs: DataFrame, id_col: str, text_col: str, size: int = RUN, least: int = LEAST_WORDS, row_col: str | None = None, held: int = HELD_RUNS
) -> DataFrame:
    """``high, low, later, id, uid, start, end``: one row per run, with its 128-bit hash; ``uid`` numbers the rows of ``docs``.

    A task compares the places of the same run among about ``held`` runs; all but the first of them are ``later`` ones and
    no longer need the run's hash (they carry ``uid`` and ``start`` instead). So a run in most documents
    leaves a task a few times only, as with partial aggregation.
    """
    text = F.col(f"`{text_col}`").cast("string")
    number = F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), number.cast("bigint").alias("uid"), text.alias("text")).filter("text is not null")
    kinds = {"start": "int", "end": "int"}
    schema = source.select(
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("high", "bigint"), ("low", "bigint"), ("later", "boolean"))],
        "id", "uid", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()],
    ).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            kind = batch.column(0).type
            for begin, last, _, _ in byte_blocks(batch.column(2)):
                for i, uid, value in zip(*[c.to_pylist() for c in batch.slice(begin, last - begin).columns]):
                    seen.add(i, uid, _runs(value, size, least))
                    if len(seen.keys) >= held:
                        yield pa.RecordBatch.from_arrays(seen.columns(kind), names=schema.names)
                        seen = _Seen()
        if seen.keys:
            yield pa.RecordBatch.from_arrays(seen.columns(kind), names=schema.names)

    return source.mapInArrow(cut, schema)


def _merged(stretches: Column) -> Column:
    """Sorted stretches ``start, end`` with those that touch or overlap made one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), longer)
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(stretches), empty, add)


def repeated_stretches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = RUN, least: int = LEAST_WORDS, row_col: str | None = None,
    held: int = HELD_RUNS,
) -> DataFrame:
    """``id, uid, stretches``: for each row that repeats others, the character ranges to remove.

    A run is as many consecutive sentences as it takes to have ``size`` of them and ``least`` words; a whole text of
    fewer words is a run. It is repeated if it stands at more than one place of all rows, compared in lower case with white
    space read as one blank. Its first place is the earliest one in the row with the smallest identifier (rows without
    one come last, of rows that share one the first by ``uid``); the sentences of every other place are removed. ``uid`` is
    ``row_col``, which must number the rows, or a number made here. Null texts have no sentence.

    Texts are cut into runs once. All but the first place that a task sees of a run are settled there (see ``spans``), so
    a passage in a third of all documents is a few rows per task. The others meet by their hash in one shuffle, in which
    every place but the first is a repeat. Only ranges of one row are ever collected together.
    """
    runs = spans(docs, id_col, text_col, size, least, row_col, held)
    order = Window.partitionBy("high", "low", "later").orderBy(F.col("id").isNull(), "id", "uid", "start")
    repeats = runs.withColumn("_place", F.row_number().over(order)).filter("later OR _place > 1")
    ranges = repeats.groupBy("uid").agg(F.first("id").alias("id"), F.collect_set(F.struct("start", "end")).alias("all"))
    return ranges.select("id", "uid", _merged(F.col("all")).alias("stretches"))


def without_stretches(text: Column, stretches: Column) -> Column:
    """``text`` without the given sorted character ranges."""
    begins = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda s: s["end"]))
    ends = F.concat(F.transform(stretches, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(begins, ends, lambda a, b: F.substr(text, a + 1, b - a)), "")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All documents with their columns, repeated sentences cut out of the text. The rows are numbered and stored first."""
    text = F.col(f"`{text_col}`").cast("string")
    whole = docs.select(packed(docs.columns), F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("uid"))
    whole = materialize(whole, "numbered")
    found = repeated_stretches(whole, "id", "text", row_col="uid", **options).select("uid", "stretches")
    joined = whole.join(found, "uid", "left")
    cut = F.when(F.col("stretches").isNull(), F.col("text")).otherwise(without_stretches(F.col("text"), F.col("stretches")))
    return joined.select(*[cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
