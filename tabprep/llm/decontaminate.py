"""Benchmark passages in documents: exact hits of item pieces, verified by bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from tabprep.llm.text import byte_blocks, packed
from tabprep.session import materialize

#: Edits allowed, as a share of an item's normalised characters.
ERROR_RATE = 0.08
#: Items with fewer normalised characters have to occur exactly, as whole words.
LEAST_CHARS = 30
#: Items are searched for in blocks of at most this many normalised characters: the bound of what is sent to tasks.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> str:
    """Lower case, letters and digits only, single blanks between words."""
    return " ".join(_WORD.findall(text.lower()))


#: Letters of scripts that put no blanks between words (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han).
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no word goes on beyond ``text[start:end]``; letters of unspaced scripts are words of their own."""

    def border(at: int) -> bool:
        if at == 0 or at == len(text) or text[at - 1] == " " or text[at] == " ":
            return True
        return bool(_UNSPACED.match(text[at - 1]) or _UNSPACED.match(text[at]))

    return border(start) and border(end)


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``item`` in ``errors + 1`` consecutive pieces of nearly equal length: that many edits leave one untouched."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item as bit masks, one integer of its length per character (Myers' column vectors)."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best_end(self, text: str) -> tuple[int, int]:
        """Smallest edit distance of the item to any stretch of ``text``, and where the first such stretch ends."""
        full, last = (1 << self.length) - 1, 1 << (self.length - 1)
        up, down, score = full, 0, self.length
        best, end = score, 0
        for at, c in enumerate(text, 1):
            match = self.masks.get(c, 0)
            vertical = match | down
            diagonal = ((match & up) + up ^ up) | match
            rise = down | full & ~(diagonal | up)
            fall = up & diagonal
            if rise & last:
                score += 1
            elif fall & last:
                score -= 1
            rise = rise << 1 & full  # the text may begin anywhere: no cost above the first row
            fall = fall << 1 & full
            up = fall | full & ~(vertical | rise)
            down = rise & vertical
            if score < best:
                best, end = score, at
        return best, end


def _windows(hits: list[tuple[int, int]], length: int, errors: int) -> Iterator[tuple[int, int]]:
    """Stretches of text that hold every match behind the given (text position, piece offset) hits, merged."""
    low = high = None
    for start in sorted({at - offset for at, offset in hits}):
        a, b = max(0, start - errors), start + length + errors
        if high is not None and a <= high:
            high = b
            continue
        if high is not None:
            yield low, high
        low, high = a, b
    if high is not None:
        yield low, high


def _matcher(items: list[tuple], rate: float):
    import ahocorasick

    found_at: dict[str, list[tuple[int, int]]] = {}
    patterns, errors = [], []
    for number, (_, item) in enumerate(items):
        k = budget(len(item), rate) if len(item) >= LEAST_CHARS else 0
        errors.append(k)
        patterns.append(Pattern(item))
        for offset, piece in pieces(item, k):
            found_at.setdefault(piece, []).append((number, offset))
    automaton = ahocorasick.Automaton()
    for piece, places in found_at.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()

    def matches(text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, distance, budget, end) of the closest match of each item."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in automaton.iter(text):
            for number, offset in places:
                if patterns[number].length < LEAST_CHARS:
                    if number in hits or not _stands_alone(text, end + 1 - length, end + 1):
                        continue
                hits.setdefault(number, []).append((end + 1 - length, offset))
        for number, at in hits.items():
            pattern, k = patterns[number], errors[number]
            closest = None
            for low, high in _windows(at, pattern.length, k):
                distance, end = pattern.best_end(text[low:high])
                if distance <= k and (closest is None or distance < closest[0]):
                    closest = distance, low + end
            if closest:
                yield number, closest[0], k, closest[1]

    return matches


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """Items with a letter or digit, equal ones once (smallest identifier), in blocks of at most ``limit`` characters."""
    block, size = [], 0
    ids = F.col(f"`{id_col}`")
    rows = benchmark.select(ids.alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna()
    for row in rows.groupBy("text").agg(F.min("item").alias("item")).orderBy("item", "text").toLocalIterator():
        item = normalised(row["text"])
        if not item:
            continue
        if block and size + len(item) > limit:
            yield block
            block, size = [], 0
        block.append((row["item"], item))
        size += len(item)
    if block:
        yield block


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, carry: list[str] | None = None,
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``row`` (struct of ``carry``, all columns by
    default), ``item_id, distance, budget, end``.

    Texts are compared in lower case with anything but letters and digits read as one blank. A document holds
    an item if some stretch of it is within ``budget = rate * length`` edits of the whole item. The item is cut
    into ``budget + 1`` pieces, of which an unharmed one must occur exactly; one automaton finds the pieces of
    all items in one pass over a text, and Myers' bit vectors verify the surroundings of each hit. ``end`` is
    where the closest stretch ends in the normalised text.

    An item under ``LEAST_CHARS`` normalised characters has no budget and must stand as whole words. Null texts and
    identifiers of items, and items without a letter or digit, match nothing; equal items count once, under the smallest identifier. Documents do not move; items reach the tasks in
    blocks of bounded size, one pass over the documents for each. ``item_id`` keeps its type. No documents or no items: no rows.
    """
    kept = docs.columns if carry is None else carry
    source = docs.select(packed(kept), F.col(f"`{doc_text}`").cast("string").alias("text"))
    item_type = benchmark.schema[item_id].dataType
    schema = StructType([
        source.schema["row"], StructField("item_id", item_type), StructField("distance", LongType()),
        StructField("budget", LongType()), StructField("end", LongType()),
    ])

    kinds = [to_arrow_type(item_type), pa.int64(), pa.int64(), pa.int64()]

    def search(block: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matches = _matcher(block, rate)
            for batch in batches:
                for first, last, _, _ in byte_blocks(batch.column(1)):
                    owner, found = [], []
                    for i, text in enumerate(batch.column(1).slice(first, last - first).to_pylist(), first):
                        for number, *what in matches(normalised(text or "")):
                            owner.append(i)
                            found.append((block[number][0], *what))
                    if found:
                        columns = [pa.array(c, kind) for c, kind in zip(zip(*found), kinds)]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=schema.names
                        )

        return run

    found = None
    blocks = _item_blocks(benchmark, item_id, item_text, block_chars)
    block = next(blocks, None)
    while block is not None:
        part, block = source.mapInArrow(search(block), schema), next(blocks, None)
        if found is None and block is None:
            return part
        # what each of several blocks finds is stored, so that the driver holds two blocks at most
        part = materialize(part, "leaks")
        found = part if found is None else found.unionByName(part)
    return source.sparkSession.createDataFrame([], schema) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with their columns; see ``find_leaks``."""
    rate, limit = options.get("rate", ERROR_RATE), options.get("block_chars", BLOCK_CHARS)
    kept = docs
    for block in _item_blocks(benchmark, options.get("item_id", "item_id"), options.get("item_text", "text"), limit):
        kept = _without(kept, F.col(f"`{options.get('doc_text', 'text')}`"), block, rate)
    return kept


def _without(docs: DataFrame, text: Column, block: list[tuple], rate: float) -> DataFrame:
    source = docs.select(packed(docs.columns), text.cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _matcher(block, rate)
        for batch in batches:
            for first, last, _, _ in byte_blocks(batch.column(1)):
                texts = batch.column(1).slice(first, last - first).to_pylist()
                clean = [next(matches(normalised(text or "")), None) is None for text in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).filter(pa.array(clean))], names=["row"])

    return source.mapInArrow(run, StructType([source.schema["row"]])).select("row.*")
