"""Importance resampling towards a target: hashed n-gram features, log ratios as weights, Gumbel noise for the draw."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tabprep.llm.text import byte_blocks, packed
from tabprep.operators.scale import positions
from tabprep.session import materialize

#: Every ASCII byte but digits and small letters parts words; bytes of other characters are parts of words.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_SPACED = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
#: Features whose buckets a task remembers, and the longest of these in bytes.
_KNOWN, _KNOWN_BYTES = 200_000, 64


class _Buckets(dict):
    """Bucket of a feature: its unsigned CRC modulo the number of buckets. Frequent short features are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= _KNOWN_BYTES:
            if len(self) >= _KNOWN:
                self.clear()
            self[feature] = bucket
        return bucket


def spaced_words(text: bytes) -> bytes:
    """UTF-8 text with A-Z lower-cased and every run of separators as one blank, none at the ends."""
    return b" ".join(text.lower().translate(_SPACED).split())


def ngram_pattern(n: int) -> regex.Pattern:
    """Matches ``n`` whole consecutive words; an overlapped scan finds one match at each word that begins such a run."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def hashed_features(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shortest: int = 1, longest: int = 1, buckets: int = 10_000
) -> DataFrame:
    """``row, at, n_words, n_features, features``: the buckets of all runs of ``shortest`` to ``longest`` words of each text.

    ``row`` holds the ``keep`` columns (all by default), ``at`` numbers the rows and is the same if a task is run
    again, ``features`` holds little-endian unsigned 32-bit buckets, repeats included. Null and empty texts have
    no word and no feature.
    """
    patterns = [ngram_pattern(n).pattern for n in range(shortest, longest + 1)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans, bucket_of = [regex.compile(p) for p in patterns], _Buckets(buckets)
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, end, data, offsets in byte_blocks(batch.column(1)):
                n_words, n_features, features = [], [], []
                for low, high in zip(offsets[:-1], offsets[1:]):
                    line = spaced_words(data[low:high].tobytes())
                    found = [np.fromiter((bucket_of[m[0]] for m in p.finditer(line, overlapped=True)), "<u4") for p in scans]
                    n_words.append(line.count(b" ") + 1 if line else 0)
                    n_features.append(sum(map(len, found)))
                    features.append(b"".join(f.tobytes() for f in found))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first), pa.array(np.arange(at, at + end - first)),
                        pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(features, pa.binary()),
                    ],
                    names=schema.names,
                )
                at += end - first

    source = docs.select(packed(docs.columns if keep is None else keep), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([
        source.schema["row"], StructField("at", LongType()), StructField("n_words", LongType()), StructField("n_features", LongType()),
        StructField("features", BinaryType()),
    ])
    return source.mapInArrow(scan, schema)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows. A task hands over one row per bucket, the driver ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, _ in byte_blocks(batch.column(0).cast(pa.large_binary())):
                total += np.bincount(data.view("<u4"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    summed = features.select("features").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for r in summed.collect():
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's add-one smoothed share in the target and in the raw corpus, rounded down."""
    size, in_raw, in_target = len(raw), float(raw.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (in_raw + size) / ((s + 1.0) * (in_target + size)))) for s, t in zip(raw.tolist(), target.tolist())],
        np.int64,
    )


def importance_weights(
    docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", keep: list[str] | None = None,
    shortest: int = 1, longest: int = 1, buckets: int = 10_000,
) -> DataFrame:
    """``row, at, n_words, n_features, weight``: the sum of the gains of a document's features, stored in the shared folder.

    Texts are scanned once; their buckets are stored, counted over all documents and then weighed. What reaches the
    driver are the counts of the buckets. Repeated rows count and are weighed each. Without target texts all gains
    follow from the raw corpus alone; an empty table of documents gives an empty result.
    """
    scanned = materialize(hashed_features(docs, text_col, keep, shortest, longest, buckets), "features")
    in_target = hashed_features(target, target_col, [], shortest, longest, buckets)
    gains = bucket_gains(bucket_counts(scanned, buckets), bucket_counts(in_target, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in byte_blocks(batch.column(4).cast(pa.large_binary())):
                upto = np.concatenate(([0], np.cumsum(gains[data.view("<u4")])))
                block = batch.slice(first, end - first)
                weight = pa.array(upto[offsets[1:] // 4] - upto[offsets[:-1] // 4])
                yield pa.RecordBatch.from_arrays([*block.columns[:4], weight], names=schema.names)

    schema = StructType([*scanned.schema.fields[:4], StructField("weight", LongType())])
    return materialize(scanned.mapInArrow(weigh, schema), "weights")


def resample(weighted: DataFrame, id_col: str = "doc_id", percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Adds ``score`` and ``rank``: the weight with Gumbel noise, and the place among the drawn rows (null: not drawn).

    Of the N rows with at least ``least_words`` words the floor(``percent`` * N / 100) highest scores are drawn, which samples
    without replacement in proportion to the exponential weights. The noise is a hash of seed and identifier, so a
    draw can be repeated; a null identifier hashes as empty text and comes first among equal scores, equal identifiers
    follow in stored order. Ranks come from a range sort of the scores, in which no task holds more than its range.
    """
    drawn = weighted.filter(F.col("n_words") >= least_words).count() * percent // 100
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row").getField(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighted.withColumn("score", F.col("weight") + noise)
    keys = {"late": F.col("n_words") < least_words, "below": -F.col("score"), "id": F.col("row").getField(id_col)}
    placed = positions(scored.withColumns(keys), [], [*keys, "at"])
    rank = F.when(~F.col("late") & (F.col("pos") < drawn), F.col("pos") + 1)
    return placed.withColumn("rank", rank).drop(*keys, "pos")
