"""Quality scores by a factorisation machine: hashed words, structure statistics and metadata with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabprep.llm.text import byte_blocks, packed

#: Buckets of hashed words, and numbers per feature whose inner products weigh pairs of features.
WORD_BUCKETS = 1 << 13
RANK = 8
#: Labelled documents that the model is fitted on at most: those with the smallest hash of their identifier.
TRAIN_ROWS = 6_000
EPOCHS = 12
BATCH = 64
STEP = 0.01
DECAY = 1e-4

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CLASS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "wide": np.arange(256) >= 128,
    "stop": np.isin(np.arange(256), [33, 46, 63]),
    "comma": np.isin(np.arange(256), [44, 58, 59]),
    "odd": np.isin(np.arange(256), [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]),
    "mark": np.isin(np.arange(256), [33]),
    "line": np.isin(np.arange(256), [10]),
}
STRUCTURE = [*_CLASS, "log_bytes", "word_length", "distinct", "top_share", "repeats", "log_words", "log_chars"]
_PRIME = np.uint64(0x100000001B3)


_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n``, modulo 2^64."""
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


@dataclass(frozen=True)
class Features:
    """Documents of a block: sparse hashed words (sorted by document) and one dense row each."""

    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> Features:
    """Word frequencies (unit length per document) and structure statistics of every text of a block.

    Words are runs of bytes between white space. A word's hash is a difference of two prefix sums of a
    polynomial over the block, shifted to its start, so no word is looked at by itself.
    """
    n = len(offsets) - 1
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    starts = np.flatnonzero(solid & (edge[:-1] | ~before))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    ends = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
    size = np.diff(offsets).astype(np.float64)
    sums = np.zeros((n, len(_CLASS)))
    filled = np.flatnonzero(size)
    if len(filled):
        for k, members in enumerate(_CLASS.values()):
            sums[filled, k] = np.add.reduceat(members[data].astype(np.int32), offsets[filled])
    share = sums / np.maximum(size, 1)[:, None]
    word_row = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(word_row, minlength=n).astype(np.float64)
    if len(starts):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_PRIME, len(data))[:-1], dtype=np.uint64, out=total[1:])
        digest = (total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts]
        digest = (digest ^ (digest >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        word = (digest >> np.uint64(51)).astype(np.int64)
        same = np.concatenate(([False], (digest[1:] == digest[:-1]) & (word_row[1:] == word_row[:-1])))
        repeats = np.bincount(word_row[same], minlength=n) / np.maximum(words, 1)
        key, count = np.unique(word_row * WORD_BUCKETS + word, return_counts=True)
        row, bucket = key // WORD_BUCKETS, key % WORD_BUCKETS
        norm = np.sqrt(np.bincount(row, weights=count.astype(np.float64) ** 2, minlength=n))
        value = count / norm[row]
        distinct = np.bincount(row, minlength=n) / np.maximum(words, 1)
        top = np.zeros(n)
        np.maximum.at(top, row, count / words[row])
        lengths = np.bincount(word_row, weights=ends - starts, minlength=n) / np.maximum(words, 1)
    else:
        row = bucket = np.zeros(0, np.int64)
        value = np.zeros(0)
        repeats = distinct = top = lengths = np.zeros(n)
    dense = np.column_stack([
        share, np.log1p(size), lengths, distinct, top, repeats, np.log1p(words), np.log1p(np.maximum(chars, 0)),
    ])
    return Features(row, bucket, value.astype(np.float64), dense)


@dataclass(frozen=True)
class FactorisationMachine:
    """Bias, linear weights and factors: hashed words first, then the standardised structure statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, x: Features) -> np.ndarray:
        """All pairwise interactions in linear time: half the squared sum of factors less the sum of their squares."""
        n = len(x.dense)
        dense = np.clip((x.dense - self.mean) / self.scale, -5, 5)
        out = self.bias + dense @ self.linear[WORD_BUCKETS:]
        summed, squares = dense @ self.factors[WORD_BUCKETS:], dense**2 @ self.factors[WORD_BUCKETS:] ** 2
        rows, starts = np.unique(x.row, return_index=True)
        if len(rows):
            out[rows] += np.add.reduceat(x.value * self.linear[x.bucket], starts)
            scaled = x.value[:, None] * self.factors[x.bucket]
            summed[rows] += np.add.reduceat(scaled, starts, axis=0)
            squares[rows] += np.add.reduceat(scaled**2, starts, axis=0)
        return out + 0.5 * (summed**2 - squares).sum(axis=1) if n else out


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by Adam on mini-batches of (buckets, values, dense row) examples."""
    rng = np.random.default_rng(seed)
    dense = np.array([r[2] for r in rows]).reshape(len(rows), len(STRUCTURE))
    if not len(rows):
        width = WORD_BUCKETS + len(STRUCTURE)
        return FactorisationMachine(0.0, np.zeros(width), np.zeros((width, RANK)), np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE)))
    mean, scale = dense.mean(axis=0), dense.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    dense = np.clip((dense - mean) / scale, -5, 5)
    share = np.clip(labels.mean(), 0.01, 0.99)
    width = WORD_BUCKETS + dense.shape[1]
    theta = np.concatenate([np.zeros((width, 1)), rng.normal(0, 0.02, (width, RANK))], axis=1)
    bias, first, second, step = float(np.log(share / (1 - share))), np.zeros_like(theta), np.zeros_like(theta), 0
    fixed = np.arange(WORD_BUCKETS, width)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            owner = np.concatenate([np.concatenate([np.full(len(rows[i][0]) + len(fixed), k)]) for k, i in enumerate(batch)])
            column = np.concatenate([np.concatenate([rows[i][0], fixed]) for i in batch])
            x = np.concatenate([np.concatenate([rows[i][1], dense[i]]) for i in batch])
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            used = theta[column]
            scaled = x[:, None] * used[:, 1:]
            summed = np.add.reduceat(scaled, starts, axis=0)
            logit = bias + np.add.reduceat(x * used[:, 0], starts)
            logit += 0.5 * (summed**2 - np.add.reduceat(scaled**2, starts, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]) / len(batch)
            pull = (error[owner] * x)[:, None]
            slope = np.concatenate([pull, pull * (summed[owner] - scaled)], axis=1)
            places, where = np.unique(column, return_inverse=True)
            gradient = np.zeros((len(places), theta.shape[1]))
            for k in range(theta.shape[1]):
                gradient[:, k] = np.bincount(where, weights=slope[:, k], minlength=len(places))
            gradient += DECAY * theta[places]
            step += 1
            first[places] = 0.9 * first[places] + 0.1 * gradient
            second[places] = 0.999 * second[places] + 0.001 * gradient**2
            theta[places] -= STEP * (first[places] / (1 - 0.9**step)) / (np.sqrt(second[places] / (1 - 0.999**step)) + 1e-8)
            bias -= STEP * float(error.sum())
    return FactorisationMachine(bias, theta[:, 0].copy(), theta[:, 1:].copy(), mean, scale)


def _source(docs: DataFrame, kept: list[str], text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(packed(kept), text.alias("text"), F.coalesce(F.length(text), F.lit(0)).cast("double").alias("chars"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          train_rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on at most ``train_rows`` labelled documents, the ones with the smallest hash of their identifier.

    The choice is made on the small label table and broadcast, so the documents are filtered where they are;
    only features of chosen documents come back. Rows without identifier, label or text teach nothing.
    """
    wanted = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).dropna()
    wanted = wanted.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    found = _source(docs.filter(F.col(f"`{text_col}`").isNotNull()), [id_col], text_col)
    chosen = found.join(F.broadcast(wanted), found[f"row.{id_col}"] == wanted["id"]).select("text", "chars", "y", "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_blocks(batch.column(0)):
                x = features(data, offsets, batch.column(1).slice(first, last - first).to_numpy())
                cuts = np.searchsorted(x.row, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(3).slice(first, last - first),
                        batch.column(2).slice(first, last - first),
                        pa.array([x.bucket[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int32())),
                        pa.array([x.value[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.float32())),
                        pa.array(list(x.dense), pa.list_(pa.float64())),
                    ],
                    names=["id", "y", "bucket", "value", "dense"],
                )

    schema = chosen.select("id", "y", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("bucket", "array<int>"), ("value", "array<float>"), ("dense", "array<double>"))]).schema
    table = chosen.mapInArrow(extract, schema).dropDuplicates(["id"]).toArrow().sort_by("id")
    rows = [
        (np.asarray(b, np.int64), np.asarray(v, np.float64), np.asarray(d))
        for b, v, d in zip(table["bucket"].to_pylist(), table["value"].to_pylist(), table["dense"].to_pylist())
    ]
    return fit_rows(rows, table["y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) as struct ``row``, and ``score``, the probability of label 1.

    Only the text and its length are read. Null text scores like empty text: no words, all statistics zero.
    One narrow pass; a task holds one block of text.
    """
    source = _source(docs, docs.columns if keep is None else keep, text_col)
    schema = StructType([source.schema["row"]]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_blocks(batch.column(1)):
                x = features(data, offsets, batch.column(2).slice(first, last - first).to_numpy())
                p = 1 / (1 + np.exp(-np.clip(model.logits(x), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(p)], names=schema.names)

    return source.mapInArrow(run, schema)
