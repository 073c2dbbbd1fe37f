"""Language mixtures: expectation-maximisation over n-gram likelihoods, with a penalised choice of languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.text import byte_blocks

#: Hash buckets of byte trigrams. A model has this many numbers per language, whatever the corpus.
BUCKETS = 1 << 15
SMOOTHING = 0.5
EM_ROUNDS = 8
#: Times the usual log(words) / 2 that each further language has to gain in log-likelihood.
PENALTY = 2.0
UNDECIDED = "und"

#: A-Z lower-cased; bytes of other letters (all of UTF-8 beyond ASCII) kept; anything else is a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: log probability of each trigram bucket, one column per language
    log_p: np.ndarray


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters flag and the bucket of the trigram around each byte; blanks stand beyond both ends of a text."""
    folded = _FOLD[data].astype(np.uint32)
    before, after = np.roll(folded, 1), np.roll(folded, -1)
    filled = np.flatnonzero(np.diff(offsets))
    before[offsets[filled]] = 32
    after[offsets[filled + 1] - 1] = 32
    code = before << 16 | folded << 8 | after
    return folded != 32, (code * np.uint32(2654435761)) >> np.uint32(17)


def fit(docs: DataFrame, text: Column, lang: Column) -> LanguageModel:
    """Count the trigrams of every given document by language. Rows without text or language teach nothing.

    Each task keeps one table of languages x ``BUCKETS`` counts and hands it over summed; Spark adds the tables up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang = batch.column(1).dictionary_encode()
            names = by_lang.dictionary.to_pylist()
            numbers = by_lang.indices.to_numpy(zero_copy_only=False)
            for first, last, data, offsets in byte_blocks(batch.column(0)):
                letter, bucket = _trigrams(data, offsets)
                owner = np.repeat(numbers[first:last], np.diff(offsets))[letter].astype(np.int64)
                counts = np.bincount(owner * BUCKETS + bucket[letter], minlength=len(names) * BUCKETS)
                for name, row in zip(names, counts.reshape(len(names), BUCKETS)):
                    totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(row[seen], pa.int64())], names=["lang", "bucket", "n"]
            )

    known = docs.select(text.cast("string").alias("text"), lang.cast("string").alias("lang")).dropna()
    table = (
        known.mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = np.array(table["lang"].to_pylist(), dtype=object)
    languages = sorted(set(names))
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    column = {name: i for i, name in enumerate(languages)}
    counts[table["bucket"].to_numpy(), [column[name] for name in names]] += table["n"].to_numpy()
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32))


def _mixtures(words: np.ndarray, starts: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions and log-likelihood for each, given word likelihoods per language."""
    share = np.full((len(starts), words.shape[1]), 1.0 / words.shape[1])
    owner = np.repeat(np.arange(len(starts)), n)
    for _ in range(rounds):
        joint = words * share[owner]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, starts, axis=0) / n[:, None]
    fit = np.add.reduceat(np.log((words * share[owner]).sum(axis=1)), starts)
    return share, fit


def infer(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the selected languages (others zero) for each text of a block, and whether it has words."""
    n_langs = len(model.languages)
    out = np.zeros((len(offsets) - 1, n_langs))
    letter, bucket = _trigrams(data, offsets)
    bounds = np.zeros(len(data) + 1, bool)
    bounds[offsets] = True
    # a word ends with its text, even if the next text goes on with a letter
    first = np.flatnonzero(letter & (bounds[:-1] | np.concatenate(([True], ~letter[:-1]))))
    if not len(first) or not n_langs:
        return out, np.zeros(len(out), bool)
    scores = np.where(letter[:, None], model.log_p[bucket], np.float32(0))
    word = np.add.reduceat(scores, first, axis=0)
    word = np.exp(word - word.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    text_of = np.searchsorted(offsets, first, side="right") - 1
    texts, starts, n = np.unique(text_of, return_index=True, return_counts=True)
    owner = np.repeat(np.arange(len(texts)), n)
    share, fit_all = _mixtures(word, starts, n, EM_ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    # no mixture of any languages fits better than this: the log-likelihood is concave in the proportions
    slope = np.add.reduceat(word / (word * share[owner]).sum(axis=1, keepdims=True), starts, axis=0) / n[:, None]
    bound = fit_all + n * np.log(slope.max(axis=1))
    best, best_score = np.zeros_like(share), np.full(len(texts), -np.inf)
    for size in range(1, n_langs + 1):
        penalty = PENALTY * size * np.log(n + 1.0) / 2
        open_ = np.flatnonzero(bound - penalty > best_score)
        if not len(open_):
            break
        chosen, counts = order[open_, :size], n[open_]
        inside = np.isin(owner, open_)
        picked = np.take_along_axis(word[inside], np.repeat(chosen, counts, axis=0), axis=1)
        shares, fits = _mixtures(picked, np.cumsum(counts) - counts, counts, EM_ROUNDS if size > 1 else 1)
        score = fits - penalty[open_]
        better = score > best_score[open_]
        best_score[open_[better]] = score[better]
        mixed = np.zeros((len(open_), n_langs))
        np.put_along_axis(mixed, chosen, shares, axis=1)
        best[open_[better]] = mixed[better]
    out[texts] = best
    has_words = np.zeros(len(out), bool)
    has_words[texts] = True
    return out, has_words


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) as struct ``row``, and ``lang_pred, score, mixture`` for each document.

    ``mixture`` lists the selected languages with their proportions of words, the largest first; ``lang_pred``
    is its first and ``score`` that proportion. Each word (a run of letters) counts as a draw from one language,
    with the likelihood of its trigrams; EM finds the proportions, and the set of the one, two, ... or all
    languages of largest proportion with the best log-likelihood less a penalty per language is chosen. Ties go to the language
    that sorts first. Null text, text without a letter and an empty model give ``und`` with score 0 and an
    empty mixture. Rows stay where they are; the model (languages x ``BUCKETS`` numbers) goes to each task.
    """
    kept = docs.columns if keep is None else keep
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.when(text.rlike(r"\p{L}"), text).alias("text")
    )
    names = np.array(model.languages, dtype=object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_blocks(batch.column(1)):
                shares, known = infer(model, data, offsets)
                mixture = []
                for share in shares:
                    order = sorted(np.flatnonzero(share), key=lambda i, s=share: -s[i])
                    mixture.append([{"lang": names[i], "share": min(1.0, float(share[i]))} for i in order])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([m[0]["lang"] if k else UNDECIDED for m, k in zip(mixture, known)], pa.string()),
                        pa.array([m[0]["share"] if k else 0.0 for m, k in zip(mixture, known)], pa.float64()),
                        pa.array(mixture, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                    ],
                    names=["row", "lang_pred", "score", "mixture"],
                )

    added = {"lang_pred": "string", "score": "double", "mixture": "array<struct<lang:string,share:double>>"}
    out = source.select("row", *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()]).schema
    return source.mapInArrow(predict, out)
