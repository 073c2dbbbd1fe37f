"""SimHash near duplicates: 64-bit fingerprints at most 3 bits apart, found through deletion-variant signatures.

Cut into two halves, one half of a linked pair differs by at most one bit. Every half is indexed once per bit
with that bit as a wildcard, so linked fingerprints share a variant: an equality that Spark can shuffle on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tabprep.llm.components import components
from tabprep.llm.text import BLOCK_BYTES, byte_blocks, packed
from tabprep.session import materialize

MOST_BITS = 3
SEED = 42
SHINGLE_WORDS = 3
#: Variants with more fingerprints than this are cut again by the other half.
FULL_VARIANT = 4096
#: Runs up to this length compare all their pairs in one vectorised sweep.
_SHORT_RUN = 16


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Bitwise majority over the XXH64 of every word shingle, repeats included; zero if there is no word."""
    words = text.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(source: DataFrame) -> DataFrame:
    """The columns of ``source`` with ``text`` replaced by ``fp``, the fingerprint as a signed 64-bit integer."""
    others = [f for f in source.schema.fields if f.name != "text"]
    schema = StructType(others + [StructType().add("fp", LongType())["fp"]])
    place = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_blocks(batch.column(place), BLOCK_BYTES):
                raw, cuts = data.tobytes(), offsets.tolist()
                found = np.array([fingerprint(raw[a:b]) for a, b in zip(cuts, cuts[1:])], np.uint64)
                kept = [c.slice(first, last - first) for i, c in enumerate(batch.columns) if i != place]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], names=schema.names)

    return source.mapInArrow(run, schema)


def _half(side: int) -> Column:
    return F.shiftrightunsigned("fp", 32) if side else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


def _wildcards(part: Column, bits: int) -> Column:
    """``part`` once per bit, that bit cleared and its number placed above the part."""
    return F.array(*[part.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << i))).bitwiseOR(F.lit(i << bits)) for i in range(bits)])


def _half_variants(half: Column, side: int) -> Column:
    return F.transform(_wildcards(half, 32), lambda v: v.bitwiseOR(F.lit(side << 37)))


def _finer(rows: DataFrame) -> DataFrame:
    """Rows of full variants, cut by the other half: 16 bits with one wildcard, then 8 of the other 16 likewise.

    At most 3 bits differ there, so one of two parts differs by at most one, twice over. What is left free are
    11 bits, hence no finer variant holds more than 2048 fingerprints.
    """
    other = F.when(F.shiftright("key", 37) == 1, _half(0)).otherwise(_half(1))
    low, high = other.bitwiseAND(F.lit(0xFFFF)), F.shiftright(other, 16)

    def eighths(part: Column) -> Column:
        lower, upper = part.bitwiseAND(F.lit(0xFF)), F.shiftright(part, 8)
        return F.concat(_wildcards(lower, 8), F.transform(_wildcards(upper, 8), lambda v: v.bitwiseOR(F.lit(1 << 11))))

    cut = rows.select(
        "key", "fp",
        F.explode(F.array(
            F.struct(_wildcards(low, 16).alias("a"), eighths(high).alias("b"), F.lit(0).alias("t")),
            F.struct(_wildcards(high, 16).alias("a"), eighths(low).alias("b"), F.lit(1).alias("t")),
        )).alias("p"),
    )
    return (
        cut.select("key", "fp", "p.t", F.explode("p.a").alias("a"), F.col("p.b").alias("b"))
        .select("key", "fp", "t", "a", F.explode("b").alias("b"))
        .select(F.xxhash64("key", "t", "a", "b").alias("key"), "fp")
    )


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST_BITS


def _spanning(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links from every fingerprint of one variant to the smallest it reaches inside the variant."""
    left, right = [], []
    waiting = fp
    while len(waiting) > 1:
        group, front, waiting = [waiting[:1]], [waiting[0]], waiting[1:]
        while front and len(waiting):
            hit = _near(waiting, front.pop())
            if hit.any():
                found, waiting = waiting[hit], waiting[~hit]
                group.append(found)
                front.extend(found)
        if len(group) > 1:
            members = np.concatenate(group)
            least = members.view(np.int64).min()
            left.append(members.view(np.int64))
            right.append(np.full(len(members), least))
    return left, right


def link_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the variants of rows ``(key, fp)`` sorted by ``key, fp``; one variant is held at a time."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        left, right = [], []
        short = np.repeat(sizes <= _SHORT_RUN, sizes)
        for lag in range(1, min(_SHORT_RUN, int(sizes.max()))):
            at = np.flatnonzero(short[:-lag] & (key[:-lag] == key[lag:]))
            at = at[_near(fp[at], fp[at + lag])]
            left.append(fp[at + lag].view(np.int64))
            right.append(fp[at].view(np.int64))
        for i in np.flatnonzero(sizes > _SHORT_RUN):
            a, b = _spanning(fp[starts[i] : starts[i] + sizes[i]])
            left += a
            right += b
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy()))
        fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if whole:
            yield links(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
    if len(key):
        yield links(key, fp)


def near_links(distinct: DataFrame, full_variant: int = FULL_VARIANT) -> DataFrame:
    """Links ``(u, v)`` that connect all of the distinct fingerprints ``fp`` within ``MOST_BITS`` of each other.

    Variants that may hold more than ``full_variant`` fingerprints are told from the counts of whole halves;
    their rows are cut finer, so no task compares an unbounded group, and no pair is left out.
    """
    sides = F.array(F.struct(F.lit(0).alias("side"), _half(0).alias("half")), F.struct(F.lit(1).alias("side"), _half(1).alias("half")))
    crowded = (
        distinct.select(F.explode(sides).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > full_variant // 2).select("h.side", "h.half")
    )
    full_keys = materialize(
        crowded.select(F.explode(
            F.when(F.col("side") == 0, _half_variants(F.col("half"), 0)).otherwise(_half_variants(F.col("half"), 1))
        ).alias("key")).distinct(), "full-variants",
    )
    rows = distinct.select(F.explode(F.concat(_half_variants(_half(0), 0), _half_variants(_half(1), 1))).alias("key"), "fp")
    if full_keys.isEmpty():
        return _linked(rows)
    usual = rows.join(full_keys, "key", "left_anti")
    return _linked(usual).unionByName(_linked(_finer(rows.join(full_keys, "key")).distinct()))


def _linked(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link_variants, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                full_variant: int = FULL_VARIANT) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, representative`` and ``row``, a struct of ``carry``.

    ``component_id`` is the smallest identifier that is reachable over links, the document's own included.
    Null text has no word; documents without words share fingerprint zero, which links like any other. Null
    identifiers come after all others. Exactly one document of a component is its representative: the one
    with the smallest identifier, of repeated ones the first row. Copies meet as one fingerprint and are
    never paired. An empty table gives no rows.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), packed(carry or [id_col]),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    stored = materialize(fingerprints(source), "fingerprints")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("best")
    distinct = materialize(stored.groupBy("fp").agg(best), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), full_variant))
    rooted = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "best", F.coalesce("v", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("best").alias("best"))
    known = materialize(rooted.select("fp", "root").join(of_root, "root").select("fp", "best"), "fingerprint-groups")
    return stored.join(known, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"),
        (F.col("uid") == F.col("best.uid")).alias("representative"),
        "row",
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with its columns."""
    return near_groups(docs, carry=docs.columns).filter("representative").select("row.*")
