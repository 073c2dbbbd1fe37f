"""Joins and ordered scans that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.session import materialize, materialize_counted, stored_bytes

#: Rows per segment of an ordered scan over source positions, and most segments, whose cuts the driver holds.
CHUNK_ROWS = 65_536
MOST_CHUNKS = 10_000
#: A side with more rows than this, or more bytes as stored, is never broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20
#: Tasks that rows without a key are dealt over in a shuffled join.
NULL_SLOTS = 1024


def attach(
    big: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_rows: int | None = None,
    max_bytes: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Join ``side`` (at most one row per key) onto ``big``, which is read once.

    ``side`` is written out first, so its rows and bytes are known. Up to both limits (``BROADCAST_ROWS`` and
    ``BROADCAST_BYTES`` unless given) it is broadcast and
    ``big`` does not move. Beyond them one equi-join shuffles both sides: rows whose key is null match nothing
    and are dealt over all tasks, and partitions with a hot key are split by adaptive execution.
    """
    keys = list(keys)
    side, size = (side, side.count()) if stored else materialize_counted(side, "side")
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    if size <= max_rows and stored_bytes(side) <= (BROADCAST_BYTES if max_bytes is None else max_bytes):
        return big.join(F.broadcast(side), keys, how)
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    dealt = F.when(full, F.lit(0)).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(NULL_SLOTS))).cast("int")
    joined = big.withColumn("_dealt", dealt).join(side.withColumn("_dealt", F.lit(0)), [*keys, "_dealt"], how)
    return joined.drop("_dealt")


def first_rows(rows: DataFrame, n: int, out: str = "preview_idx", chunk_rows: int | None = None) -> DataFrame:
    """First ``n`` rows of each sheet with their 1-based place.

    Rows are counted per chunk of the source order (see ``chunked``); only chunks that begin before the
    ``n``-th row are ranked, each by itself, so a sheet of any length stays spread out.
    """
    cut = chunked(rows, "row_idx", chunk_rows or CHUNK_ROWS)
    sizes = cut.groupBy("sheet_id", "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("sheet_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    wanted = sizes.select("sheet_id", "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    kept = attach(cut, wanted.filter(F.col("_start") < n), ["sheet_id", "_chunk"], how="inner")
    inside = Window.partitionBy("sheet_id", "_chunk").orderBy("row_idx")
    placed = kept.withColumn(out, F.col("_start") + F.row_number().over(inside)).filter(F.col(out) <= n)
    return placed.select(*rows.columns, out)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """Dense 0-based position of each row inside its key, in ``order``; no key meets one task.

    A global range sort spreads even a single hot key over many partitions. The sorted rows are
    written with their partition-local index; only one count per (partition, key) is then summed.
    ``keys + order`` must identify a row for the result to be reproducible.
    """
    keys = list(keys)
    ordered = df.orderBy(*keys, *order).withColumn("_mid", F.monotonically_increasing_id())
    stored = materialize(ordered, "sorted").withColumn("_part", F.shiftright("_mid", 33))
    blocks = stored.groupBy(*keys, "_part").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *keys, "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    placed = attach(stored, starts, [*keys, "_part"], how="inner")
    return placed.withColumn(out, F.col("_start") + F.col("_mid") - F.col("_first")).drop(
        "_mid", "_part", "_first", "_start"
    )


def chunked(df: DataFrame, column: str, rows: int = CHUNK_ROWS, out: str = "_chunk") -> DataFrame:
    """Add an order preserving chunk number of a position, time or number, cut by rank and not by value.

    One aggregation sketches the order of all rows; the cuts leave about ``rows`` rows between them, or one in
    ``MOST_CHUNKS`` of all if that is more. Sparse and hashed positions make as few chunks as dense ones. Rows
    of one position stay together.
    """
    total = df.count()
    return equal_share_bucket(df, column, max(1, min(MOST_CHUNKS, -(-total // rows))), out)


def equal_share_bucket(df: DataFrame, column: str, buckets: int, out: str = "_bucket") -> DataFrame:
    """Add an order preserving bucket of a timestamp or number holding about 1/``buckets`` of all rows."""
    if buckets < 2:
        return df.withColumn(out, F.lit(0).cast("long"))
    as_double = ordering_double(df, column)
    cuts = df.select(
        F.percentile_approx(as_double, [i / buckets for i in range(1, buckets)], 4 * buckets)
    ).first()[0]
    edges = sorted(set(cuts or []))
    if not edges:
        return df.withColumn(out, F.lit(0).cast("long"))
    from pyspark.ml.feature import Bucketizer

    if len(edges) == 1:
        return df.withColumn(out, (as_double >= F.lit(edges[0])).cast("long"))
    splits = [float("-inf"), *edges, float("inf")]
    bucketed = Bucketizer(
        splits=splits, inputCol="_ord", outputCol=out, handleInvalid="keep"
    ).transform(df.withColumn("_ord", as_double))
    return bucketed.withColumn(out, F.col(out).cast("long")).drop("_ord")


def ordering_double(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind == "timestamp":
        return F.unix_micros(F.col(column)).cast("double")
    return F.col(column).cast("double")


def _carry(df: DataFrame, keys: list[str], bucket: str, partial: Column, combine) -> DataFrame:
    """One row per (key, bucket): what all earlier buckets of the key hand over."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, bucket)
        .agg(partial.alias("__scan_part"))
        .select(*keys, bucket, combine(F.col("__scan_part")).over(before).alias("__scan_carry"))
    )


def scan_last(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: Column,
    out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Last non-null ``value`` at or before each row (before it, if not ``inclusive``).

    Windows run inside (key, bucket); between buckets only one value per bucket travels.
    """
    keys = list(keys)
    marked = df.withColumn("__scan_value", value)
    last_of = F.max_by("__scan_value", F.when(F.col("__scan_value").isNotNull(), F.struct(*order)))
    carry = _carry(marked, keys, bucket, last_of, lambda c: F.last(c, ignorenulls=True))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = attach(marked, carry, [*keys, bucket])
    local = F.last("__scan_value", ignorenulls=True).over(inside)
    return joined.withColumn(out, F.coalesce(local, F.col("__scan_carry"))).drop("__scan_value", "__scan_carry")


def scan_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Running sum of ``value`` in ``order`` inside each key, same scheme as ``scan_last``."""
    keys = list(keys)
    marked = df.withColumn("__scan_value", value)
    carry = _carry(marked, keys, bucket, F.sum("__scan_value"), F.sum)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = attach(marked, carry, [*keys, bucket])
    total = F.coalesce(F.col("__scan_carry"), F.lit(0)) + F.sum("__scan_value").over(inside)
    return joined.withColumn(out, total).drop("__scan_value", "__scan_carry")
