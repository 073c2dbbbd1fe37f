"""Packing token ids: every document is cut into pieces of power-of-two length, so no sequence crosses documents."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tabprep.llm.text import BLOCK_BYTES, byte_blocks

END_OF_DOCUMENT = 1
#: Two white-space characters together are the only place where the vocabulary's pattern looks ahead.
_DOUBLE_SPACE = re.compile(r"\s\s")
_LOOK_AHEAD = r"\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> Callable[[str], bytes]:
    """Text to little-endian 32-bit ids, those of ``tokenizers`` on ``json_path`` with ``add_special_tokens=False``.

    The same vocabulary given as ranks encodes several times faster, most of all with a pattern that needs no
    look-ahead. That one splits alike wherever no two white-space characters meet; other texts are split by
    the full pattern, and texts that may hold a special token go to ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if pattern.endswith(_LOOK_AHEAD):
        short = pattern.removesuffix(_LOOK_AHEAD) + r"\s"
        quick = tiktoken.Encoding("quick", pat_str=short, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        quick = full
    special = Tokenizer.from_file(json_path)

    def encode(text: str) -> bytes:
        if "<|" in text:
            ids = special.encode(text, add_special_tokens=False).ids
        else:
            ids = (full if _DOUBLE_SPACE.search(text) else quick)(text)
        return array("I", ids).tobytes()

    return encode


def piece_lengths(n: int, longest: int) -> list[int]:
    """``n`` as whole pieces of ``longest`` and then the binary digits of the rest, largest first."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def pack_power_of_two(
    docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, bucket, sequence_id, offset, ids``.

    A document is its ids and then id 1; null text is empty, so every row gives at least one piece. A piece is
    a sequence by itself: its length is a power of two, at most ``longest`` (itself one), and nothing is
    padded. ``bucket`` is the binary logarithm of the length; batches are drawn from one bucket each (see
    ``write_buckets``). ``ids`` holds little-endian unsigned 32-bit integers. ``sequence_id`` is unique, counts
    up within a task and is the same if the task is run again. Repeated rows are packed each; a null
    identifier is carried along.

    One narrow pass: no row moves, and a task holds one block of text and its ids.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.array([END_OF_DOCUMENT], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(json_path, ranks_path, pattern)
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last, _, _ in byte_blocks(batch.column(1), BLOCK_BYTES):
                owner, start, length, total, ids = [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(first, last - first).to_pylist()):
                    coded = encode(text or "") + end
                    n, at = len(coded) // 4, 0
                    for size in piece_lengths(n, longest):
                        owner.append(first + i)
                        start.append(at)
                        length.append(size)
                        total.append(n)
                        ids.append(coded[4 * at : 4 * (at + size)])
                        at += size
                length = np.array(length, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array(length),
                        pa.array(total, pa.int64()),
                        pa.array(np.log2(length).astype(np.int32)),
                        pa.array(np.arange(sequence, sequence + len(length))),
                        pa.array(np.zeros(len(length), np.int64)),
                        pa.array(ids, pa.binary()),
                    ],
                    names=schema.names,
                )
                sequence += len(length)

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([
        StructField("doc_id", source.schema["doc_id"].dataType), StructField("start", LongType()), StructField("length", LongType()),
        StructField("doc_tokens", LongType()), StructField("bucket", IntegerType()), StructField("sequence_id", LongType()),
        StructField("offset", LongType()), StructField("ids", BinaryType()),
    ])
    return source.mapInArrow(cut, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces with one folder per length, from which batches of one shape are read without padding."""
    pieces.write.partitionBy("bucket").parquet(path)
