"""Subword pieces with their places in the original text, and back to text.

Normalisation takes, at each place, the longest prefix that the model's compiled character map has a rule for, and
records where every byte of its result comes from. Cut into pieces, the normalised text thus projects each piece onto
a range of the original bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.text import byte_blocks, packed

#: What stands for a blank in pieces (U+2581).
BLANK = "▁".encode()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _delimited(number: int, content: bytes) -> bytes:
    size, out = len(content), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    return bytes(out) + bytes([size]) + content


class CharacterMap:
    """A compiled character map: a double-array trie of byte prefixes and the texts that replace them."""

    def __init__(self, blob: bytes = b""):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.firsts = [b for b in range(1, 256) if self.units and self._child(self._offset(self.units[0]), b) is not None]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 512 else 0)

    def _child(self, base: int, byte: int) -> int | None:
        """Place of the node that ``byte`` leads to, if there is one."""
        place = base ^ byte
        return place if place < len(self.units) and self.units[place] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement and the length of the longest prefix of ``data[at:]`` that has a rule."""
        best, base = None, self._offset(self.units[0])
        for end in range(at, len(data)):
            place = self._child(base, data[end]) if data[end] else None
            if place is None:
                break
            base = place ^ self._offset(self.units[place])
            if self.units[place] & 256:
                best = self.units[base] & 0x7FFFFFFF, end + 1 - at
        if best is None:
            return None
        return self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1]


@dataclass
class Normalizer:
    """The normalisation that a model asks for, with a record of where each byte comes from."""

    rules: CharacterMap = field(default_factory=CharacterMap)
    dummy_prefix: bool = True
    remove_extra_blanks: bool = True
    escape_blanks: bool = True
    blank_as_suffix: bool = False
    symbols: tuple[bytes, ...] = ()

    def __post_init__(self):
        firsts = {re.escape(bytes([b])) for b in self.rules.firsts}
        kept = [re.escape(s) for s in sorted(self.symbols, key=len, reverse=True)]
        self._symbols = set(self.symbols)
        self._places = re.compile(b"|".join(kept + sorted(firsts))) if kept or firsts else None

    def _replaced(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Text after the character map, and for each of its bytes the place it comes from."""
        if self._places is None:
            return data, np.arange(len(data), dtype=np.int32)
        out, sources, at = [b""], [np.zeros(0, np.int32)], 0

        def verbatim(first: int, last: int) -> None:
            out.append(data[first:last])
            sources.append(np.arange(first, last, dtype=np.int32))

        found = self._places.search(data)
        while found:
            begin = found.start()
            rule = (found[0], len(found[0])) if found[0] in self._symbols else self.rules.longest(data, begin)
            if rule is None:
                found = self._places.search(data, begin + 1)
                continue
            verbatim(at, begin)
            out.append(rule[0])
            sources.append(np.full(len(rule[0]), begin, np.int32))
            at = begin + rule[1]
            found = self._places.search(data, at)
        verbatim(at, len(data))
        return b"".join(out), np.concatenate(sources)

    def _leading_blanks(self, data: bytes) -> int:
        """How many bytes at the beginning stand for blanks."""
        at = 0
        while at < len(data):
            text, size = (self.rules.longest(data, at) if self.rules.units else None) or (data[at : at + 1], 1)
            if text != b" ":
                break
            at += size
        return at

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for their end the place in ``data`` it comes from."""
        text, source = self._replaced(data)
        first, size = 0, len(data)
        if self.remove_extra_blanks:
            blank = np.frombuffer(text, np.uint8) == 32
            if blank.all():
                return b"", np.array([size], np.int32)
            keep = ~blank | ~np.concatenate(([True], blank[:-1]))
            first = self._leading_blanks(data)
            text, source = np.frombuffer(text, np.uint8)[keep].tobytes(), source[keep]
        if not data:
            return b"", np.array([0], np.int32)
        if self.dummy_prefix and not self.blank_as_suffix:
            text, source = b" " + text, np.concatenate((np.array([first], np.int32), source))
        symbol = b" "
        if self.escape_blanks:
            source = np.repeat(source, np.where(np.frombuffer(text, np.uint8) == 32, len(BLANK), 1))
            text, symbol = text.replace(b" ", BLANK), BLANK
        while self.remove_extra_blanks and text.endswith(symbol):
            text = text[: -len(symbol)]
            size, source = int(source[len(text)]), source[: len(text)]
        if self.dummy_prefix and self.blank_as_suffix:
            text, source = text + symbol, np.concatenate((source, np.full(len(symbol), size, np.int32)))
        return text, np.append(source, np.int32(size))


class Pieces:
    """A model whose text is normalised here and cut into pieces by the library."""

    def __init__(self, model: bytes):
        import sentencepiece

        spec: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        sizes, symbols, kinds = [], [], []
        for number, value in _message(model):
            if number == 1:
                piece = dict(_message(value))
                kinds.append(piece.get(3, 1))
                sizes.append(1 if kinds[-1] == 6 else len(piece[1]))
                if kinds[-1] == 4:
                    symbols.append(piece[1])
            elif number == 2:
                trainer.update(_message(value))
            elif number == 3:
                spec.update(_message(value))
        self.normalize = Normalizer(
            CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(trainer.get(24, 0)), tuple(symbols)
        )
        self.sizes = np.array(sizes, np.int64)
        self.unknown = {i for i, kind in enumerate(kinds) if kind == 2}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # a later value of a field counts: no map, no prefix, no removal, no escapes
        plain = _delimited(3, b"\x12\x00\x18\x00\x20\x00\x28\x00")
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model + plain)

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], np.ndarray]]:
        """Ids, and the places in the original bytes where the pieces begin and the last one ends."""
        normal = [self.normalize(t) for t in texts]
        out = []
        for (text, source), ids in zip(normal, self.segmenter.encode([t for t, _ in normal], num_threads=1)):
            sizes = self.sizes[ids] if ids else np.zeros(0, np.int64)
            if not self.unknown.isdisjoint(ids):
                pieces = self.segmenter.encode(text, out_type=bytes)
                sizes = np.array([self.sizes[i] if i not in self.unknown else len(p) for i, p in zip(ids, pieces)])
            upto = np.concatenate(([0], np.cumsum(sizes)))
            if upto[-1] != len(text):
                raise ValueError(f"pieces cover {upto[-1]} of {len(text)} bytes")
            out.append((ids, source[upto]))
        return out


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row, ids, bounds, decoded``: each text's ids, where its pieces begin in its UTF-8 bytes, and the ids' text.

    Ids are those of the sentencepiece library without begin and end ids. Piece ``i`` comes from the bytes from
    ``bounds[i]`` up to ``bounds[i + 1]``; pieces that add something (the blank before the first word) and bytes that a
    rule makes of one character may have empty ranges. ``decoded`` is what the library's ``decode`` makes of the ids.
    ``row`` holds the ``keep`` columns (all by default). Null texts are empty and have no id, one bound and an empty
    decoded text; repeated rows are encoded each. ``model_path`` must be readable on every executor.

    One narrow pass: no row moves, and a task holds one block of text with its pieces; a longer text is a block.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(model_path)
        for batch in batches:
            for first, end, data, offsets in byte_blocks(batch.column(1)):
                coded = model.encode([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])])
                counts = np.cumsum([0] + [len(ids) for ids, _ in coded])
                flat = np.fromiter((i for ids, _ in coded for i in ids), np.int32, counts[-1])
                bounds = np.concatenate([b for _, b in coded]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(flat)),
                        pa.ListArray.from_arrays(pa.array(counts + np.arange(len(counts)), pa.int32()), pa.array(bounds)),
                        pa.array([model.library.decode(ids) for ids, _ in coded], pa.string()),
                    ],
                    names=["row", "ids", "bounds", "decoded"],
                )

    source = docs.select(packed(docs.columns if keep is None else keep), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = source.selectExpr("row", "cast(array() AS array<int>) AS ids", "cast(array() AS array<int>) AS bounds", "text AS decoded").schema
    return source.mapInArrow(cut, schema)
