"""License notices in documents: phrases, and an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.text import byte_blocks, packed

#: Share of a template's distinct words that a block has to contain.
CONTAINMENT = 0.8
#: Templates are sent to every task; more words than this in all of them are refused.
MOST_TEMPLATE_WORDS = 1_000_000

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by license, as they are written in practice.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("public-domain", "This work is in the public domain"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_FOLD) if not text.isascii() else text.lower())


@dataclass(frozen=True)
class TemplateIndex:
    """Templates as words in the global order, rarest first, and an inverted index of their prefixes."""

    labels: list[str]
    ordered: list[list[str]]
    needed: list[int]
    #: words of each template, repeated ones too
    lengths: list[int]
    order: dict[str, tuple[int, str]]
    prefixes: dict[str, list[tuple[int, int]]]

    @classmethod
    def build(cls, templates: list[tuple[str, str]], frequency: dict[str, int], threshold: float) -> TemplateIndex:
        labels, ordered, needed, lengths, prefixes = [], [], [], [], {}
        order = {w: (frequency.get(w, 0), w) for _, text in templates for w in words_of(text)}
        for label, text in templates:
            unique = sorted(set(words_of(text)), key=order.__getitem__)
            if not unique:
                continue
            overlap = max(1, math.ceil(threshold * len(unique) - 1e-9))
            # a block with that overlap holds at least one of the first size - overlap + 1 words
            for place, word in enumerate(unique[: len(unique) - overlap + 1]):
                prefixes.setdefault(word, []).append((len(labels), place))
            labels.append(label)
            ordered.append(unique)
            needed.append(overlap)
            lengths.append(len(words_of(text)))
        return cls(labels, ordered, needed, lengths, order, prefixes)

    def matches(self, block: list[str]) -> Iterator[tuple[int, float]]:
        """(template, containment) of every template that the block contains to the threshold."""
        distinct = set(block)
        met: dict[int, int] = {}
        for word in distinct & self.prefixes.keys():
            for template, place in self.prefixes[word]:
                met[template] = min(place, met.get(template, place))
        known = None
        for template, place in met.items():
            need, size = self.needed[template], len(self.ordered[template])
            if len(distinct) < need or size - place < need:  # length filter; places before the first shared word are lost
                continue
            if known is None:
                known = sorted((w for w in distinct if w in self.order), key=self.order.__getitem__)
            first = known.index(self.ordered[template][place])
            if min(size - place, len(known) - first) < need:  # positional filter on the block's side
                continue
            shared = sum(word in distinct for word in self.ordered[template])
            if shared >= need:
                yield template, shared / size


def word_frequency(docs: DataFrame, words: set[str], text_col: str = "text") -> dict[str, int]:
    """How many blocks (lines) of all documents hold each of the given words. Tasks hand over one sum per word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                # a text in which none of the words occurs is not looked at by line
                if text and not words.isdisjoint(words_of(text)):
                    for line in text.split("\n"):
                        total.update(words.intersection(words_of(line)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    text = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    summed = text.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {row["word"]: row["n"] for row in summed.collect()}


def _places(words: list[str], phrases: list[tuple[list[str], str]]) -> list[tuple[int, str]]:
    out = []
    for phrase, label in phrases:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    out.append((at, label))
        except ValueError:
            pass
    return out


def _wrapped(text: str, index: TemplateIndex, hits: dict[int, list[int]]) -> list[tuple[int, int, int, int]]:
    """(template, shared words, first word, end word) of notices that go over line ends, by windows of a template's length.

    ``hits`` has the lines that hold each template by themselves; windows that touch those are not taken. Of windows
    of one template that overlap, the first with most shared words stands.
    """
    lines = [words_of(line) for line in text.split("\n")]
    words = [word for line in lines for word in line]
    line_of = [number for number, line in enumerate(lines) for _ in line]
    out = []
    for template, _ in index.matches(words):
        have, need, length = set(index.ordered[template]), index.needed[template], index.lengths[template]
        own = set(hits.get(template, ()))
        places = [i for i, word in enumerate(words) if word in have]
        inside: Counter[str] = Counter()
        low, last = 0, None
        for i in places:
            inside[words[i]] += 1
            while places[low] <= i - length:
                gone = words[places[low]]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                low += 1
            first = places[low]
            if len(inside) < need or line_of[first] == line_of[i] or not own.isdisjoint(range(line_of[first], line_of[i] + 1)):
                continue
            if last is not None and first < last[3]:
                if len(inside) > last[1]:
                    last = out[-1] = (template, len(inside), first, i + 1)
            else:
                last = (template, len(inside), first, i + 1)
                out.append(last)
    return out


def scan(
    docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = CONTAINMENT, keep: list[str] | None = None,
) -> DataFrame:
    """The ``keep`` columns (all by default) as struct ``row``, and per document ``n_words, n_base, first_word,
    last_word, base_labels, labels, score, blocks, wrapped``.

    Words are runs of digits, lower-cased A-Z and characters beyond ASCII. ``n_base`` counts the places where a
    phrase's words stand one after the other, ``first_word`` and ``last_word`` are the smallest and largest
    start (null without any), ``base_labels`` their labels. A text block is a line; ``blocks`` lists every line
    (from 0) that holds at least ``threshold`` of a template's distinct words, with the template's label and
    the containment. ``labels`` adds, for each such line, the label of the template that shares most words with
    it to the base ones. ``wrapped`` lists the notices that go over line ends: windows as long as a template over
    the words of all lines, ``block`` being the number of the first word; they count for ``labels`` and ``score``
    in the same way. Both lists are distinct, sorted and joined
    by commas, empty if there is none. ``score`` is the largest containment, 1 if a phrase stands, else 0.

    Template words are ordered by how many lines of all documents hold them. Only a line with one of a
    template's rarest words becomes a candidate (prefix filter), and only if its length and the position of
    that word still allow the overlap; then the overlap is counted. Null text is empty. Documents do not move.
    """
    if sum(len(words_of(text)) for _, text in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError("templates exceed what is sent to every task")
    vocabulary = {w for _, text in templates for w in words_of(text)}
    index = TemplateIndex.build(list(templates), word_frequency(docs, vocabulary, text_col), threshold)
    coded = [(words_of(phrase), label) for phrase, label in phrases.items()]
    heads = {phrase[0] for phrase, _ in coded}
    source = docs.select(packed(docs.columns if keep is None else keep), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = {
        "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string",
        "score": "double", "blocks": "array<struct<block:bigint,label:string,containment:double>>",
        "wrapped": "array<struct<block:bigint,label:string,containment:double>>",
    }
    schema = source.select("row", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]).schema
    block_type = pa.list_(pa.struct([("block", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), block_type, block_type]

    def one(text: str) -> tuple:
        words = words_of(text)
        distinct = set(words)
        places = _places(words, coded) if not heads.isdisjoint(distinct) else []
        blocks, wrapped, closest, hits = [], [], set(), {}
        if not distinct.isdisjoint(index.prefixes):
            for number, line in enumerate(text.split("\n")):
                met = list(index.matches(words_of(line)))
                for t, _ in met:
                    hits.setdefault(t, []).append(number)
                blocks += [{"block": number, "label": index.labels[t], "containment": share} for t, share in met]
                # of notices that contain each other, the one with most words shared names the block
                most = max((share * len(index.ordered[t]) for t, share in met), default=0)
                closest |= {index.labels[t] for t, share in met if share * len(index.ordered[t]) == most}
            over = _wrapped(text, index, hits)
            for t, shared, first, end in over:
                wrapped.append({"block": first, "label": index.labels[t], "containment": shared / len(index.ordered[t])})
                if all(n <= shared for _, n, a, b in over if a < end and first < b):
                    closest.add(index.labels[t])
        base = {label for _, label in places}
        starts = [at for at, _ in places]
        best = max([1.0] * bool(places) + [b["containment"] for b in blocks + wrapped], default=0.0)
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | closest)), best, blocks, wrapped,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, _ in byte_blocks(batch.column(1)):
                found = [one(text or "") for text in batch.column(1).slice(first, last - first).to_pylist()]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*found), arrow)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names=schema.names)

    return source.mapInArrow(run, schema)
