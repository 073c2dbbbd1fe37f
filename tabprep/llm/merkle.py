"""Merkle manifest of a dataset: a tree of SHA-256 digests per group of rows, and a tree of the groups' roots above them.

A parent is hashed child by child, and a copy of the hash state before each child slot is retained. To replace a
child, the copy before its slot is resumed with the new digest and the siblings to its right; nothing to its left is
hashed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.text import packed
from tabprep.operators.scale import attach, positions
from tabprep.session import materialize

#: Most nodes that a task holds of one level: a segment is the largest full subtree with no more leaves.
SEGMENT_NODES = 1024

_PATH = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows write alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256)


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


@dataclass
class Level:
    """The nodes of one level of a segment; for each parent, the hash states before its child slots and its digest."""

    nodes: list[str]
    states: list[list]
    parents: list[str]

    @classmethod
    def of(cls, nodes: list[str], fanout: int) -> Level:
        states, parents = [], []
        for at in range(0, len(nodes), fanout):
            state, before = hashlib.sha256(), []
            for child in nodes[at : at + fanout]:
                before.append(state.copy())
                state.update(child.encode())
            states.append(before)
            parents.append(state.hexdigest())
        return cls(nodes, states, parents)

    def siblings(self, at: int, fanout: int) -> tuple[str, str]:
        """Digests of the run's other nodes, those before and those after place ``at``."""
        first = at - at % fanout
        return "".join(self.nodes[first:at]), "".join(self.nodes[at + 1 : first + fanout])


def resumed(state, digest: str, right: str) -> str:
    """The parent's digest after a child became ``digest``: its retained state goes on from that slot."""
    state = state.copy()
    state.update(digest.encode())
    state.update(right.encode())
    return state.hexdigest()


def build_levels(nodes: list[str], levels: int, fanout: int) -> list[Level]:
    out = []
    for _ in range(levels):
        out.append(Level.of(nodes, fanout))
        nodes = out[-1].parents
    return out


class Segment:
    """A subtree in one task, and the path from its top to the root with the state retained before each slot on it."""

    def __init__(self, nodes: list[str], levels: int, fanout: int, above: list[dict]):
        self.levels, self.fanout = build_levels(nodes, levels, fanout), fanout
        self.above = [(step["left"], step["right"], hashlib.sha256(step["left"].encode())) for step in above]

    def path(self, at: int) -> list[dict]:
        """Siblings of a node, level by level up to the root."""
        out = []
        for level in self.levels:
            left, right = level.siblings(at, self.fanout)
            out.append({"left": left, "right": right})
            at //= self.fanout
        return out + [{"left": left, "right": right} for left, right, _ in self.above]

    def fold(self, at: int, digest: str) -> str:
        """The root after the node at ``at`` became ``digest``."""
        for level in self.levels:
            digest = resumed(level.states[at // self.fanout][at % self.fanout], digest, level.siblings(at, self.fanout)[1])
            at //= self.fanout
        for _, right, state in self.above:
            digest = resumed(state, digest, right)
        return digest


def _segment_levels(fanout: int, most: int) -> int:
    levels = 1
    while fanout ** (levels + 1) <= most:
        levels += 1
    return levels


def _in_segments(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("segment", F.floor(F.col("pos") / span).cast("long"))


def _raised(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes ``tree, pos, n, digest`` some levels up: one row per segment."""
    span = fanout**levels

    def raise_segment(table: pa.Table) -> pa.Table:
        digests = table.sort_by("pos")["digest"].to_pylist()
        n = table["n"][0].as_py()
        built = build_levels(digests, min(levels, height(n, fanout)), fanout)
        top = built[-1].parents[0] if built else digests[0]
        return pa.table({"tree": table["tree"][:1], "pos": table["segment"][:1], "n": [-(-n // span)], "digest": [top]})

    return _in_segments(nodes, span).groupBy("tree", "segment").applyInArrow(raise_segment, "tree string, pos long, n long, digest string")


def _climb(leaves: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """``tree, pos, n, digest`` at the leaves and then, round by round, at the tops of ever larger segments; last the roots."""
    rounds = [leaves.select("tree", "pos", "n", "digest")]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(materialize(_raised(rounds[-1], fanout, levels), "merkle"))
    return rounds


def _opened(table: pa.Table, above: pa.Table, fanout: int, levels: int) -> tuple[pa.Table, Segment]:
    table = table.sort_by("pos")
    built = min(levels, height(table["n"][0].as_py(), fanout))
    return table, Segment(table["digest"].to_pylist(), built, fanout, above["path"][0].as_py())


def _repeated(above: pa.Table, column: str, rows: int) -> pa.Array:
    return pa.array([above[column][0].as_py()] * rows, pa.string())


def _segments(nodes: DataFrame, paths: DataFrame, span: int):
    below = _in_segments(nodes, span).groupBy("tree", "segment")
    return below.cogroup(paths.withColumnRenamed("pos", "segment").groupBy("tree", "segment"))


def _lowered(nodes: DataFrame, paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``tree, pos, top, root, path`` of nodes whose segments' tops have theirs in ``paths``."""

    def lower(table: pa.Table, above: pa.Table) -> pa.Table:
        table, segment = _opened(table, above, fanout, levels)
        n = table.num_rows
        path = pa.array([segment.path(at) for at in range(n)], pa.list_(_STEP))
        return pa.table({"tree": table["tree"], "pos": table["pos"], "top": _repeated(above, "top", n), "root": _repeated(above, "root", n), "path": path})

    return _segments(nodes, paths, fanout**levels).applyInArrow(lower, f"tree string, pos long, top string, root string, path {_PATH}")


def _proved(leaves: DataFrame, paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Leaves with their paths, and the root that follows from the changed (else the own) leaf and its path."""

    def prove(table: pa.Table, above: pa.Table) -> pa.Table:
        table, segment = _opened(table, above, fanout, levels)
        n, changed = table.num_rows, table["changed"].to_pylist()
        path = pa.array([segment.path(at) for at in range(n)], pa.list_(_STEP))
        folded = [segment.fold(at, new or old) for at, (new, old) in enumerate(zip(changed, table["digest"].to_pylist()))]
        return pa.table({
            "row": table["row"], "position": table["pos"], "leaf": table["digest"], "subroot": _repeated(above, "top", n),
            "root": _repeated(above, "root", n), "proof": path, "folded_root": pa.array(folded, pa.string()),
        })

    schema = leaves.selectExpr(
        "row", "pos AS position", "digest AS leaf", "digest AS subroot", "digest AS root", f"cast(array() AS {_PATH}) AS proof", "digest AS folded_root"
    ).schema
    return _segments(leaves, paths, fanout**levels).applyInArrow(prove, schema)


def manifest(
    docs: DataFrame, fields: Sequence[str], group: str, order: str, keep: list[str] | None = None, changed: Column | None = None,
    changes: dict[str, Column] | None = None, fanout: int = 2, segment_nodes: int = SEGMENT_NODES,
) -> DataFrame:
    """``row, position, leaf, subroot, root, proof, folded_root``: one row per document with its place in the tree.

    A leaf is the SHA-256 of the ``fields`` (see ``field_text``). Leaves of one ``group`` ascend by ``order``, nulls first;
    equal ones follow by leaf, so repeated rows, which are leaves each, may stand in any order. Every ``fanout``
    consecutive nodes become the digest of their digests, the last run also if it is shorter or a single node, until
    one node remains, the subroot. Subroots, by group with null first, become the root in the same way. ``proof``
    holds for each level the digests before and after the node in its run. ``folded_root`` is the root that follows from
    the proof if, where ``changed`` is true, ``changes`` replace columns of the row; elsewhere from the leaf itself.
    ``row`` holds the ``keep`` columns (the order column by default). An empty table gives no row.

    Leaf digests are stored and range-sorted for their places; a group's size does not matter, since no task holds
    more than ``segment_nodes`` leaves of one subtree (``fanout`` of them at least). Tops of subtrees are raised in
    rounds, whose number is the logarithm of the rows to that base, and the paths come down the same way. A text
    is hashed once, twice where it is changed, and is never moved.
    """
    levels = _segment_levels(fanout, segment_nodes)
    values = {f: F.col(f"`{f}`") for f in fields}
    new = leaf_digest([(changes or {}).get(f, value) for f, value in values.items()])
    named = F.col(f"`{group}`").cast("string")
    hashed = docs.select(
        packed([order] if keep is None else keep),
        F.when(named.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), named)).alias("tree"),
        F.col(f"`{order}`").alias("key"),
        leaf_digest(list(values.values())).alias("digest"),
        F.when(F.lit(False) if changed is None else changed, new).alias("changed"),
        F.monotonically_increasing_id().alias("at"),
    )
    stored = materialize(hashed, "leaves")
    sizes = stored.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    placed = positions(stored, ["tree"], ["key", "digest", "at"]).drop("key", "at")
    leaves = materialize(attach(placed, sizes, ["tree"], how="inner"), "placed")

    rounds = _climb(leaves, fanout, levels)
    groups = materialize(positions(rounds[-1].select("tree", "digest"), [], ["tree"]).withColumnRenamed("tree", "group"), "groups")
    over = groups.select(F.lit("").alias("tree"), "pos", F.lit(groups.count()).cast("long").alias("n"), "digest")
    tops = _climb(over, fanout, levels)
    paths = tops[-1].select("tree", "pos", F.col("digest").alias("top"), F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    for nodes in reversed(tops[:-1]):
        paths = materialize(_lowered(nodes, paths, fanout, levels), "paths")
    subroots = groups.select("pos", F.col("group").alias("tree"), F.col("digest").alias("top"))
    paths = attach(subroots, paths.select("pos", "root", "path"), ["pos"], how="inner").withColumn("pos", F.lit(0).cast("long"))
    for nodes in reversed(rounds[1:-1]):
        paths = materialize(_lowered(nodes, paths, fanout, levels), "paths")
    return _proved(leaves, paths, fanout, levels)
