"""A Merkle manifest of a dataset, built by appends that complete each leaf's witness as its siblings come.

Leaves are appended in order to open subtrees. A subtree that is complete (16 siblings, or the end of
its tree) becomes one node: each of its parts gets the digests of the others, which extends the partial
witness of every leaf below it, and the node is appended one level higher.

The appends are spread over tasks by aligned blocks of 16^3 leaves: a block's subtree depends on nothing
outside it. The roots of blocks are the leaves of a smaller tree and are appended in the same way, until
each source has one node; the sources' subroots are appended to the last tree. What the upper trees
attach to a block extends the witnesses of all leaves of the block, which the second pass over the leaves
finishes in order. A task holds the witnesses of one block, which share their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import written
from leafmill.llm.ranks import numbered

ARITY = 16
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class OpenTree:
    """Open subtrees of one block. ``append`` takes leaves in order; ``close`` gives the root."""

    def __init__(self) -> None:
        self.open: list[list[tuple[str, list[list[str]]]]] = [[] for _ in range(BLOCK_LEVELS + 1)]

    def append(self, leaf: str, witness: list[str], level: int = 0) -> None:
        """Appends a leaf, whose ``witness`` (siblings by level) grows with each later completion."""
        self._push(leaf, [witness], level)

    def _push(self, node: str, witnesses: list[list[str]], level: int) -> None:
        self.open[level].append((node, witnesses))
        if len(self.open[level]) == ARITY and level < BLOCK_LEVELS:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for i, (_, witnesses) in enumerate(run):
            siblings = "".join(nodes[:i] + nodes[i + 1 :])
            for w in witnesses:
                w.append(siblings)
        self._push(digest("".join(nodes)), [w for _, witnesses in run for w in witnesses], level + 1)

    def close(self, levels: int) -> str:
        """Completes what is open up to ``levels`` levels, single nodes too, and returns the root."""
        for level in range(levels):
            if self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def folded(leaf: str, place: int, witness: list[str]) -> str:
    """The root that a leaf at ``place`` and its witness give."""
    for siblings in witness:
        at = 64 * (place % ARITY)
        leaf, place = digest(siblings[:at] + leaf + siblings[at:]), place // ARITY
    return leaf


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes ``tree, place, total, node`` (and more) in whole blocks, each block's rows in order."""
    return nodes.withColumn("block", F.expr(f"place div {BLOCK}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _each_block(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of one (tree, block) after another; a block may go on over several batches."""
    rows, key = [], None
    for batch in batches:
        for row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns], strict=True):
            if row[:2] != key and rows:
                yield rows
                rows = []
            key = row[:2]
            rows.append(row)
    if rows:
        yield rows


def _levels(total: int) -> int:
    return min(BLOCK_LEVELS, height(total))


def block_roots(nodes: DataFrame) -> DataFrame:
    """``tree, place, total, node``: the roots of the blocks of ``nodes``, numbered as the next tree's leaves."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_block(batches, ["tree", "block", "total", "node"]):
            tree = OpenTree()
            for r in rows:
                tree.append(r[3].hex(), [])
            total = rows[0][2]
            yield pa.RecordBatch.from_pydict({"tree": pa.array([rows[0][0]], pa.string()), "place": pa.array([rows[0][1]], pa.int64()), "total": pa.array([-(-total // BLOCK)], pa.int64()), "node": pa.array([bytes.fromhex(tree.close(_levels(total)))], pa.binary())})

    return written(_blocks(nodes.select("tree", "place", "total", "node")).mapInArrow(build, "tree string, place long, total long, node binary"), "merkle-blocks")


def witnesses(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """``tree, place, top, witness``: the witness (siblings by level) and places from each node to the top of all trees.

    ``above`` has the same of the blocks of ``nodes`` and comes into a block before its first row; without
    it every tree of ``nodes`` has one block, whose root is its top. ``steps`` counts the levels of each
    tree on the way, with the place there.
    """
    rows = _blocks(nodes.select("tree", "place", "total", "node")).select("tree", "block", "place", "total", "node", F.lit(None).cast("array<string>").alias("witness"), F.lit(None).cast("array<long>").alias("steps"), F.lit(None).cast("string").alias("top"))
    if above is not None:
        heads = above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("binary").alias("node"), "witness", "steps", "top")
        rows = rows.unionByName(heads)
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each_block(batches, ["tree", "block", "place", "total", "node", "witness", "steps", "top"]):
            head, own = (block[0], block[1:]) if block[0][2] == -1 else (None, block)
            tree, levels = OpenTree(), _levels(own[0][3])
            partial: list[list[str]] = [[] for _ in own]
            for r, w in zip(own, partial, strict=True):
                tree.append(r[4].hex(), w)
            root = tree.close(levels)
            more, steps, top = (head[5], head[6], head[7]) if head else ([], [], root)
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([r[0] for r in own], pa.string()), "place": pa.array([r[2] for r in own], pa.int64()), "node": pa.array([r[4] for r in own], pa.binary()),
                "witness": pa.array([w + more for w in partial], pa.list_(pa.string())), "steps": pa.array([[levels, r[2], *steps] for r in own], pa.list_(pa.int64())), "top": pa.array([top] * len(own), pa.string()),
            })

    return rows.mapInArrow(extend, "tree string, place long, node binary, witness array<string>, steps array<long>, top string")


def climb(leaf: str, witness: list[str], steps: list[int]) -> list[str]:
    """The nodes that a leaf reaches at the top of each of its trees; ``steps``: (levels, place) of each."""
    tops = []
    for levels, place in zip(steps[::2], steps[1::2], strict=True):
        leaf, witness = folded(leaf, place, witness[:levels]), witness[levels:]
        tops.append(leaf)
    return tops


def leaf_of(fields: list[Column]) -> Column:
    """The digest (32 bytes) of fields: ``-`` for null, else UTF-8 length, colon and value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]), 256))


def manifest(docs: DataFrame, tampered: Column, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", others: tuple[str, ...] = ("lang", "n_chars")) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the digest of id, source, ``others`` and text; leaves of a source ascend by id (nulls
    first, equal ids by their leaves), sources by their bytes (null first, as a source of its own).
    Where ``tampered`` is true, ``folded_root`` starts from the leaf with A-Z of the text in lower case,
    else from the leaf itself; siblings are those of the manifest. Null fields are part of a leaf, a
    null text is not tampered with, texts of any length are hashed whole, equal rows are leaves each.
    Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    text = F.col(text_col)
    fields = lambda t: [F.col(id_col), F.col(source_col), *[F.col(c) for c in others], t]
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf_of(fields(F.translate(text, UPPER, LOWER))))
    leaves = written(docs.select(F.col(source_col).alias("tree"), F.col(id_col).alias("doc_id"), leaf_of(fields(text)).alias("node"), changed.alias("changed")), "merkle-leaves")
    rows = written(numbered(leaves, ["tree"], ["doc_id", "node"], "merkle"), "merkle-rows")

    # Upwards: the roots of blocks are appended to smaller trees until each source is one block.
    trees = [rows]
    while trees[-1].where(F.col("total") > BLOCK).limit(1).count():
        trees.append(block_roots(trees[-1]))
    subroots = block_roots(trees[-1]).select(F.col("tree").alias("source"), "node")
    top = [written(numbered(subroots.select(F.lit("").alias("tree"), "source", "node"), ["tree"], ["source"], "merkle-sources"), "merkle-sources")]
    while top[-1].where(F.col("total") > BLOCK).limit(1).count():
        top.append(block_roots(top[-1]))

    # Downwards: what is above a block extends the witnesses in it.
    above = None
    for tree in reversed(top):
        above = written(witnesses(tree, above), "merkle-witnesses")
    named = top[0].select("tree", "place", F.col("source")).join(above, ["tree", "place"]).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "witness", "steps", "top")
    above = written(named, "merkle-witnesses")
    for tree in reversed(trees[1:]):
        above = written(witnesses(tree, above), "merkle-witnesses")
    return _proofs(rows, above, len(trees) - 1)


def _proofs(rows: DataFrame, above: DataFrame, inner: int) -> DataFrame:
    """The last pass: witnesses of the leaves, which never leave their task, hashed and folded.

    ``inner`` trees lie between the blocks and the subroot of their source.
    """
    own = rows.select("tree", F.expr(f"place div {BLOCK}").alias("block"), "place", "total", "doc_id", "node", "changed", F.lit(None).cast("array<string>").alias("witness"), F.lit(None).cast("array<long>").alias("steps"), F.lit(None).cast("string").alias("top"))
    id_type = dict(rows.dtypes)["doc_id"]
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("total", "long"), ("doc_id", id_type), ("node", "binary"), ("changed", "binary"))}
    heads = above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), *none.values(), "witness", "steps", "top")
    both = own.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        ids = first.schema.field("doc_id").type
        for block in _each_block(chain([first], batches), ["tree", "block", "place", "total", "doc_id", "node", "changed", "witness", "steps", "top"]):
            (_, _, _, _, _, _, _, more, steps, top), leaves = block[0], block[1:]
            tree, levels = OpenTree(), _levels(leaves[0][3])
            partial: list[list[str]] = [[] for _ in leaves]
            for r, w in zip(leaves, partial, strict=True):
                tree.append(r[5].hex(), w)
            root = tree.close(levels)
            subroot = [root, *climb(root, more, steps)][inner]
            out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
            for r, w in zip(leaves, partial, strict=True):
                last = climb((r[6] or r[5]).hex(), w + more, [levels, r[2] % BLOCK, *steps])[-1]
                for c, x in zip(out, (r[4], r[5].hex(), subroot, top, digest("".join(w + more)), last, last == top), strict=True):
                    out[c].append(x)
            yield pa.RecordBatch.from_pydict(out | {"doc_id": pa.array(out["doc_id"], ids)})

    return both.mapInArrow(prove, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
