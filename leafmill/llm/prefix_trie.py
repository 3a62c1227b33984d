"""The trie of conversation prefixes by vertical bitmaps.

Conversations are numbered and dealt into shards of ascending ids. A shard indexes (position, turn) to
the bitset of its conversations, and walks its part of the trie depth first: the bitset of a node
intersected with the postings of the next position gives its children; the population count gives the
members, the bits of conversations that end there the end list. Nodes are named by a digest of their
path, so the parts of a node in all shards meet under its name, and end lists of successive shards
follow each other in ascending order.

Sums over subtrees need no walk across shards. The smallest member of a node owns it, and a conversation
that owns a node owns all of its own path below. So the childless nodes of a subtree are the members that
own theirs, and what a subtree saves is the bytes of its members' turns that they don't own: both are
sums over the bits of a node, which a second walk makes.

A task looks at a shard's conversations (at most ``shard``) over at most ``block`` positions at once. Longer conversations go on
in further blocks, which start from the digest of the path so far, so no task holds a whole conversation
of unbounded length.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import written
from leafmill.llm.ranks import numbered

SHARD, BLOCK = 1024, 1024
OUT_ROWS = 20_000
NO_PATH = b""
LOCAL = "node binary, parent binary, depth long, conv_id long, n_convs long, n_bytes long, path_bytes long, shard long, ends string"
SUMS = "node binary, n_leaves long, saved long"


def step(path: bytes, turn: bytes) -> bytes:
    """The digest of a path inside a block, one turn longer."""
    return hashlib.sha256(path + turn).digest()[:16]


def name(start: bytes, path: bytes) -> bytes:
    """The name of the node that a path leads to from the start of its block."""
    return hashlib.sha256(start + b"/" + path).digest()[:16] if path else start


ROOT = hashlib.sha256(b"root").digest()[:16]


class Conversation(NamedTuple):
    conv_id: int
    length: int
    start: bytes
    before: int  # bytes before the block
    owned_from: int | None  # the depth from which it owns its path; None: nowhere
    unowned: int  # bytes of its turns before that
    leaf: bool  # whether it owns a childless node


class Node(NamedTuple):
    bits: int
    name: bytes
    parent: bytes | None
    path: bytes
    depth: int
    n_bytes: int
    path_bytes: int
    ends: int


def bits_of(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def walk(first: int, end: int, convs: list[Conversation], turns: list[tuple[int, int, bytes, int]]) -> Iterator[Node]:
    """The nodes of a shard below depth ``first``, down to ``end``, depth first; the root too if ``first`` is 0.

    ``turns``: (position, index of the conversation, turn, bytes).
    """
    postings: dict[int, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
    said: dict[tuple[int, int], bytes] = {}
    size: dict[bytes, int] = {}
    for position, i, turn, n_bytes in turns:
        postings[position][turn] |= 1 << i
        said[position, i] = turn
        size[turn] = n_bytes
    ends: dict[int, int] = defaultdict(int)
    starts: dict[bytes, int] = defaultdict(int)
    for i, c in enumerate(convs):
        ends[c.length] |= 1 << i
        starts[c.start] |= 1 << i
    for start, members in starts.items():
        some = convs[next(bits_of(members))]
        top = Node(members, start, None, NO_PATH, first, 0, some.before, 0 if first else members & ends[0])
        if not first:
            yield top
        stack = [top]
        while stack:
            at = stack.pop()
            if at.depth == end:
                continue
            left = at.bits & ~at.ends
            while left:
                turn = said[at.depth, (left & -left).bit_length() - 1]
                bits = left & postings[at.depth][turn]
                left &= ~bits
                path, n_bytes, depth = step(at.path, turn), size[turn], at.depth + 1
                child = Node(bits, name(start, path), at.name, path, depth, n_bytes, at.path_bytes + n_bytes, bits & ends[depth])
                yield child
                stack.append(child)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[Conversation], list]]:
    """(shard, block, its conversations by id, their turns) from rows sorted by shard, block, position, id."""
    key, convs, turns, index = None, [], [], {}
    columns = ["shard", "block", "position", "conv_id", "turn", "n_bytes", "length", "start", "before", "owned_from", "unowned", "leaf"]
    for batch in batches:
        for shard, block, position, conv_id, turn, n_bytes, *rest in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns], strict=True):
            if (shard, block) != key:
                if key:
                    yield *key, convs, turns
                key, convs, turns, index = (shard, block), [], [], {}
            if position < 0:
                index[conv_id] = len(convs)
                convs.append(Conversation(conv_id, *rest))
            else:
                turns.append((position, index[conv_id], turn, n_bytes))
    if key:
        yield *key, convs, turns


def _out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def local_nodes(sharded: DataFrame, block_turns: int) -> DataFrame:
    """The nodes that each shard sees, with its members there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for shard, block, convs, turns in _blocks(batches):
                for n in walk(block * block_turns, (block + 1) * block_turns, convs, turns):
                    ends = ",".join(str(convs[i].conv_id) for i in bits_of(n.ends)) if n.ends else None
                    yield n.name, n.parent, n.depth, convs[(n.bits & -n.bits).bit_length() - 1].conv_id, n.bits.bit_count(), n.n_bytes, n.path_bytes, shard, ends

        return _out(rows(), _arrow(LOCAL))

    return sharded.mapInArrow(run, LOCAL)


def local_sums(sharded: DataFrame, block_turns: int) -> DataFrame:
    """What the members that a shard has of a node add to the sums over its subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, block, convs, turns in _blocks(batches):
                first = block * block_turns
                leaves = sum(1 << i for i, c in enumerate(convs) if c.leaf)
                guests = sum(1 << i for i, c in enumerate(convs) if c.owned_from is None or c.owned_from > first)
                for n in walk(first, first + block_turns, convs, turns):
                    above = n.path_bytes - n.n_bytes
                    saved = sum(convs[i].unowned - above for i in bits_of(n.bits & guests) if convs[i].owned_from is None or convs[i].owned_from > n.depth)
                    n_leaves = (n.bits & leaves).bit_count()
                    if n_leaves or saved:
                        yield n.name, n_leaves, saved

        return _out(rows(), _arrow(SUMS))

    return sharded.mapInArrow(run, SUMS)


def _block_starts(turns: DataFrame, block_turns: int) -> DataFrame:
    """``conv_id, block, start, before``: the name of the node where each block but the first begins, and the bytes before it.

    Blocks are digested on their own; only their digests are chained along a conversation.
    """
    full = turns.where(F.col("length") > (F.col("block") + 1) * block_turns).select("conv_id", "block", "position", "turn", "n_bytes")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, path, total = None, NO_PATH, 0
            for batch in batches:
                for conv_id, block, turn, n_bytes in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "block", "turn", "n_bytes")], strict=True):
                    if (conv_id, block) != key:
                        if key:
                            yield *key, path, total
                        key, path, total = (conv_id, block), NO_PATH, 0
                    path, total = step(path, turn), total + n_bytes
            if key:
                yield *key, path, total

        return _out(rows(), _arrow("conv_id long, block long, path binary, before long"))

    blocks = full.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "position").mapInArrow(digests, "conv_id long, block long, path binary, before long")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, start, total = None, ROOT, 0
            for batch in batches:
                for conv_id, block, path, n_bytes in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "block", "path", "before")], strict=True):
                    if conv_id != key:
                        key, start, total = conv_id, ROOT, 0
                    start, total = name(start, path), total + n_bytes
                    yield conv_id, block + 1, start, total

        return _out(rows(), _arrow("conv_id long, block long, start binary, before long"))

    return written(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(chained, "conv_id long, block long, start binary, before long"), "trie-starts")


def _sharded(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Turns and, before them, one head row for each conversation of each (shard, block)."""
    columns = ["shard", "block", "position", "conv_id", "turn", "n_bytes", "length", "start", "before", "owned_from", "unowned", "leaf"]
    kinds = dict(heads.dtypes) | dict(turns.dtypes)
    whole = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    heads = heads.withColumn("position", F.lit(-1).cast("long"))
    return whole(turns.drop("length")).unionByName(whole(heads)).repartition("shard", "block").sortWithinPartitions("shard", "block", "position", "conv_id")


def prefix_trie(turns: DataFrame, conversations: DataFrame, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations, and the end lists of its nodes.

    ``turns``: ``conv_id, position`` (long, from 0 without gaps), ``turn`` (a digest that names role and
    text), ``n_bytes`` of the text; ``conversations``: every ``conv_id`` once, turnless ones too; no nulls.
    Nodes: ``node, parent, depth, conv_id`` (the smallest member), ``n_convs, n_children, n_leaves, saved``
    (bytes). End lists: ``node, shard, ends``: comma-joined ids that end at the node, ascending inside a
    shard and over shards. Equal conversations are members of the same nodes. No conversations: no rows,
    not even a root.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"), F.sum("n_bytes").alias("total_bytes"))
    convs = conversations.join(lengths, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("length", "total_bytes")], F.lit(0).alias("all_"))
    convs = numbered(convs, ["all_"], ["conv_id"], "trie").select("conv_id", "length", "total_bytes", F.expr(f"place div {shard}").alias("shard"))
    convs = written(convs, "trie-conversations")
    rows = turns.join(convs.select("conv_id", "shard", "length"), "conv_id").withColumn("block", F.expr(f"position div {block}"))
    rows = written(rows.select("shard", "block", "position", "conv_id", "turn", "n_bytes", "length"), "trie-turns")

    last = F.greatest(F.lit(0), F.expr(f"(length - 1) div {block}"))
    heads = convs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).join(_block_starts(rows, block), ["conv_id", "block"], "left")
    heads = written(heads.select("shard", "block", "conv_id", "length", "total_bytes", F.coalesce("start", F.lit(ROOT)).alias("start"), F.coalesce("before", F.lit(0)).alias("before")), "trie-heads")
    free = heads.select("*", F.lit(None).cast("long").alias("owned_from"), F.lit(0).cast("long").alias("unowned"), F.lit(False).alias("leaf")).drop("total_bytes")
    local = written(local_nodes(_sharded(rows, free), block), "trie-local")

    nodes = local.groupBy("node").agg(*[F.min(c).alias(c) for c in ("parent", "depth", "conv_id", "n_bytes", "path_bytes")], F.sum("n_convs").alias("n_convs"))
    nodes = written(nodes, "trie-merged")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("owned_from"), F.min(F.col("path_bytes") - F.col("n_bytes")).alias("unowned"), F.max(F.col("n_children") == 0).alias("leaf"))
    judged = heads.join(owners, "conv_id", "left").withColumn("unowned", F.coalesce("unowned", "total_bytes")).withColumn("leaf", F.coalesce("leaf", F.lit(False))).drop("total_bytes")
    sums = local_sums(_sharded(rows, judged), block).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    nodes = nodes.join(sums, "node", "left").select("node", "parent", "depth", "conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    return written(nodes, "trie-result"), local.where("ends IS NOT NULL").select("node", "shard", "ends")


def end_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the digest of each node's whole end list, read shard by shard as a stream."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, h = None, None
            for batch in batches:
                for node, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if node != key:
                        if key:
                            yield key, h.hexdigest()
                        key, h = node, hashlib.sha256(part.encode())
                    else:
                        h.update(b"," + part.encode())
            if key:
                yield key, h.hexdigest()

        return _out(rows(), _arrow("node binary, ends_sha256 string"))

    return ends.repartition("node").sortWithinPartitions("node", "shard").select("node", "ends").mapInArrow(stream, "node binary, ends_sha256 string")


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, turn, n_bytes``: the turns of each conversation in order, null turns first.

    Null roles and texts are empty. ``turn`` is a digest of role and text; turns of one number stand in
    the order of their digests, equal ones are turns each. Rows without a conversation are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("number"), key.alias("turn"), F.octet_length(text).cast("long").alias("n_bytes"))
    return written(numbered(rows, ["conv_id"], ["number", "turn"], "turns").select("conv_id", "place", "turn", "n_bytes"), "turns")
