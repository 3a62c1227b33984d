"""Substring dedup by relative Lempel-Ziv parsing against indexed blocks of the corpus.

Every block of documents is a reference block. Its index is a list of the fingerprints of all its windows
(``window`` consecutive words), each with the place where it first stands: one entry for each distinct
window of a block, however often it is repeated there. The entries of all blocks are dealt into buckets
by fingerprint, so that a window meets its equals of every block in one bucket and no pair of a document
and a block is ever formed. The earliest place in a bucket is the source of all the others.

A document is then parsed greedily from left to right. At a window that has a source, the factor is grown
word by word while the source goes on too: as long as the following windows have the following places of
the same document as sources. Where a factor ends the windows across its boundary are checked on their
own, since they may stand elsewhere: they have entries like any other, and the next factor starts at the
first of them that has a source. Every factor is at least a window long; factors are the duplicate spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BLOCK_BYTES = 8 << 20  # text of a reference block
BUCKET_BYTES = 8 << 20  # text whose windows one bucket has
MOST_PACKS = 8192  # of one block; with more buckets the entries are dealt out in two steps
MARKS_AT_ONCE = 1_000_000
ROWS_AT_ONCE = 1000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# The multipliers of a 64-bit mixing step.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ENTRIES = "bucket int, kind int, data binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = np.concatenate([[False], ~SPACES[data], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time, those after the end as zeros, and the length."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) * MULTIPLIER)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    at, left, mine = starts, size, np.arange(len(starts))
    while len(mine):
        chunk = np.ascontiguousarray(eights[at]).view(np.uint64).ravel()
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        chunk = np.where(keep == 64, chunk, chunk & ((np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1)))
        out[mine] = mixed(out[mine] * MULTIPLIER + chunk)
        more = left > 8
        at, left, mine = at[more] + 8, left[more] - 8, mine[more]
    return out


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """The fingerprint of each window of consecutive words."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - window + 1, np.uint64)
    for j in range(window):
        out = out * MULTIPLIER + words[j : j + len(out)]
    return mixed(out)


class Block:
    """Texts of one reference block, in the order of their ids, and the windows of all of them."""

    def __init__(self, docs: list[tuple[int, bytes]], window: int) -> None:
        docs = sorted(docs, key=lambda d: d[0])
        data = np.frombuffer(b" ".join(text for _, text in docs), np.uint8)
        offsets = np.cumsum([0] + [len(text) + 1 for _, text in docs])
        starts, ends = word_bounds(data)
        first = np.searchsorted(starts, offsets)  # the first word of each document
        hashes = window_hashes(word_hashes(data, starts, ends), window)
        counts = np.maximum(np.diff(first) - window + 1, 0)
        doc = np.repeat(np.arange(len(docs)), counts)
        self.start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        self.hash = hashes[first[doc] + self.start]
        self.doc = np.array([d for d, _ in docs], np.int64)[doc]


class Marks(NamedTuple):
    """Windows that have an earlier source. Along a factor the source and its distance stay the same. ``check``: half the fingerprint."""

    doc: np.ndarray
    start: np.ndarray
    source_doc: np.ndarray
    distance: np.ndarray  # from the window's start to the source's
    check: np.ndarray

    def take(self, which: np.ndarray) -> Marks:
        return Marks(*[c[which] for c in self])


MARK_KINDS = [np.dtype(k) for k in ("<i8", "<i4", "<i8", "<i4", "<u4")]
KINDS = [np.dtype("<u8"), np.dtype("<i8"), np.dtype("<i4")]


def marks_of(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[Marks, np.ndarray]:
    """Marks of all windows but the earliest of each fingerprint, and the indexes of the earliest ones, by fingerprint.

    Windows at one place (of rows that repeat an id) are no earlier than each other.
    """
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order][1:] == hashes[order][:-1]
    many = np.flatnonzero(np.append(equal, False) | np.insert(equal, 0, False)) if len(order) else order
    own = order[many]
    order[many] = own = own[np.lexsort((start[own], doc[own], hashes[own]))]
    first = order[np.insert(~equal, 0, True)] if len(order) else order
    h = hashes[own]
    new = np.insert(h[1:] != h[:-1], 0, True) if len(h) else np.zeros(0, bool)
    head = own[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else own
    later = (doc[own] != doc[head]) | (start[own] != start[head])
    own, head = own[later], head[later]
    return Marks(doc[own], start[own], doc[head], start[head] - start[own], (hashes[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), first


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers as planes of bytes, compressed; sorted fingerprints come as differences."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kinds: list[np.dtype]) -> list[np.ndarray]:
    n, width = int.from_bytes(data[:4], "little"), sum(k.itemsize for k in kinds)
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=n * width, codec="zstd"), np.uint8)
    out, at = [], 0
    for k in kinds:
        out.append(np.ascontiguousarray(planes[at : at + n * k.itemsize].reshape(k.itemsize, n).T).view(k).ravel())
        at += n * k.itemsize
    return out


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])


def _mark_packs(marks: Marks, buckets: int) -> Iterator[pa.RecordBatch]:
    """Marks as one row for each bucket of documents, in the order of their places."""
    if not len(marks.doc):
        return
    bucket = (mixed(marks.doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((marks.start, marks.doc, bucket))
    bucket, marks = bucket[order], marks.take(order)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    yield _batch([(int(bucket[a]), 1, packed([c[a:b] for c in marks])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def index_blocks(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows of the indexes of all blocks: kind 0, entries of a block in one bucket of fingerprints; kind 1, marks inside a block for one bucket of documents."""

    def index(docs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        block = Block(docs, window)
        marks, first = marks_of(block.hash, block.doc, block.start)
        yield from _mark_packs(marks, buckets)
        yield from _packs(block.hash[first], block.doc[first], block.start[first], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = text.as_buffer()
                if held and size + own.size > BLOCK_BYTES:
                    yield from index(held)
                    held, size = [], 0
                held.append((doc, own.to_pybytes()))
                size += own.size + 1
        if held:
            yield from index(held)

    return docs.mapInArrow(run, ENTRIES)


def _packs(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries with ascending fingerprints as one row for each bucket that has some."""
    bucket = _bucket(hashes, buckets)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield _batch([(int(bucket[a]), 0, packed([np.diff(hashes[a:b], prepend=np.uint64(0)), doc[a:b], start[a:b]]))])


def _unpacked(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [unpacked(p, KINDS) for p in packs]
    hashes, doc, start = (np.concatenate(c) for c in zip(*[(np.cumsum(h, dtype=np.uint64), d, s) for h, d, s in parts], strict=True))
    return hashes, doc, start


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The range of fingerprints that each belongs to: monotone, ``buckets`` of equal width."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def divided(entries: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Entries packed by few wide buckets (``groups``) packed again by ``buckets``, so that packs stay worth a row."""

    def divide(packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        hashes, doc, start = _unpacked(packs)
        order = np.argsort(hashes, kind="stable")
        yield from _packs(hashes[order], doc[order], start[order], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packs, size = None, [], 0
        for batch in batches:
            for bucket, kind, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 1:
                    yield _batch([(bucket, kind, data)])
                else:
                    if packs and (bucket != key or size > BLOCK_BYTES):
                        yield from divide(packs)
                        packs, size = [], 0
                    key, size = bucket, size + len(data)
                    packs.append(data)
        if packs:
            yield from divide(packs)

    return entries.repartition(groups, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, ENTRIES)


def sources(entries: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    """Marks of the windows that have an earlier source, from the buckets and from inside the blocks, packed by buckets of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packs = None, []
        for batch in batches:
            for bucket, kind, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 1:
                    yield _batch([(bucket, kind, data)])
                    continue
                if bucket != key and packs:
                    yield from _mark_packs(marks_of(*_unpacked(packs))[0], doc_buckets)
                    packs = []
                key = bucket
                packs.append(data)
        if packs:
            yield from _mark_packs(marks_of(*_unpacked(packs))[0], doc_buckets)

    return entries.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, ENTRIES)


def by_document(packs: DataFrame, doc_buckets: int) -> DataFrame:
    """``doc, data``: the marks of each document, in one row or, where a bucket has very many marks, in several."""

    def rows_of(packs: list[bytes]) -> pa.RecordBatch:
        marks = Marks(*[np.concatenate(c) for c in zip(*[unpacked(p, MARK_KINDS) for p in packs], strict=True)])
        marks = marks.take(np.lexsort((marks.start, marks.doc)))
        cuts = [0, *(np.flatnonzero(np.diff(marks.doc)) + 1).tolist(), len(marks.doc)]
        data = [packed([c[a:b] for c in marks[1:]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(marks.doc[cuts[:-1]], pa.int64()), pa.array(data, pa.binary())], names=["doc", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and (bucket != key or size > MARKS_AT_ONCE):
                    yield rows_of(held)
                    held, size = [], 0
                key, size = bucket, size + int.from_bytes(data[:4], "little")
                held.append(data)
        if held:
            yield rows_of(held)

    return packs.repartition(doc_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, data binary")


def factors(start: np.ndarray, source_doc: np.ndarray, distance: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse of one document from its marks in order: (start, words, source document, source start) of its factors."""
    if not len(start):
        return []
    ends = (np.diff(start) != 1) | (np.diff(source_doc) != 0) | (np.diff(distance) != 0)
    first = np.flatnonzero(np.insert(ends, 0, True))
    last = np.append(first[1:], len(start)) - 1
    return list(zip(start[first].tolist(), (start[last] - start[first] + window).tolist(), source_doc[first].tolist(), (start[first] + distance[first]).tolist(), strict=True))


def covered(parse: list[tuple[int, int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words the factors cover."""
    edge = np.zeros(n + 1, np.int64)
    for start, size, _, _ in parse:
        edge[start] += 1
        edge[start + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, kept`` (text), ``factors``.

    Words are what ASCII white space separates, taken as they are. A word is removed when a window that
    covers it also starts earlier: in a document of a smaller id, or in the same one. Windows are judged
    on the input. ``kept`` has the other words, joined by one space; ``factors`` (array of start, words,
    source_doc, source_start) says where each removed span stands first. Null and empty texts have no
    words; texts of fewer words than a window lose none. Rows with a null id lose nothing and are no
    source. Of rows that repeat an id, each is judged by its own words, and windows that start at the same
    word of two of them are no earlier than each other; a source may be in any of them. Texts of any
    length are taken whole. Other columns are ignored. An empty table gives an empty result. Fingerprints
    have 64 bits.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    groups = min(buckets, MOST_PACKS)
    entries = index_blocks(rows.where(F.col("doc_id").isNotNull()), window, groups)
    marked = by_document(sources(entries if groups == buckets else divided(entries, groups, buckets), buckets, groups), groups)
    marked = marked.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("data").alias("marks"))  # at most the windows of one document

    def own_factors(text: str, packs: list[bytes]) -> list[tuple[int, int, int, int]]:
        start, source_doc, distance, check = (np.concatenate(c) for c in zip(*[unpacked(p, MARK_KINDS[1:]) for p in packs], strict=True))
        data = np.frombuffer(text.encode(), np.uint8)
        hashes = window_hashes(word_hashes(data, *word_bounds(data)), window) & np.uint64(0xFFFFFFFF)
        own = np.flatnonzero(start < len(hashes))
        own = own[hashes[start[own]] == check[own]]  # marks of another row with this id go
        own = own[np.unique(start[own], return_index=True)[1]]  # equal rows have the same marks
        return factors(start[own], source_doc[own], distance[own], window)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            out: list[list] = [[], [], [], []]
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, gone, found = WORD.findall(text), None, []
                if marks:
                    found = own_factors(text, marks)
                    gone = covered(found, len(words))
                out[0].append(len(words))
                out[1].append(0 if gone is None else int(gone.sum()))
                out[2].append(" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
                out[3].append([dict(zip(("start", "words", "source_doc", "source_start"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], FACTORS)], names=["doc_id", "n_words", "n_removed", "kept", "factors"])

    id_type = dict(rows.dtypes)["doc_id"]
    return rows.join(marked, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(parse, f"doc_id {id_type}, n_words long, n_removed long, kept string, factors array<struct<start:bigint,words:bigint,source_doc:bigint,source_start:bigint>>")


FACTORS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "source_doc", "source_start")]))
