"""N-gram Jaccard self-join as a blocked sparse matrix product.

The incidence matrix (documents by word shingles, 64-bit hashes) is cut into blocks: some thousand
documents by one bucket of shingles, each block a packed pair of arrays. Bringing the blocks of one
bucket together gives the number of documents of every shingle. A shingle of one document adds to no
overlap, so only entries of shared shingles return to their document block; one that several documents
of a block have is one entry there, so a bucket holds a frequent shingle once for each block. A document of n shingles
links to nothing unless ceil(0.8 n) of its entries remain; most documents end here, and of the others
equal sets become one class.

The columns of the remaining rows are ordered by document frequency. Two sets of similarity t share one
of the first n - ceil(t n) + 1, the rare columns. The product is formed in two steps. The product of the
rare columns is made cell by cell, a cell being one column by one pair of row chunks, so that a very
frequent shingle is many cells; overlaps are accumulated over the cells of a bucket and summed over
buckets, and pairs go whose sizes, parity bits or accumulated overlaps rule out the bound. For the pairs
that are left, the mask, the full overlaps are formed block by block and held against the bound.

Large groups of near copies are not expanded into pairs. First each document meets one pivot for each of
its rare shingles, and components are contracted; then the product is formed for pairs across components
only, and for all of those, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import written
from leafmill.llm.graph import components, contracted

BLOCK_DOCS, BLOCK_CHARS = 2048, 6_000_000
PARITY_WORDS = 8
CHUNK, PAIRS, BUCKET_ROWS, BLOCK_BYTES = 1024, 2_000_000, 100_000, 16_000_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)  # any odd numbers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document number, shingle hash) pairs of some texts, sorted.

    A-Z are lower-cased; words are what ASCII white space separates. A text of fewer than ``width``
    words has its whole sequence as one shingle, a text without words has none.
    """
    words = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, total)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    full = np.arange(total) + width <= ends
    hashes = np.zeros(total, np.uint64)
    at = np.flatnonzero(full)
    for k in range(width):
        hashes[at] = _mixed(hashes[at] + codes[at + k] * MULTIPLIERS[k % len(MULTIPLIERS)])
    whole = []
    starts = np.cumsum(sizes) - sizes
    for i in np.flatnonzero((sizes > 0) & (sizes < width)).tolist():
        s = int(starts[i])
        hashes[s] = xxhash.xxh3_64_intdigest(b" ".join(words[i]), seed=int(sizes[i]))
        whole.append(s)
    full[whole] = True
    doc, hashes = doc[full], hashes[full]
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _blocks(width: int, buckets: int, id_type: pa.DataType):
    """A row for each block of documents, and one for each bucket of its shingles.

    A shingle that several documents of the block have goes to its bucket as one entry with their number,
    so that a very frequent one is an entry a block there; which documents they are stays in the block's row.
    """
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(id_type)), *[(c, pa.binary()) for c in ("sizes", "hashes", "docs", "counts")]])

    def rows(ids: pa.Array, texts: list[str | None], block: int) -> pa.RecordBatch:
        doc, hashes = shingles(texts, width)
        sizes = np.bincount(doc, minlength=len(texts)).astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        doc, hashes = doc[order].astype(np.uint16), hashes[order]
        starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(hashes)))
        several = np.repeat(counts > 1, counts)
        one, first, n = hashes[starts], doc[starts], counts.astype(np.uint16)
        bucket = ((one >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, one, first, n = bucket[order], one[order], first[order], n[order]
        there, cuts = np.unique(bucket, return_index=True)
        bounds = [*cuts.tolist(), len(bucket)]
        spans = list(zip(bounds, bounds[1:], strict=False)) if len(there) else []
        none = [None] * len(spans)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block % buckets, *there.tolist()], pa.int32()),
                pa.array([block] * (len(spans) + 1), pa.int64()),
                pa.array([ids.to_pylist(), *none], pa.list_(id_type)),
                pa.array([sizes.tobytes(), *none], pa.binary()),
                pa.array([hashes[several].tobytes(), *[one[a:b].tobytes() for a, b in spans]], pa.binary()),
                pa.array([doc[several].tobytes(), *[first[a:b].tobytes() for a, b in spans]], pa.binary()),
                pa.array([None, *[n[a:b].tobytes() for a, b in spans]], pa.binary()),
            ],
            schema=schema,
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and end - at < BLOCK_DOCS and chars < BLOCK_CHARS:
                    chars += len(texts[end] or "")
                    end += 1
                yield rows(batch.column(0).slice(at, end - at), texts[at:end], block)
                block, at = block + 1, end

    return make


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: the entries of shingles that more than one document has, with document frequencies; the blocks' rows pass.

    Of an entry that stands for several documents of its block, ``docs`` has one of them.
    """
    heads = table.filter(pc.is_valid(table["sizes"]))
    parts = table.filter(pc.is_valid(table["counts"]))
    arrays = [np.frombuffer(x, np.uint64) for x in parts["hashes"].to_pylist()]
    out = {c: heads[c].to_pylist() for c in ("block", "ids", "sizes", "hashes", "docs")} | {"counts": [None] * len(heads)}
    if arrays:
        every = np.concatenate(arrays)
        own = np.concatenate([np.frombuffer(x, np.uint16) for x in parts["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        count = np.empty(len(every), np.uint32)
        count[order] = np.repeat(np.minimum(np.add.reduceat(own[order], starts), 0xFFFFFFFF), np.diff(np.append(starts, len(ordered))))
        at = 0
        for block, mine, docs in zip(parts["block"].to_pylist(), arrays, parts["docs"].to_pylist(), strict=True):
            c = count[at : at + len(mine)]
            at += len(mine)
            keep = c > 1
            if keep.any():
                for k, v in (("block", block), ("ids", None), ("sizes", None), ("hashes", mine[keep].tobytes()), ("docs", np.frombuffer(docs, np.uint16)[keep].tobytes()), ("counts", c[keep].tobytes())):
                    out[k].append(v)
    return pa.table([pa.array(out["block"], pa.int64()), pa.array(out["ids"], table.schema.field("ids").type), *[pa.array(out[k], pa.binary()) for k in ("sizes", "hashes", "docs", "counts")]], names=["block", "ids", "sizes", "hashes", "docs", "counts"])


def _rows(percent: int):
    """Of one document block: ``uid, doc_id, n, shared`` for each document; ``shared`` is null if the bound can't be reached."""

    def rows(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_valid(table["sizes"]))
        parts = table.filter(pc.is_valid(table["counts"]))
        block = head["block"][0].as_py()
        sizes = np.frombuffer(head["sizes"][0].as_py(), np.int32).astype(np.int64)
        join = lambda part, name, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in part[name].to_pylist()]])
        hashes, docs, counts = join(parts, "hashes", np.uint64), join(parts, "docs", np.uint16), join(parts, "counts", np.uint32)
        order = np.argsort(hashes, kind="stable")  # each shingle once
        hashes, docs, counts = hashes[order], docs[order], counts[order]
        several, which = join(head, "hashes", np.uint64), join(head, "docs", np.uint16)
        alone = np.ones(len(hashes), bool)
        place = np.searchsorted(hashes, several)
        alone[place] = False
        hashes, docs, counts = np.concatenate([hashes[alone], several]), np.concatenate([docs[alone], which]).astype(np.int64), np.concatenate([counts[alone], counts[place]])
        order = np.lexsort((hashes, counts, docs))
        hashes = hashes[order]
        left = np.bincount(docs, minlength=len(sizes))
        ends = np.cumsum(left)
        need = -(-percent * sizes // 100)
        shared = [hashes[e - k : e].tobytes() if n and k >= m else None for n, k, e, m in zip(sizes.tolist(), left.tolist(), ends.tolist(), need.tolist(), strict=True)]
        uid = (block << 16) + np.arange(len(sizes), dtype=np.int64)
        return pa.table([pa.array(uid), head["ids"].combine_chunks().values.slice(0, len(sizes)) if len(head) else head["ids"], pa.array(sizes), pa.array(shared, pa.binary())], names=["uid", "doc_id", "n", "shared"])

    return rows


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i all of ``starts[i]`` up to ``ends[i]``: the numbers i and the members, flat."""
    sizes = np.maximum(ends - starts, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def _cells_product(percent: int, words: int = PARITY_WORDS):
    """The product of rare columns inside one bucket of cells: ``a, b, na, nb, overlap`` for pairs of different components.

    A cell is one column (shingle) by one pair of row chunks. Overlaps are accumulated over the columns
    of the bucket; pairs whose sizes or parities rule out the bound go before that.
    """

    def product(table: pa.Table) -> pa.Table:
        h, side, uid, n, alone, component, diagonal = (_column(table, c) for c in ("cell", "side", "uid", "n", "alone", "component", "diagonal"))
        parity = np.frombuffer(b"".join(table["parity"].to_pylist()), np.uint64).reshape(len(h), words)
        order = np.lexsort((uid, side, h))
        h, side, uid, n, alone, component, diagonal, parity = (x[order] for x in (h, side, uid, n, alone, component, diagonal, parity))
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        cell = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(h))[cell] if len(h) else np.zeros(0, np.int64)
        rights = np.searchsorted(2 * cell + side, 2 * cell + 1)  # where the right side of the row's cell begins
        starts = np.where(diagonal, np.arange(len(h)) + 1, np.where(side == 0, rights, ends))
        found: list[np.ndarray] = []
        at = 0
        while at < len(h):  # some million pairs at a time
            total = np.cumsum(np.maximum(ends[at:] - starts[at:], 0))
            stop = at + max(1, int(np.searchsorted(total, PAIRS)))
            x, y = _ranges(starts[at:stop], ends[at:stop])
            x, at = x + at, stop
            keep = (component[x] != component[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[keep], y[keep]
            least = alone[x] + alone[y] + np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
            keep = (100 + percent) * least <= (100 - percent) * (n[x] + n[y])
            x, y = x[keep], y[keep]
            low = uid[x] < uid[y]
            found.append(np.stack([np.where(low, uid[x], uid[y]), np.where(low, uid[y], uid[x]), np.where(low, n[x], n[y]), np.where(low, n[y], n[x])], axis=1))
        pairs, overlap = np.unique(np.concatenate([np.zeros((0, 4), np.int64), *found]), axis=0, return_counts=True)
        return pa.table([*[pa.array(pairs[:, i]) for i in range(4)], pa.array(overlap.astype(np.int64))], names=["a", "b", "na", "nb", "overlap"])

    return product


def _masked_product(table: pa.Table) -> pa.Table:
    """The full overlaps of the pairs of one block: rows with ``a`` are pairs and hold a's entries, those without hold b's.

    Only the entries of the product that the pairs name are formed. Each entry of a's row is looked up
    among those of b, for all pairs of the block at once.
    """
    masks = pc.is_valid(table["a"])
    pairs, rows = table.filter(masks), table.filter(pc.invert(masks))

    def entries(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        raw = part["shared"].to_pylist()
        return np.frombuffer(b"".join(raw), np.uint64), np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])

    order = np.argsort(_column(rows, "b"), kind="stable")
    names = _column(rows, "b")[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    hashes, owner = entries(rows)
    columns = np.unique(hashes)
    known = np.sort(place[owner] * len(columns) + np.searchsorted(columns, hashes))  # entries of b's rows as row and column
    mine, pair = entries(pairs)
    column = np.minimum(np.searchsorted(columns, mine), len(columns) - 1)
    there = columns[column] == mine
    row = np.searchsorted(names, _column(pairs, "b"))[pair[there]]
    wanted = row * len(columns) + column[there]
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    overlap = np.bincount(pair[there][known[at] == wanted], minlength=len(pairs))
    nb = _column(rows, "n")[order][np.searchsorted(names, _column(pairs, "b"))]
    return pa.table([pairs["a"], pairs["b"], pairs["n"], pa.array(nb), pa.array(overlap.astype(np.int64))], names=["a", "b", "na", "nb", "overlap"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, star_rounds: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets; the
    component is named by the smallest doc_id that links reach, the document itself included. Texts
    that are null or without words have the empty set, which links with nothing. Texts of any length
    are taken whole; a very long one is a block of its own. Rows that repeat an id or a text are
    documents of their own. A row with a null id takes part; it names no component. Other columns of
    ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(128, chars // 6_000_000)  # about a million entries each
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = texts.select("doc_id").limit(0).toArrow().schema.field(0).type

    blocks = texts.mapInArrow(_blocks(width, buckets, id_type), f"bucket int, block long, ids array<{kind}>, sizes binary, hashes binary, docs binary, counts binary")
    shared = blocks.groupBy("bucket").applyInArrow(_shared, f"block long, ids array<{kind}>, sizes binary, hashes binary, docs binary, counts binary")
    rows = shared.groupBy("block").applyInArrow(_rows(percent), f"uid long, doc_id {kind}, n long, shared binary")
    rows = written(rows.withColumn("class", F.when(F.col("shared").isNotNull(), F.when(F.length("shared") == 8 * F.col("n"), F.sha2("shared", 256)).otherwise(F.col("uid").cast("string")))), "jaccard-rows")

    # Equal sets have all their shingles in common, so all of them are shared.
    live = rows.where(F.col("class").isNotNull())
    classes = written(live.groupBy("class").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least")), "jaccard-classes")
    sets = written(live.join(classes.select("uid"), "uid", "left_semi").select("uid", "n", "shared"), "jaccard-sets")

    links = _links(sets, percent, star_rounds)
    found = components(links).withColumnRenamed("vertex", "uid")
    named = classes.join(found, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = written(named.join(names, "component").select("class", "component_id"), "jaccard-names")
    return rows.join(names, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _prefixes(percent: int):
    """``uid, n, alone, parity`` of each set, and its rarest shared shingles ``h``, one of which every link shares."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, alone, parity = [], [], []
            for n, raw in zip(batch["n"].to_pylist(), batch["shared"].to_pylist(), strict=True):
                own = np.frombuffer(raw, np.int64)
                p = n + (-percent * n // 100) + 1 - (n - len(own))  # unshared ones come first in the order
                first.append(own[:p])
                alone.append(n - len(own))
                odd = np.bincount((own.view(np.uint64) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).tobytes())
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in first]))).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["n"], pa.array(alone, pa.int64()), pa.array(parity, pa.binary()), rare], names=["uid", "n", "alone", "parity", "rare"])

    return prefixes


def _possible(percent: int) -> Column:
    """Whether sizes and parities let a pair ``a, b`` reach the bound.

    The shingles that only one of two sets has are at least those that no other document has, and
    one for each bit in which the parities of the hashed rest differ.
    """
    word = lambda end, i: F.conv(F.hex(F.substring(f"parity_{end}", 8 * i + 1, 8)), 16, -10).cast("long")
    least = F.col("alone_a") + F.col("alone_b") + sum(F.bit_count(word("a", i).bitwiseXOR(word("b", i))) for i in range(PARITY_WORDS))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((100 + percent) * least <= (100 - percent) * (F.col("na") + F.col("nb")))


def _links(sets: DataFrame, percent: int, star_rounds: int) -> DataFrame:
    """All links ``a, b`` that components need, among documents with different sets."""
    rows = written(sets.mapInArrow(_prefixes(percent), "uid long, n long, alone long, parity binary, rare array<long>"), "jaccard-prefixes")
    meta = rows.select("uid", "n", "alone", "parity")

    def overlapping(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs ``a, b, na``: those whose full overlap reaches the bound of their sizes.

        Pairs are dealt to blocks by b; a b of very many pairs is in several blocks.
        """
        pairs = written(pairs, "jaccard-pairs")
        blocks = max(1, (pairs.agg(F.sum("na")).first()[0] or 0) * 8 // BLOCK_BYTES)
        many = pairs.groupBy("b").agg(F.expr(f"count(*) div {CHUNK} + 1").alias("shares"))
        dealt = written(pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), "shares")), F.lit(blocks)).alias("block")), "jaccard-dealt")
        left = dealt.join(sets.withColumnRenamed("uid", "a"), "a").select("block", "a", "b", "n", "shared")
        right = dealt.select("block", "b").distinct().join(sets.withColumnRenamed("uid", "b"), "b").select("block", F.lit(None).cast("long").alias("a"), "b", "n", "shared")
        counted = left.unionByName(right).groupBy("block").applyInArrow(_masked_product, "a long, b long, na long, nb long, overlap long")
        return written(counted.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b"), "jaccard-links")

    postings = written(rows.select("uid", F.explode("rare").alias("h"), F.col("uid").alias("component")), "jaccard-postings")
    links = None
    for round_ in range(star_rounds + 1):
        # A shingle is open while documents of different components have it.
        by_part = postings.groupBy("h", "component").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("uid", F.lit(round_)).alias("o"), "uid", "component")).alias("p"))
        by_shingle = by_part.groupBy("h").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.count("*").alias("parts"), F.min("p").alias("p"))
        open_ = written(by_shingle.where(F.col("parts") > 1).select("h", F.col("p.uid").alias("pivot"), F.col("p.component").alias("home"), "c", ((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("cross")), "jaccard-open")
        state = open_.agg(F.count("*").alias("h"), F.sum("cross").alias("cross")).first()
        if not state.h:
            break
        last = round_ == star_rounds or state.cross <= 8 * state.h
        mine = postings.join(open_, "h")
        if last:
            new = overlapping(_across(mine, meta, percent))
        else:
            pairs = mine.where(F.col("component") != F.col("home")).select(F.greatest("uid", "pivot").alias("a"), F.least("uid", "pivot").alias("b")).distinct()
            for end in ("a", "b"):
                pairs = pairs.join(meta.select(F.col("uid").alias(end), F.col("n").alias(f"n{end}"), F.col("alone").alias(f"alone_{end}"), F.col("parity").alias(f"parity_{end}")), end)
            new = overlapping(pairs.where(_possible(percent)).select("a", "b", "na"))
        links = new if links is None else links.unionByName(new)
        if last:
            break
        parts = written(contracted(links), "jaccard-parts").withColumnRenamed("vertex", "uid")
        left = postings.join(open_.select("h"), "h", "left_semi").drop("component")  # a closed shingle stays closed
        postings = written(left.join(parts, "uid", "left").withColumn("component", F.coalesce("component", "uid")), "jaccard-postings")
    return links if links is not None else sets.select(F.col("uid").alias("a"), F.col("uid").alias("b"))


def _across(postings: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """``a, b, na`` of all pairs of different components that the product of the rare columns lets reach the bound.

    ``postings`` (``h, uid, component, c``) hold the open shingles; c is the number of h's documents.
    Columns of over ``CHUNK`` documents are cut into chunks, and each pair of chunks is a cell of its own.
    Cells are dealt to buckets, in which a task accumulates the overlaps; sums over buckets complete them.
    A set has ceil(percent * n / 100) - 1 shingles beyond its rare ones, so less than the needed overlap
    less the greater of these numbers rules a pair out.
    """
    full = postings.join(meta, "uid")
    chunks = F.expr(f"cast((c - 1) div {CHUNK} + 1 as int)")
    own = full.withColumn("k", chunks).withColumn("i", F.pmod(F.xxhash64("uid"), F.col("k")).cast("int"))
    cells = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("cell", F.xxhash64("h", F.least("i", "j"), F.greatest("i", "j")))
    buckets = max(1, postings.count() // BUCKET_ROWS)
    dealt = cells.select(F.pmod(F.xxhash64("cell", F.lit(1)), F.lit(buckets)).alias("bucket"), "cell", F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"), (F.col("i") == F.col("j")).alias("diagonal"), "uid", "n", "alone", "component", "parity")
    counted = dealt.groupBy("bucket").applyInArrow(_cells_product(percent), "a long, b long, na long, nb long, overlap long")
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    rest = F.ceil(percent * F.greatest("na", "nb") / 100) - 1
    return summed.where(F.col("overlap") + rest >= need).select("a", "b", "na")
