"""Best-fit packing of tokenised documents with bound-certified repacking.

Pieces (documents, or 2048-token cuts of longer ones) are dealt at random over partitions of about
``part_rows`` pieces. Each partition is packed by best-fit decreasing and gets a lower bound on its
bins from dual-feasible functions. A partition that meets its bound is certified: its bins are final,
but for the least filled one. From partitions with a gap only bins without waste are final. The
documents of all other bins form a pool that is dealt anew, so that partitions exchange documents, and
packed again, until the pool fits one partition, a round gains nothing, or ``max_rounds`` have run.
No task sees more than about ``part_rows`` pieces, and only lengths and ids are shuffled, not texts.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import new_path, shipped_file, worker_state

WORDS = 250_000
LONG = 64  # characters; ids of longer words, as of texts without spaces, are not kept
# A mark right after a letter; not the apostrophe, which a tokenizer may take together with letters.
MARK = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[A-Za-zÀ-ÖØ-öø-ÿ].)")


def lowered(text: str) -> str:
    """A text as a lower-casing tokenizer reads it, where all characters are in Latin-1, for which every lower-casing rule says the same."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def chunk_encoder(key: str, content: bytes):
    """A function from texts to little-endian unsigned 32-bit ids, for tokenizers that lower-case, drop white space and part letters from marks.

    The ids of a text are those of its words in a row, which white space parts, and marks after letters.
    Distinct words are encoded by the library and kept in a cache that tasks of one worker share. A full cache becomes that
    of words ``before``, from which those still in use are taken over, so it is bounded in number and length.
    Texts in which a special token could stand, or separators that only Python takes for white space,
    go to the library whole.
    """

    def make() -> tuple:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        vocabulary = tokenizer.get_vocab()
        ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        return tokenizer, ends_word, {}, {}

    tokenizer, ends_word, words, before = worker_state("packing", key, make)
    apart = [*[t.content for t in tokenizer.get_added_tokens_decoder().values()], "\x1c", "\x1d", "\x1e", "\x1f"]

    def learn(new: set[str]) -> None:
        """Encodes words. Those of Latin-1 letters are one pre-token each, so many go in one call and are told apart by their ends."""
        plain = [w for w in new if w.isalpha() and (w.isascii() or max(w) < "\u0100")]
        single = list(new.difference(plain))
        packs = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for own, e in zip(packs, tokenizer.encode_batch_fast([" ".join(x) for x in packs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = (4 * np.flatnonzero(ends_word[ids]) + 4).tolist()
            if len(ends) != len(own):
                single += own
                continue
            raw = ids.tobytes()
            words.update(zip(own, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for w, e in zip(single, tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True):
            words[w] = array("I", e.ids).tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        low = [lowered(t) for t in texts]
        whole = {i for i, (t, x) in enumerate(zip(texts, low, strict=True)) if any(s in t or s in x for s in apart)}
        split = [[] if i in whole else MARK.sub(r" \g<0>", x).split() for i, x in enumerate(low)]
        if len(words) > WORDS:
            before.clear()
            before.update(words)
            words.clear()
        new = set().union(*split).difference(words)
        words.update([(w, before[w]) for w in new if w in before])
        learn(new.difference(words))
        get = words.__getitem__
        found = [array("I", tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes() if i in whole else b"".join(map(get, ws)) for i, ws in enumerate(split)]
        for w in new:
            if len(w) > LONG:
                del words[w]
        return found

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document: ``doc_id, piece, start, length, ids_crc32``.

    The ids of a document are those of its whole text without special tokens, then ``end_id``; a null
    text counts as empty. Ids longer than ``capacity`` are cut into pieces of that length, the last of
    which may be shorter. Texts of any length are taken whole. Rows that repeat an id or a text, or have
    a null id, have pieces of their own. Other columns of ``docs`` are ignored, whatever their names. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    file = shipped_file(spark, tokenizer_path)
    key = docs.schema[id_col].dataType
    schema = f"doc_id {key.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(*file.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                take, numbers, starts, lengths, sums = [], [], [], [], []
                for row, raw in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                        ids = raw[start : start + 4 * capacity]
                        take.append(row)
                        numbers.append(k)
                        starts.append(start // 4)
                        lengths.append(len(ids) // 4)
                        sums.append(zlib.crc32(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take, pa.int32())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several dual-feasible-function bounds on the number of bins."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = math.ceil(int((count * size).sum()) / capacity)
    for k in range(1, 33):  # u_k keeps multiples of capacity / (k + 1) and rounds others down to 1 / k
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    items, weight = np.cumsum(count), np.cumsum(count * size)
    half = capacity // 2
    a = np.arange(1, half + 1)  # sizes over capacity - a count whole, those in [a, capacity - a] by size, smaller ones not
    whole = items[capacity] - items[capacity - a]
    best = max(best, int((whole + -(-(weight[capacity - a] - weight[a - 1]) // capacity)).max()))
    large = items[capacity - a] - items[half]
    room = large * capacity - (weight[capacity - a] - weight[half])
    small = weight[half] - weight[a - 1]
    return max(best, int((whole + large + np.maximum(0, -(-(small - room) // capacity))).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of each item, and the fill of each bin. Ties: items in the given order, the bin opened last."""
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        w = int(lengths[i])
        fits = have >> w
        if fits:
            r = w + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                have ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += w
        if r > w:
            free[r - w].append(b)
            have |= 1 << (r - w)
    return bins, offsets, np.array(fill, np.int64)


def _pack_part(round_: int, last: bool, capacity: int):
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = part["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        if last:
            final = np.ones(len(fill), bool)
        elif len(fill) == lower_bound(lengths, capacity):
            final = np.arange(len(fill)) != int(fill.argmin())
        else:
            final = fill == capacity
        name = (np.int64(round_) << 56) + (part["part"].to_numpy(np.int64) << 24)
        return part.assign(sequence_id=name + bins, offset=offsets, final=final[bins])

    return pack


def pack(pieces: DataFrame, capacity: int = 2048, part_rows: int = 16384, max_rounds: int = 6) -> DataFrame:
    """``pieces`` (``doc_id, piece, start, length, ids_crc32``) with ``sequence_id`` and ``offset``.

    A sequence holds pieces of at most ``capacity`` tokens in all, gapless from offset 0. Equal pieces,
    repeated rows and null ids are packed like others. An empty input gives an empty result.
    """
    spark, done = pieces.sparkSession, []
    columns = "doc_id, piece, start, length, ids_crc32"
    schema = pieces.select(*columns.split(", ")).schema
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", part int, sequence_id long, offset long, final boolean"

    base = new_path(spark, "pack-pieces")
    pieces.select(*columns.split(", "), F.rand(7).alias("_deal")).write.parquet(base)
    pool = spark.read.parquet(base)
    rows, before, held = pool.count(), None, None
    for round_ in range(max_rounds):
        parts = max(1, math.ceil(rows / part_rows))
        last = parts == 1 or round_ == max_rounds - 1
        deal = F.pmod(F.xxhash64("doc_id", "piece", "_deal", F.lit(round_)), F.lit(parts)).cast("int")
        path = new_path(spark, f"pack-round{round_}")
        pool.withColumn("part", deal).drop("_deal").groupBy("part").applyInPandas(_pack_part(round_, last, capacity), out_schema).write.parquet(path)
        out = spark.read.parquet(path)
        if before is not None and out.select("sequence_id").distinct().count() > before:
            break  # the exchange gained nothing: the bins of the round before stay
        if held is not None:
            done.append(held.where("final"))
        held = out
        rest = out.where(~F.col("final"))
        rows = rest.count()
        if not rows:
            break
        before = rest.select("sequence_id").distinct().count()
        pool = rest.select(*columns.split(", "), F.rand(round_).alias("_deal"))
    done.append(held)
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    return packed.select(*columns.split(", "), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """The pieces of all documents, packed; see ``pieces`` and ``pack``."""
    return pack(pieces(docs, tokenizer_path, id_col, text_col, capacity), capacity)


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences used and the lower bound over all pieces, from a histogram of at most ``capacity`` lengths."""
    spark: SparkSession = packed.sparkSession
    hist = packed.groupBy("length").count().collect()  # at most ``capacity`` rows
    lengths = np.repeat([r["length"] for r in hist], [r["count"] for r in hist]).astype(np.int64)
    used = packed.select("sequence_id").distinct().count()
    return spark.createDataFrame([(used, lower_bound(lengths, capacity))], "sequences long, lower_bound long")
