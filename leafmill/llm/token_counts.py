"""Token counts per document without materialising ids.

Documents are read twice. First all are split into pre-tokens, and each distinct pre-token has its pieces
counted once by the library, in a table of pre-tokens. Then the pre-token frequencies of each document
are joined to the counts and summed. The join has two parts: the most frequent pre-tokens, as many as fit a
broadcast of ``broadcast_bytes``, are looked up where the documents are split; the few that are left
of each document are joined by a shuffle.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import shipped_file, worker_state, written

CACHED = 400_000
LONG = 64  # characters; longer chunks and pre-tokens, as of texts without spaces, are held no longer than their text
BLOCK = 256
OTHER_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def chunks_of(text: str, split: Callable[[str], list[str]]) -> list[str]:
    """Chunks that end where pre-tokens end, so that splitting each gives the pre-tokens of the text.

    Where all white space is single spaces and newlines between words, each space begins a pre-token
    together with the word after it, so the text may be cut before spaces; this holds for patterns that
    take a space and the letters, digits or signs after it as one match and never go on over a space.
    Any other text is split by the pattern itself.
    """
    if not any(c in text for c in OTHER_WHITE) and len(text.split()) == text.count(" ") + text.count("\n") + 1:
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]
    return split(text)


def _tokenizer(content: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content.decode())


def _state(file) -> dict:
    """What a worker keeps for one tokenizer file: the tokenizer, and what tasks add."""
    return worker_state("token_counts", file.value[0], lambda: {"tokenizer": _tokenizer(file.value[1])})


def _specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def pre_token_counts(texts: DataFrame, file, pattern: str) -> DataFrame:
    """``piece, n, n_tokens``: each distinct pre-token of the column ``text``, its occurrences and its tokens.

    Texts in which a special token stands are left out. Occurrences are combined in each task and again
    before they are shuffled; the tokens of a pre-token are counted once.
    """

    def split_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = _specials(_state(file)["tokenizer"])
        split = regex.compile(pattern).findall

        def rows(pieces: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], names=["piece", "n"])

        def out(chunks: Counter, found: Counter) -> pa.RecordBatch:
            for c, n in chunks.items():
                for p in split(c):
                    found[p] += n
            return rows(found)

        chunks, found = Counter(), Counter()  # of at most LONG characters
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for text in batch.column(0).slice(at, BLOCK).to_pylist():
                    if not text or any(s in text for s in specials):
                        continue
                    own = chunks_of(text, split)
                    if max(map(len, own)) > LONG:
                        long = Counter(p for c in own if len(c) > LONG for p in split(c))
                        own = [c for c in own if len(c) <= LONG]
                        found.update({p: n for p, n in long.items() if len(p) <= LONG})
                        if long := Counter({p: n for p, n in long.items() if len(p) > LONG}):
                            yield rows(long)
                    chunks.update(own)
                    if len(chunks) + len(found) > CACHED:
                        yield out(chunks, found)
                        chunks.clear()
                        found.clear()
        yield out(chunks, found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _state(file)["tokenizer"]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sizes = map(len, tokenizer.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(sizes), pa.int32())], names=["piece", "n", "n_tokens"])

    distinct = texts.mapInArrow(split_all, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return written(distinct.mapInArrow(count, "piece string, n long, n_tokens int"), "pre-tokens")


def frequent(pieces: DataFrame, most_bytes: int) -> int:
    """The least ``grade`` of frequency whose pre-tokens, with all of higher ones, fit ``most_bytes``."""
    sizes = pieces.groupBy("grade").agg(F.sum(F.octet_length("piece") + 5).alias("size")).collect()  # at most 4096 rows
    least, room = 4097, most_bytes
    for r in sorted(sizes, key=lambda r: -r["grade"]):
        room -= r["size"]
        if room < 0:
            break
        least = r["grade"]
    return least


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, broadcast_bytes: int = 6 << 20) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    The tokens are those of the library for the whole text, a null text counting as empty, without
    added special tokens; texts in which a special token stands go to the library whole. ``pattern``
    is the tokenizer's own rule for pre-tokens. Texts and pre-tokens may have any length; what a worker keeps
    is bounded in bytes. Repeated rows
    and ids are counted each; other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    file = shipped_file(spark, tokenizer_path)
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = pre_token_counts(docs.select(F.col(text_col).alias("text")), file, pattern)
    pieces = pieces.withColumn("grade", F.floor(64 * F.log2("n")))
    least = frequent(pieces, broadcast_bytes)
    table = pieces.where(F.col("grade") >= least).select("piece", "n_tokens").toArrow()
    known = spark.sparkContext.broadcast((table["piece"].combine_chunks(), table["n_tokens"].to_numpy()))

    name = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _state(file)
        if state.get("name") != name:
            names, sizes = known.value
            state.update(name=name, chunks={}, counts=dict(zip(names.to_pylist(), sizes.tolist(), strict=True)))
        tokenizer, counts, chunks = state["tokenizer"], state["counts"], state["chunks"]  # by chunk: its tokens, or those of its frequent pre-tokens and the others
        specials = _specials(tokenizer)
        split = regex.compile(pattern).findall
        uid = TaskContext.get().partitionId() << 33

        def judged(chunk: str) -> int | tuple[int, list[str]]:
            own = split(chunk)
            rest = [p for p in own if p not in counts]
            n = sum([counts[p] for p in own if p in counts])
            return (n, rest) if rest else n

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if len(chunks) > CACHED:
                    chunks.clear()
                texts = [t or "" for t in part.column(1).to_pylist()]
                sums, offsets, rest, times = [], [0], [], []
                for t in texts:
                    if any(s in t for s in specials):
                        sums.append(len(tokenizer.encode(t, add_special_tokens=False)))
                        offsets.append(len(rest))
                        continue
                    n, own = 0, Counter()
                    for c, k in Counter(chunks_of(t, split)).items():
                        v = chunks.get(c)
                        if v is None:
                            v = judged(c)
                            if len(c) <= LONG:
                                chunks[c] = v
                        if isinstance(v, int):
                            n += k * v
                        else:
                            n += k * v[0]
                            for p in v[1]:
                                own[p] += k
                    sums.append(n)
                    rest += own
                    times += own.values()
                    offsets.append(len(rest))
                offsets = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(uid, uid + len(texts)), pa.int64()),
                        part.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(sums, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(rest, pa.string())),
                        pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                    ],
                    names=["uid", "doc_id", "n_bytes", "n_tokens", "rest", "times"],
                )
                uid += len(texts)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, f"uid long, doc_id {kind}, n_bytes long, n_tokens long, rest array<string>, times array<long>")
    rows = written(rows, "token-rows")
    others = rows.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("piece"), F.col("x.times").alias("times"))
    rare = pieces.where(F.col("grade") < least).select("piece", F.col("n_tokens").alias("each"))
    added = others.join(rare, "piece").groupBy("uid").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
    whole = rows.select("uid", "doc_id", "n_bytes", "n_tokens").join(added, "uid", "left")
    return whole.select("doc_id", "n_bytes", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
