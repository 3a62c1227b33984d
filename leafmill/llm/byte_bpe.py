"""Byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer over bytes that is determinised lazily. What is
known of a text read so far is, for each position, the last token of the encoding of the bytes up to
it: BPE has exactly one token that ends there and stands validly after the last token of the bytes
before it, where two tokens are a valid pair if the merges turn their joined bytes into just these
two. A later token can only start at a position from which the bytes read are the beginning of some
token (a live position); what the paths of all live positions share is certain and is emitted, so the
lookahead is bounded by the longest token. A state is the token before the first uncertain byte
together with the uncertain bytes; its arcs are built when a byte first takes them.

Decoding joins the bytes of tokens; streaming decode feeds them to an incremental UTF-8 state machine,
which holds back the bytes of a character that is not complete yet.
"""

from __future__ import annotations

import base64
import codecs
import gc
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import shipped_file, worker_state
from leafmill.llm.token_counts import chunks_of

STATES, CACHED = 300_000, 400_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def merged(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """BPE by its definition: the adjacent pair of lowest rank is merged, the leftmost first, until ``stop`` parts are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
        if rank == 1 << 62:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class State:
    __slots__ = ("arcs", "last", "left", "live", "pending")

    def __init__(self, left: bytes | None, pending: bytes, last: tuple[bytes, ...], live: tuple[int, ...]):
        self.left, self.pending, self.last, self.live, self.arcs = left, pending, last, live, {}

    def path(self, at: int) -> list[bytes]:
        """The tokens of the pending bytes up to ``at``, from the right."""
        tokens = []
        while at:
            tokens.append(self.last[at - 1])
            at -= len(tokens[-1])
        return tokens


class Transducer:
    """Encodes pieces byte by byte. States are dropped and built anew when there are more than ``STATES``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # The two parts whose merge makes a token. One that merging its own bytes doesn't give back never comes out.
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        for t in ranks:
            if len(t) == 1:
                self.parts[t] = None
            elif len(ends := merged(t, ranks, stop=2)) == 2 and ends[0] + ends[1] in ranks:
                self.parts[t] = (ends[0], ends[1])
        self.begins = {t[:i] for t in self.parts for i in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[tuple[bytes | None, bytes], State] = {}
        self.clear()

    def clear(self) -> None:
        for s in self.states.values():
            s.arcs.clear()  # states refer to each other
        self.states = {}
        self.start = self.state(None, b"", (), (0,))
        if len(self.pairs) > STATES:
            self.pairs.clear()

    def state(self, left: bytes | None, pending: bytes, last: tuple[bytes, ...], live: tuple[int, ...]) -> State:
        found = self.states.get((left, pending))
        if found is None:
            found = self.states[left, pending] = State(left, pending, last, live)
        return found

    def valid(self, a: bytes | None, b: bytes) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side.

        They don't if, while the two were built, their facing parts could merge before one of them was
        complete. So the merge that came last is undone, on either side, again and again; a merge across
        the border that ranks before the undone one comes first, as does one of equal rank left of it.
        """
        if a is None:
            return True
        found = self.pairs.get((a, b))
        if found is not None:
            return found
        x, y, before, found = a, b, 1 << 62, True
        while True:
            if self.ranks.get(x + y, 1 << 62) < before:
                found = False
                break
            p, q = self.parts[x], self.parts[y]
            if p is None and q is None:
                break
            if q is None or p is not None and self.ranks[x] > self.ranks[y]:
                before, x = self.ranks[x], p[1]
            else:
                before, y = self.ranks[y] + 1, q[0]
        self.pairs[a, b] = found
        return found

    def arc(self, s: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The state after ``byte`` and the ids that have become certain."""
        pending = s.pending + bytes((byte,))
        n = len(pending)
        for at in s.live:
            token = pending[at:]
            if token in self.parts and self.valid(s.last[at - 1] if at else s.left, token):
                break
        else:
            raise ValueError("these ranks have no token for a byte")
        grown = State(s.left, pending, (*s.last, token), ())
        live = [at for at in s.live if pending[at:] in self.begins] + [n]
        # The certain part ends where the paths of all live positions meet.
        meet = set(live)
        while len(meet) > 1:
            at = max(meet)
            meet.remove(at)
            meet.add(at - len(grown.last[at - 1]))
        gone = meet.pop()
        common = grown.path(gone)[::-1]
        live = tuple([at - gone for at in live])
        # Only a token that starts at the first uncertain byte looks at the token before it.
        left = None if live[0] else common[-1] if common else s.left
        after = self.state(left, pending[gone:], grown.last[gone:], live)
        found = s.arcs[byte] = (after, tuple([self.ranks[t] for t in common]))
        return found

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token; a piece that is a token itself is taken whole, as the rank files ask for."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self.clear()
        out: list[int] = []
        s = self.start
        for byte in piece:
            s, ids = s.arcs.get(byte) or self.arc(s, byte)
            if ids:
                out += ids
        return out + [self.ranks[t] for t in reversed(s.path(len(s.pending)))]


class StreamDecoder:
    """Ids in, text out, with the bytes of an incomplete character held back between calls."""

    def __init__(self, tokens: dict[int, bytes], errors: str = "replace"):
        self.tokens, self.utf8 = tokens, codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: Iterable[int]) -> str:
        return self.utf8.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def end(self) -> str:
        return self.utf8.decode(b"", True)


def _encoder(key: str, content: bytes) -> dict:
    def make() -> dict:
        ranks = read_ranks(content)
        return {"transducer": Transducer(ranks), "cache": {}, "pieces": {}, "tokens": {i: t for t, i in ranks.items()}}

    return worker_state("byte_bpe", key, make)


def _tokens(key: str, content: bytes) -> dict[int, bytes]:
    return worker_state("byte_bpe.decode", key, lambda: {i: t for t, i in read_ranks(content).items()})


def decoded_text(raw: bytes, tokens: dict[int, bytes], step: int) -> str:
    """The text of packed ids, decoded as a stream of ``step`` ids at a time."""
    ids, stream = array("I", raw), StreamDecoder(tokens)
    return "".join([stream.feed(ids[i : i + step]) for i in range(0, len(ids), step)]) + stream.end()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", with_decoded: bool = False, step: int = 4096) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` (long) added.

    ``with_decoded`` also adds ``decoded``, the ids decoded again in the same task, as a check of the
    round trip.

    Each match of ``pattern`` is encoded separately, without special tokens; a null text counts as
    empty; texts and matches of any length are encoded whole. Each row is encoded for itself, so repeated
    rows, null ids and ties need no rule. Columns of ``docs``
    named like the added ones are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("ids", "n_tokens", *["decoded"] * with_decoded)
    file = shipped_file(docs.sparkSession, ranks_path)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), *[T.StructField("decoded", T.StringType())] * with_decoded])
    at = docs.columns.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _encoder(*file.value)
        transducer, cache, pieces = machine["transducer"], machine["cache"], machine["pieces"]  # bytes of ids by chunk, and by pre-token
        find = regex.compile(pattern).findall
        tokens = machine["tokens"]

        def of_piece(piece: str) -> bytes:
            ids = pieces.get(piece)
            if ids is None:
                ids = array("I", transducer.encode(piece.encode())).tobytes()
                if len(piece) <= 40:
                    pieces[piece] = ids
            return ids

        def of_chunk(chunk: str) -> bytes:
            return b"".join(map(of_piece, find(chunk)))

        def of(text: str) -> bytes:
            chunks = chunks_of(text, find)
            for c in chunks:
                if c not in cache:
                    if len(c) > 200:  # long chunks hardly recur; encode them each time
                        return b"".join([cache.get(x) or of_chunk(x) for x in chunks])
                    cache[c] = of_chunk(c)
            return b"".join(map(cache.__getitem__, chunks))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for kept in (cache, pieces):
                    if len(kept) > CACHED:
                        kept.clear()
                part = batch.slice(start, 256)
                ids = [of(t or "") for t in part.column(at).to_pylist()]
                gc.freeze()  # the states just built are kept; don't search them for garbage
                decoded = [pa.array([decoded_text(x, tokens, step) for x in ids], pa.string())] if with_decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), *decoded], names=schema.names)

    return docs.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", step: int = 4096) -> DataFrame:
    """``encoded`` with ``decoded`` (string) added: ``ids`` decoded as a stream, ``step`` ids at a time. Null ids give null."""
    encoded = encoded.drop("decoded")
    file = shipped_file(encoded.sparkSession, ranks_path)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    at = encoded.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(*file.value)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else decoded_text(x, tokens, step) for x in part.column(at).to_pylist()], pa.string())], names=schema.names)

    return encoded.mapInArrow(decode, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded documents."""
    return encoded.select(
        F.col(id_col).alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
