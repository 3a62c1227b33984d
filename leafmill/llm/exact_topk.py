"""Exact top-k inner products through a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it. The distances of one pivot are cut
into annuli, so there are at most ``pivots * rings`` cells whatever the data (fewer where they would
hold under ``CELL`` vectors); inside a cell vectors lie in sorted blocks of bounded size. For a query q, a cell of pivot p with distances in [lo, hi] and
largest norm m holds no score above

    min((|q|^2 + m^2 - max(0, |q - p| - hi, lo - |q - p|)^2) / 2,  q.p + |q| * hi,  |q| * m)

of which the first is the triangle inequality. Each query visits its cells from the highest bound
down, in widening rounds, and stops at the first whose bound is below its k-th best score.

Queries meet blocks by cell: the queries that visit a cell come in packs of about ``QUERY_PACK``, and a
pack and a block make one matrix product. Large cells are many blocks, which the join may split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import written

BLOCK, QUERY_PACK, CELL = 512, 256, 512
LARGEST = 1 << 20  # vectors with components beyond it are packed as doubles, others as 32-bit integers
REACH = 1e140  # squares of components up to it are finite doubles


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, dim, v``: floor(scale * x) of each component, packed as 32-bit integers, or as doubles where one is beyond 2**20.

    Left out are vectors that are null or empty, or hold a null or a non-finite component. A finite
    component beyond 1e140 once scaled is an error.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            given = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            wrong = ~np.isfinite(given)  # a null is NaN here
            values = np.floor(scale * np.where(wrong, 0.0, given))
            ends = np.cumsum(sizes)

            def rows_with(marks: np.ndarray) -> np.ndarray:
                before = np.concatenate(([0], np.cumsum(marks)))
                return before[ends] > before[ends - sizes]

            good = (sizes > 0) & ~rows_with(wrong)
            wide = rows_with(np.abs(values) > LARGEST)
            if (good & rows_with(~(np.abs(values) <= REACH))).any():
                raise ValueError("a vector has a component beyond 1e140")
            at = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(sizes[at].astype(np.int32)), pa.array([values[ends[i] - sizes[i] : ends[i]].astype(np.float64 if wide[i] else np.int32).tobytes() for i in at], pa.binary())], names=["id", "dim", "v"]
            )

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")).where(F.col("id").isNotNull()).mapInArrow(convert, "id long, dim int, v binary")


def unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    """The packed vectors as rows of doubles."""
    if all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), np.int32).reshape(len(raw), dim).astype(np.float64)
    return np.array([np.frombuffer(r, np.int32 if len(r) == 4 * dim else np.float64) for r in raw], np.float64)


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The exact inner products of integers held as doubles: as doubles where all are below 2**53, else as 64-bit integers, else as Python's."""
    most = float(np.abs(q).max()) * float(np.abs(m).max()) * q.shape[1]
    if most < 1 << 53:
        return q @ m.T
    if most < 1 << 62:
        return q.astype(np.int64) @ m.T.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.dot(whole(q), whole(m.T))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal from the vector nearest to the mean."""
    first = int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmin())
    chosen, far = [first], ((sample - sample[first]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


@dataclass
class Index:
    blocks: DataFrame  # cell int, ids binary, m binary
    cells: np.ndarray  # rows: cell, lo, hi, largest norm, count
    pivots: np.ndarray
    rings: int


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if max(np.abs(x).max(initial=0), np.abs(pivots).max()) ** 2 * 4 * x.shape[1] >= 1 << 53:  # the sums below would not be exact
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def build_index(vectors: DataFrame, dim: int, count: int, pivots: int = 64, rings: int = 64, sample: int = 4096) -> Index:
    """Indexes the ``count`` rows of ``vectors`` (``id, dim, v``) of dimension ``dim``; pivots come from ``sample`` of them."""
    vectors = vectors.where(F.col("dim") == dim)
    pivots = min(pivots, max(1, count // (4 * CELL)))
    rings = min(rings, max(2, count // (CELL * pivots)))
    few = unpacked(vectors.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").toArrow()["v"].to_pylist(), dim)
    chosen = choose_pivots(few, pivots)
    reach = float(_distances(few, chosen).min(axis=1).max())
    width = max(reach, 1.0) / (rings - 1)  # distances beyond the sample's are in the last ring

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(1).to_pylist(), dim)
            d = _distances(x, chosen)
            near = d.argmin(axis=1)
            r = d[np.arange(len(x)), near]
            cell = near * rings + np.minimum(r / width, rings - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(r), pa.array(np.sqrt((x**2).sum(axis=1))), batch.column(0), batch.column(1)], names=["cell", "r", "norm", "id", "v"]
            )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # sorted by cell and distance
            cell = batch["cell"].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                for s in range(int(a), int(b), BLOCK):
                    part = batch.slice(s, min(BLOCK, int(b) - s)).sort_by("id")  # by id, so that ties come in their order
                    rows = part["v"].to_pylist()
                    if any(len(r) > 4 * dim for r in rows):
                        rows = [unpacked(rows, dim).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[a])], pa.int32()), pa.array([part["id"].to_numpy().tobytes()], pa.binary()), pa.array([b"".join(rows)], pa.binary())], names=["cell", "ids", "m"])

    keyed = written(vectors.select("id", "v").mapInArrow(key, "cell int, r double, norm double, id long, v binary"), "pivot-keys")
    cells = keyed.groupBy("cell").agg(F.min("r"), F.max("r"), F.max("norm"), F.count("*")).orderBy("cell").collect()  # at most pivots * rings rows
    ordered = keyed.repartitionByRange("cell", "r", "id").sortWithinPartitions("cell", "r", "id")
    blocks = written(ordered.mapInArrow(block, "cell int, ids binary, m binary"), "pivot-index")
    return Index(blocks, np.array([tuple(c) for c in cells], np.float64), chosen, rings)


def _visits(index: Index, k: int, first: int | None, count: int | None):
    """Rows ``cell, id, v, least`` for the cells that each query visits in one round.

    ``first`` None: from the highest bound down until enough vectors are there. Else ``count`` cells
    (None: all) from the ``first``-th after those, as far as their bounds reach ``least``.
    """
    cells, pivots, rings = index.cells, index.pivots, index.rings
    pivot = pivots[(cells[:, 0] // rings).astype(int)]
    lo, hi, norm, size = cells[:, 1], cells[:, 2], cells[:, 3], cells[:, 4]
    dim, length = pivots.shape[1], np.sqrt((pivot**2).sum(axis=1))
    part = 4 * (dim + 8) * np.finfo(float).eps  # what sums of so many doubles can be off by

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids, least = batch["v"].to_pylist(), batch["id"].to_pylist(), batch["least"].to_pylist()
            out_cell, out_row = [], []
            for i, r in enumerate(raw):
                q = unpacked([r], dim)[0]
                qq = math.sqrt(float(q @ q))
                to_pivot = np.sqrt(((pivot - q) ** 2).sum(axis=1))
                gap = np.maximum(0, np.maximum(to_pivot - hi, lo - to_pivot) - 1e-6 - part * (to_pivot + hi))
                bound = np.minimum(np.minimum((qq * qq + norm**2 - gap**2) / 2, pivot @ q + qq * hi), qq * norm)
                bound += 1e-3 + part * (qq * qq + norm**2 + gap**2 + qq * (length + hi))
                order = np.argsort(-bound, kind="stable")
                enough = int(np.searchsorted(np.cumsum(size[order]), k + 1)) + 1
                own = order[:enough] if first is None else order[enough + first : None if count is None else enough + first + count]
                if first is not None and least[i] is not None:
                    own = own[bound[own] >= least[i] - 1e-15 * abs(least[i])]
                out_cell.append(cells[own, 0].astype(np.int32))
                out_row.append(np.full(len(own), i))
            rows = pa.array(np.concatenate([np.zeros(0, np.int64), *out_row]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *out_cell])), *[batch[c].take(rows) for c in ("id", "v", "least")]], names=["cell", "id", "v", "least"])

    return visit


def _scan(k: int, dim: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, ids, m in zip(batch["pack"].to_pylist(), batch["ids"].to_pylist(), batch["m"].to_pylist(), strict=True):
                ids = np.frombuffer(ids, np.int64)
                m = np.frombuffer(m, np.int32 if len(m) == 4 * dim * len(ids) else np.float64).reshape(len(ids), dim).astype(np.float64)
                qids = np.array([p["id"] for p in pack], np.int64)
                scores = products(unpacked([p["v"] for p in pack], dim), m)
                if scores.dtype == object:
                    none = min(int(scores.min()), -(1 << 63)) - 1
                else:
                    none = -np.inf if scores.dtype == np.float64 else -(1 << 63) + 1
                least = np.array([none if p["least"] is None else p["least"] for p in pack], scores.dtype)
                scores[qids[:, None] == ids[None, :]] = none
                scores[scores < least[:, None]] = none
                some = np.flatnonzero(scores.max(axis=1) > none)
                best = np.argsort(-scores[some], axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(scores[some], best, axis=1)
                row, col = np.nonzero(found > none)
                if scores.dtype == object and any(abs(x) >= 1 << 63 for x in found[row, col]):
                    raise OverflowError("a score does not fit 64 bits")
                yield pa.RecordBatch.from_arrays([pa.array(qids[some][row]), pa.array(ids[best[row, col]]), pa.array(found[row, col].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return scan


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, pivots: int = 64, rings: int = 64, steps: tuple[int, ...] = (8, 64)) -> DataFrame:
    """The ``k`` highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Components become floor(``scale`` * x). Candidates are all vectors but those with the query's own
    id and of the query's dimension, which has an index of its own; fewer than ``k`` are all returned;
    ties go to the smaller id. Vectors that ``integer_vectors`` leaves out take no part. Scores are exact
    whatever the components; one that does not fit 64 bits is an error. Rows that repeat an id are
    candidates each; of queries that repeat an id one is answered. Rows with a null id take no part.
    Other columns are ignored, whatever their names. No vectors: an empty result.
    """
    packed = integer_vectors(vectors, id_col, vec_col, scale)
    asked = integer_vectors(queries, id_col, vec_col, scale).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q"))
    asked = written(asked.select("id", "q.dim", "q.v"), "topk-queries")
    found = [
        _topk_of_dimension(asked.where(F.col("dim") == r.dim).select("id", "v"), build_index(packed, r.dim, r.n, pivots, rings), k, steps)
        for r in packed.groupBy("dim").agg(F.count("*").alias("n")).join(asked.select("dim").distinct(), "dim").orderBy("dim").collect()  # one row a dimension
    ]
    if not found:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _topk_of_dimension(asked: DataFrame, index: Index, k: int, steps: tuple[int, ...]) -> DataFrame:
    schema = "query_id long, vec_id long, score long"
    packs = max(1, math.ceil(asked.count() / QUERY_PACK))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best, at = None, 0
    for first, count in [(None, None), *zip([sum(steps[:i]) for i in range(len(steps))], steps, strict=True), (sum(steps), None)]:
        if best is None:
            now = asked.withColumn("least", F.lit(None).cast("long"))
        else:  # a query with fewer than k scores has no bound yet
            kth = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            now = asked.join(kth, "id", "left")
        visits = now.mapInArrow(_visits(index, k, first, count), "cell int, id long, v binary, least long")
        pack = visits.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(packs)).alias("p")).agg(F.collect_list(F.struct("id", "v", "least")).alias("pack"))
        found = pack.join(index.blocks.hint("merge"), "cell").select("pack", "ids", "m").mapInArrow(_scan(k, index.pivots.shape[1]), schema)
        every = found if best is None else best.drop("rank").unionByName(found)
        best = written(every.withColumn("rank", rank).where(F.col("rank") <= k), f"topk-round{at}")
        at += 1
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
