"""Sequences of page categories within volumes: transitions, smoothing, votes, runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.staged import written


def by_page():
    return Window.partitionBy("vol").orderBy("page")


def transition_counts(pages: DataFrame) -> DataFrame:
    """``prev, next, n``: from begin over the categories to end."""
    inner = pages.select(F.lag("category", 1, "begin").over(by_page()).alias("prev"), F.col("category").alias("next"))
    last = pages.groupBy("vol").agg(F.max_by("category", "page").alias("prev")).select("prev", F.lit("end").alias("next"))
    return inner.unionByName(last).groupBy("prev", "next").agg(F.count("*").alias("n"))


def transition_probabilities(pages: DataFrame, share: float = 0.0001, added: float = 2.0) -> DataFrame:
    """``prev, next, p`` over all pairs of categories: counts plus a share of the next one's frequency plus a constant; none lead to begin."""
    counts = transition_counts(pages)
    names = pages.select("category").distinct().unionByName(pages.sparkSession.createDataFrame([("begin",), ("end",)], "category string"))
    unigrams = counts.groupBy("next").agg(F.sum("n").alias("u"))
    spine = names.select(F.col("category").alias("prev")).crossJoin(names.select(F.col("category").alias("next")))  # a few categories
    full = spine.join(counts, ["prev", "next"], "left").join(unigrams, "next", "left")
    raw = F.when(F.col("next") == "begin", 0.0).otherwise(F.coalesce("n", F.lit(0)) + share * F.coalesce("u", F.lit(0)) + added)
    return full.withColumn("raw", raw).select("prev", "next", (F.col("raw") / F.sum("raw").over(Window.partitionBy("prev"))).alias("p"))


def transition_arrays(pages: DataFrame, categories: list[str]) -> tuple[list[list[float]], list[float], list[float]]:
    """The transition probabilities of ``pages`` as ``smooth`` takes them: between the categories, from begin, to end."""
    p = {(r.prev, r.next): r.p for r in transition_probabilities(pages).collect()}  # a row for each pair of categories
    return [[p.get((a, b), 0.0) for b in categories] for a in categories], [p.get(("begin", b), 0.0) for b in categories], [p.get((a, "end"), 0.0) for a in categories]


BLOCK_PAGES, GROUP_PAGES = 1024, 100_000


def smooth(pages: DataFrame, transitions: list[list[float]], begin: list[float], end: list[float]) -> DataFrame:
    """Forward-backward smoothing of ``pages(vol, page, words, probs array<double>)``; adds ``smoothed``.

    ``transitions[i][j]`` leads from category i to j. A page with at most five words counts as
    informative only in the first tenth of its volume or after the last eighth begins; on others 0.25 is
    added to its evidence. Evidence enters both directions, and the last page is its backward value
    squared.

    A volume is cut into blocks of ``BLOCK_PAGES`` page numbers, so that volumes of any length are many
    tasks: each block's steps make one matrix for each direction, a fold over the few blocks of a volume
    gives the values at their edges, and with these the blocks are smoothed for themselves. Volumes of one
    block, mostly all, need the last pass only.
    """
    k = len(begin)
    t = np.array(transitions, float)
    first, last = np.array(begin, float), np.array(end, float)
    pages = written(pages.select("vol", "page", "words", "probs").withColumn("block", F.expr(f"page div {BLOCK_PAGES}")), "smooth-pages")
    w = Window.partitionBy("vol").orderBy("block")
    sizes = pages.groupBy("vol", "block").agg(F.count("*").alias("size"))  # a row for each block
    of_vol = Window.partitionBy("vol")
    sizes = sizes.withColumns({"before": F.sum("size").over(w) - F.col("size"), "n": F.sum("size").over(of_vol), "blocks": F.count("*").over(of_vol)})
    extent = sizes.agg(F.sum("size").alias("pages"), F.max("blocks").alias("blocks")).first()
    groups = max(1, (extent.pages or 0) // GROUP_PAGES)
    group = F.pmod(F.xxhash64("vol", "block"), F.lit(groups))
    placed = pages.join(sizes, ["vol", "block"]).withColumn("group", group)
    kind = pages.schema["vol"].dataType.simpleString()

    def padded(rows: pd.DataFrame) -> tuple:
        """The blocks of a group side by side: their evidence, plain and softened, by place; the number of places; which are a volume's first or last pages."""
        rows = rows.sort_values(["vol", "block", "page"], kind="stable", ignore_index=True)
        size = rows["size"].to_numpy()
        starts = np.flatnonzero(rows["vol"].ne(rows["vol"].shift()) | rows["block"].ne(rows["block"].shift()))
        size = size[starts]
        row = np.repeat(np.arange(len(starts)), size)
        col = np.arange(len(rows)) - starts[row]
        at = rows["before"].to_numpy() + col
        n = rows["n"].to_numpy()
        plain = np.array(rows["probs"].tolist(), float).reshape(-1, k)
        told = (rows["words"].to_numpy() > 5) | (at < n // 10) | (at > n - n // 8)
        soft = plain + np.where(told, 0.0, 0.25)[:, None]
        grid = np.zeros((len(starts), int(size.max()), k))
        grid[row, col] = soft
        return rows, starts, size, row, col, plain, grid, at[starts] == 0, at[starts] + size == n[starts]

    def norm(v: np.ndarray) -> np.ndarray:
        total = v.sum(axis=-1, keepdims=True)
        return np.divide(v, total, out=np.zeros_like(v), where=total > 0)

    def scaled(m: np.ndarray) -> np.ndarray:
        top = m.max(axis=(1, 2), keepdims=True)
        return np.divide(m, top, out=np.zeros_like(m), where=top > 0)

    def matrices(rows: pd.DataFrame) -> pd.DataFrame:
        rows, starts, size, _, _, _, grid, opens, closes = padded(rows)
        fw = np.tile(np.eye(k), (len(starts), 1, 1))
        bw = fw.copy()
        for i in range(grid.shape[1]):
            on = (i < size) & ~(opens & (i == 0))  # the first page of a volume is a value of its own
            fw[on] = scaled(grid[on, i][:, :, None] * (t.T @ fw[on]))
            back = size - 1 - i
            on = (back >= 0) & ~(closes & (i == 0))
            bw[on] = scaled(grid[on, back[on]][:, :, None] * (t @ bw[on]))
        plain = np.array(rows["probs"].tolist(), float).reshape(-1, k)
        ends = starts + size - 1
        own = rows.loc[starts, ["vol", "block"]].reset_index(drop=True)
        lists = {"fw": fw.reshape(len(starts), -1), "bw": bw.reshape(len(starts), -1), "head": norm(first * plain[starts]), "tail": norm(last * plain[ends])}
        return own.assign(**{c: list(x) for c, x in lists.items()})

    def edges(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block", ignore_index=True)
        fw, bw = (np.array(blocks[c].tolist()).reshape(-1, k, k) for c in ("fw", "bw"))
        into, back = [blocks["head"][0]], [blocks["tail"].iloc[-1]]
        for m in fw[:-1]:
            into.append(norm(m @ into[-1]))
        for m in bw[:0:-1]:
            back.append(norm(m @ back[-1]))
        return blocks[["vol", "block"]].assign(into=into, back=back[::-1])

    def smoothed(rows: pd.DataFrame) -> pd.DataFrame:
        edged = "into" in rows
        rows, starts, size, row, col, plain, grid, opens, closes = padded(rows)
        f, b = np.zeros_like(grid), np.zeros_like(grid)
        now = np.array(rows["into"].tolist(), float)[starts] if edged else norm(first * plain[starts])
        then = np.array(rows["back"].tolist(), float)[starts] if edged else norm(last * plain[starts + size - 1])
        for i in range(grid.shape[1]):
            on = (i < size) & ~(opens & (i == 0))
            now[on] = norm(grid[on, i] * (now[on] @ t))
            f[:, i] = now
            back = size - 1 - i
            on = (back >= 0) & ~(closes & (i == 0))
            then[on] = norm(grid[on, back[on]] * (then[on] @ t.T))
            live = np.flatnonzero(back >= 0)
            b[live, back[live]] = then[live]
        both = norm(f * b)
        ends = np.flatnonzero(closes)
        both[ends, size[ends] - 1] = norm(b[ends, size[ends] - 1] ** 2)
        return rows[["vol", "page", "words"]].assign(smoothed=list(both[row, col]))

    words = pages.schema["words"].dataType.simpleString()
    number = pages.schema["page"].dataType.simpleString()
    out = f"vol {kind}, page {number}, words {words}, smoothed array<double>"
    short = placed.where("blocks = 1").drop("blocks").groupBy("group").applyInPandas(smoothed, out)
    if (extent.blocks or 0) <= 1:
        return short
    long = placed.where("blocks > 1").drop("blocks")
    arrays = "fw array<double>, bw array<double>, head array<double>, tail array<double>"
    steps = long.groupBy("group").applyInPandas(matrices, f"vol {kind}, block long, {arrays}")
    edge = written(steps.groupBy("vol").applyInPandas(edges, f"vol {kind}, block long, into array<double>, back array<double>"), "smooth-edges")
    return short.unionByName(long.join(edge, ["vol", "block"]).groupBy("group").applyInPandas(smoothed, out))


def best_category(probabilities: DataFrame) -> DataFrame:
    """The most probable category of each page of ``probabilities(vol, page, idx, category, p)``; the first of equals; ``none`` if all are 0."""
    best = probabilities.groupBy("vol", "page").agg(F.max_by(F.struct("category", "p"), F.struct("p", -F.col("idx"))).alias("b"))
    return best.select("vol", "page", F.when(F.col("b.p") > 0, F.col("b.category")).otherwise("none").alias("category"), F.col("b.p").alias("p"))


def max_and_gap(probabilities: DataFrame) -> DataFrame:
    """Per volume the mean largest probability, and the mean last step of the running maximum in category order."""
    w = Window.partitionBy("vol", "page").orderBy("idx")
    before = F.coalesce(F.max("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    steps = probabilities.withColumn("step", F.col("p") - before).where("step > 0")
    page = steps.groupBy("vol", "page").agg(F.max("p").alias("maxprob"), F.max_by("step", "idx").alias("gap"))
    return page.groupBy("vol").agg(F.avg("maxprob").alias("maxprob"), F.avg("gap").alias("gap"))


def flips(pages: DataFrame) -> DataFrame:
    """Changes of category per volume; the first page is one."""
    return pages.withColumn("flip", ~F.col("category").eqNullSafe(F.lag("category").over(by_page()))).groupBy("vol").agg(F.count_if("flip").alias("flips"))


def transitions_between(pages: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    hit = F.lag("category").over(by_page()).isin(before) & F.col("category").isin(after)
    return pages.withColumn("hit", hit).groupBy("vol").agg(F.count_if("hit").alias("n"))


def runs(pages: DataFrame) -> DataFrame:
    """``vol, run, category, start, length`` of runs of one category."""
    new = F.when(F.col("category").eqNullSafe(F.lag("category").over(by_page())), 0).otherwise(1)
    numbered = pages.withColumn("new", new).withColumn("run", F.sum("new").over(by_page()))
    return numbered.groupBy("vol", "run", "category").agg(F.min("page").alias("start"), F.count("*").alias("length"))


def coalesce_runs(pages: DataFrame, longest: int = 2) -> DataFrame:
    """Pages in which a run of at most ``longest`` between two longer runs of one other category takes that category."""
    w = Window.partitionBy("vol").orderBy("run")
    r = runs(pages)
    before, after = F.lag(F.struct("category", "length")).over(w), F.lead(F.struct("category", "length")).over(w)
    r = r.withColumn("b", before).withColumn("a", after)
    swap = (F.col("length") <= longest) & (F.col("b.category") == F.col("a.category")) & (F.least("b.length", "a.length") > F.col("length"))
    r = r.withColumn("category", F.when(F.coalesce(swap, F.lit(False)), F.col("b.category")).otherwise(F.col("category")))
    return r.select("vol", F.explode(F.sequence("start", F.col("start") + F.col("length").cast("int") - 1)).alias("page"), "category")


def category_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("vol", "category").agg(F.count("*").alias("n"))


def largest_category(pages: DataFrame) -> DataFrame:
    """The commonest category of a volume; ties go to the name that sorts last."""
    return category_counts(pages).groupBy("vol").agg(F.max_by("category", F.struct("n", "category")).alias("maxcategory"), F.max("n").alias("n"))


def folded_counts(pages: DataFrame, fold: dict[str, str], spine: list[str]) -> DataFrame:
    """``vol, category, n, maxcategory``: pages by category after folding, with zeros for the categories of ``spine`` that a volume lacks.

    The largest category is over all of them, others too; ties go to the name that sorts last.
    """
    named = F.coalesce(*[F.when(F.col("category") == a, b) for a, b in fold.items()], F.col("category")) if fold else F.col("category")
    counts = pages.select("vol", named.alias("category"), F.lit(1).alias("n"))
    zeros = pages.select("vol").distinct().select("vol", F.explode(F.array(*map(F.lit, spine))).alias("category"), F.lit(0).alias("n"))
    own = counts.unionByName(zeros).groupBy("vol", "category").agg(F.sum("n").alias("n"))
    return own.withColumn("maxcategory", F.max_by("category", F.struct("n", "category")).over(Window.partitionBy("vol")))


def mean_probabilities(models: DataFrame) -> DataFrame:
    """Of ``models(model, vol, page, category, p)``: each model's probabilities normalised, then their mean."""
    own = models.withColumn("p", F.try_divide("p", F.sum("p").over(Window.partitionBy("model", "vol", "page"))))
    total = own.groupBy("vol", "page", "category").agg(F.sum("p").alias("p"))
    return total.withColumn("p", F.try_divide("p", F.sum("p").over(Window.partitionBy("vol", "page"))))


def consensus(votes: DataFrame, means: DataFrame) -> DataFrame:
    """``vol, page, category, dissent``: most votes; ties to the best mean probability, then by name."""
    counted = votes.groupBy("vol", "page", "category").agg(F.count("*").alias("votes"))
    best = means.groupBy("vol", "page").agg(F.max_by("category", F.struct("p", "category")).alias("favourite"))
    ranked = counted.join(best, ["vol", "page"], "left").withColumn("bonus", F.when(F.col("category") == F.col("favourite"), 1).otherwise(0))
    w = Window.partitionBy("vol", "page")
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc("votes"), F.desc("bonus"), "category"))).withColumn("all", F.sum("votes").over(w))
    return ranked.where("rank = 1").select("vol", "page", "category", ((F.col("all") - F.col("votes")) / F.col("all")).alias("dissent"))


def runner_up(probabilities: DataFrame, chosen: DataFrame) -> DataFrame:
    """The most probable category other than the chosen one."""
    other = probabilities.join(chosen.select("vol", "page", F.col("category").alias("chosen")), ["vol", "page"]).where(F.col("category") != F.col("chosen"))
    return other.groupBy("vol", "page").agg(F.max_by("category", F.struct("p", "category")).alias("second"))
