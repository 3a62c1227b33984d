"""Evaluation of page categories. ``pages(vol, page, truth, pred, words)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def equivalent(truth, pred, classes: list[set[str]]):
    """Whether two categories are the same or in one class."""
    same = truth == pred
    for c in classes:
        same = same | (truth.isin(sorted(c)) & pred.isin(sorted(c)))
    return same


def errors(pages: DataFrame, classes: list[set[str]]) -> DataFrame:
    """``truth, pred, pages, words, correct`` for every pair of categories."""
    return pages.groupBy("truth", "pred").agg(F.count("*").alias("pages"), F.sum("words").alias("words")).withColumn("correct", equivalent(F.col("truth"), F.col("pred"), classes))


def volume_accuracy(pages: DataFrame, classes: list[set[str]]) -> DataFrame:
    return pages.groupBy("vol").agg(F.avg(F.when(equivalent(F.col("truth"), F.col("pred"), classes), 1.0).otherwise(0.0)).alias("accuracy"))


def mean_words(pages: DataFrame) -> DataFrame:
    """``vol, w``: mean words of a volume's pages, summed in their order, so that the last digit never depends on how rows are dealt to tasks."""
    w = Window.partitionBy("vol").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.select("vol", "page", F.avg("words").over(w).alias("w")).groupBy("vol").agg(F.max_by("w", "page").alias("w"))


def micro_accuracy(pages: DataFrame, variants: dict[str, str]) -> DataFrame:
    """One accuracy for each variant of the prediction (name to column), by pages and by words."""
    items = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("p")) for n, c in variants.items()])
    long = pages.select("truth", "words", F.inline(items))
    hit = F.when(F.col("truth") == F.col("p"), 1.0).otherwise(0.0)
    return long.groupBy("variant").agg(F.avg(hit).alias("by_page"), (F.sum(hit * F.col("words")) / F.sum("words")).alias("by_word"))


def precision_recall(pages: DataFrame, merge: dict[str, str]) -> DataFrame:
    """``category, precision, recall, f1`` in percent, after merging categories; margins by one aggregation each."""
    m = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in merge.items() for x in p]), F.col(c)), F.col(c))
    cells = pages.groupBy(m("truth").alias("truth"), m("pred").alias("pred")).agg(F.count("*").alias("n"))
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("truth").alias("category"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("category"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")),
    )))
    by = sides.groupBy("category").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    precision, recall = F.try_divide(100.0 * F.col("tp"), F.col("p")), F.try_divide(100.0 * F.col("tp"), F.col("t"))
    return by.select("category", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def binary_counts(pages: DataFrame, categories: list[str]) -> DataFrame:
    """``vol, category, tp, fp, fn, tn`` in pages, and the words of tp and fp."""
    long = pages.withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    t, p = F.col("truth") == F.col("category"), F.col("pred") == F.col("category")
    return long.groupBy("vol", "category").agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
        F.coalesce(F.sum(F.when(t & p, F.col("words"))), F.lit(0.0)).alias("tp_words"), F.coalesce(F.sum(F.when(~t & p, F.col("words"))), F.lit(0.0)).alias("fp_words"),
    )


def volume_precision(counts: DataFrame) -> DataFrame:
    """Precision of each category in each volume; null where nothing is predicted."""
    return counts.select("vol", "category", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"))


def rater_agreement(tags: DataFrame, consensus: DataFrame) -> DataFrame:
    """Per volume with several raters: the share of words on which raters say what the consensus says."""
    several = tags.groupBy("vol").agg(F.count_distinct("rater").alias("raters")).where("raters > 1")
    own = tags.join(several, "vol").join(consensus.select("vol", "page", F.col("category").alias("agreed")), ["vol", "page"])
    miss = F.when(F.col("category") != F.col("agreed"), F.col("words")).otherwise(0.0)
    return own.groupBy("vol", "raters").agg(((F.sum("words") - F.sum(miss)) / F.sum("words")).alias("agreement"))


def rater_consensus(tags: DataFrame, parents: dict[str, str] | None = None) -> DataFrame:
    """``vol, page, category`` of ``tags(vol, page, rater, category)``.

    The tag that most raters of a page gave. Of several with most votes, the one that is the nearest
    common ancestor of all of them, being one of them or a parent of each (``parents``: category to its
    more general one); if that is none of them, the tag of the most experienced rater (smallest number).
    """
    counted = tags.groupBy("vol", "page", "category").agg(F.count("*").alias("n"), F.min("rater").alias("first"))
    tops = counted.groupBy("vol", "page").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "category"))).alias("all"))  # one for each category at most
    tied = F.transform(F.filter("all", lambda x: x["n"] == F.col("all")[0]["n"]), lambda x: x["category"])
    lines = {}
    for g in set(parents or {}) | set((parents or {}).values()):
        lines[g] = [g]
        while lines[g][-1] in parents and parents[lines[g][-1]] not in lines[g]:
            lines[g].append(parents[lines[g][-1]])
    above = F.create_map(*[x for g, line in lines.items() for x in (F.lit(g), F.array(*map(F.lit, line)))]) if lines else None
    line_of = lambda g: F.coalesce(F.try_element_at(above, g), F.array(g)) if lines else F.array(g)
    general = F.get(F.filter(F.col("tied"), lambda g: F.forall(F.col("tied"), lambda x: F.array_contains(line_of(x), g))), F.lit(0))
    return tops.withColumn("tied", tied).select("vol", "page", F.coalesce(general, F.col("all")[0]["category"]).alias("category"))


# Words of titles and tags that stand for drama or poetry, biography and fiction.
VERSE_TITLE_WORDS = ["poems", "ballads", "poetical", "comedy", "tragedy", "plays"]
VERSE_TAGS = ["Poetry", "Poems", "Drama", "Tragedies", "Comedies"]
BIOGRAPHY_TAGS = ["Biography", "Autobiography"]
FICTION_TAGS = ["Fiction", "Novel"]


def cascade_flags(counts: DataFrame, metadata: DataFrame) -> DataFrame:
    """From ``counts(vol, n, dra, poe, fic, non)`` and ``metadata(vol, categories, title)``: which corrections a volume calls for.

    ``categories`` is separated by semicolons. Volumes without metadata have only what their own pages say.
    """
    n = F.col("n")
    said = counts.join(metadata.select("vol", F.split("categories", ";").alias("tags"), F.split(F.lower("title"), r"\s+").alias("words")), "vol", "left")
    any_of = lambda column, names: F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, names))), F.lit(False))
    return said.select(
        "vol",
        ((F.col("fic") > 0) & (F.col("fic") < n / 3)).alias("not_fiction"),
        ((F.col("dra") > 0) & ((F.col("non") > n / 2) | (F.col("fic") > n / 2) | (F.col("poe") > n * 0.9))).alias("not_drama"),
        ((F.col("dra") + F.col("poe") > n / 2) | any_of("tags", VERSE_TAGS) | any_of("words", VERSE_TITLE_WORDS)).alias("mostly_drama_poetry"),
        any_of("tags", BIOGRAPHY_TAGS).alias("probably_biography"),
        any_of("tags", FICTION_TAGS).alias("probably_fiction"),
    )


def replace_with_next_best(pages: DataFrame, second: DataFrame, category: str, volumes: DataFrame) -> DataFrame:
    """In the given volumes pages of ``category`` take their runner-up."""
    flagged = pages.join(volumes.select("vol", F.lit(True).alias("flagged")), "vol", "left").join(second, ["vol", "page"], "left")
    return flagged.select("vol", "page", F.when(F.col("flagged") & (F.col("category") == category), F.col("second")).otherwise(F.col("category")).alias("category"))


def merge_models(main: DataFrame, other: DataFrame, share: float, only: str) -> DataFrame:
    """Pages that ``main(vol, page, idx, category, p)`` calls ``only`` take the best category of the weighted mean with ``other``; missing pages fall back to main."""
    both = main.join(other.select("vol", "page", "category", F.col("p").alias("q")), ["vol", "page", "category"], "left").withColumn("mixed", F.when(F.col("q").isNull(), F.col("p")).otherwise(share * F.col("p") + (1 - share) * F.col("q")))
    best = both.groupBy("vol", "page").agg(F.max_by("category", F.struct("p", -F.col("idx"))).alias("main"), F.max_by("category", F.struct("mixed", -F.col("idx"))).alias("merged"))
    return best.select("vol", "page", F.when(F.col("main") == only, F.col("merged")).otherwise(F.col("main")).alias("category"))


def specialist_cascade(current: DataFrame, main: DataFrame, specialists: dict[str, tuple[DataFrame, float]], flags: DataFrame, only: str, replaced: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``vol, page, category``: ``current`` after the correction that its volume calls for, if it calls for exactly one.

    ``flags(vol, <name>, ..)`` has a boolean for each correction. A specialist (``vol, page, idx,
    category, p``, and its weight) is mixed with ``main``: its categories weigh ``weight`` of it and the
    rest of main, or wholly of it where main has none; pages that it lacks fall back to main. Pages that
    ``current`` calls ``only`` take the best category of the mixture. ``replaced``: corrections that turn
    one category into another instead.
    """
    names = [*specialists, *(replaced or {})]
    on = {n: F.coalesce(F.col(n), F.lit(False)) for n in names}
    one = sum(on[n].cast("int") for n in names) == 1
    which = F.coalesce(*[F.when(one & on[n], n) for n in names])
    chosen = current.join(flags.select("vol", which.alias("which")), "vol", "left")
    said = [x.select(F.lit(n).alias("which"), F.lit(w).alias("weight"), "vol", "page", "category", "idx", F.col("p").alias("q")) for n, (x, w) in specialists.items()]
    every = said[0]
    for more in said[1:]:
        every = every.unionByName(more)
    open_ = chosen.where((F.col("category") == only) & F.col("which").isin(list(specialists))).select("vol", "page", "which")
    mine = every.join(open_, ["vol", "page", "which"], "left_semi").join(main.select("vol", "page", "category", "p"), ["vol", "page", "category"], "left")
    mixed = mine.withColumn("mixed", F.when(F.col("p").isNull(), F.col("q")).otherwise(F.col("weight") * F.col("q") + (1 - F.col("weight")) * F.col("p")))
    best = mixed.groupBy("vol", "page").agg(F.max_by("category", F.struct("mixed", -F.col("idx"))).alias("mixed"))
    alone = main.join(open_.select("vol", "page"), ["vol", "page"], "left_semi").groupBy("vol", "page").agg(F.max_by("category", F.struct("p", -F.col("idx"))).alias("own"))
    found = chosen.join(best, ["vol", "page"], "left").join(alone, ["vol", "page"], "left")
    out = F.when(F.col("which").isin(list(specialists)) & (F.col("category") == only), F.coalesce("mixed", "own", "category"))
    for n, (old, new) in (replaced or {}).items():
        out = out.when((F.col("which") == n) & (F.col("category") == old), new)
    return found.select("vol", "page", out.otherwise(F.col("category")).alias("category"))
