"""Confidence features, calibration curves and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import sequence as S
from leafmill.sources.staged import written

# Tags of nonfiction.
NONFICTION_TAGS = [
    "Bibliographies", "Catalog", "Dictionary", "Encyclopedia", "Handbooks", "Indexes", "Legislation", "Directories", "Statistics", "Legal cases",
    "Legal articles", "Calendars", "Autobiography", "Biography", "Letters", "Essays", "Speeches",
]
# Thresholds of the collections, and words that a title must not have.
THRESHOLDS = {"dra": 0.66, "fic": 0.50, "poe": 0.70}
FORBIDDEN = {
    "fic": ["dictionary", "bible", "cyclopedia", "congressional globe", "report of", "reports of"],
    "poe": ["dictionary", "lexicon", "concordance", "catalogue", "bibliography", "index"],
    "dra": ["dictionary", "lexicon", "concordance", "proceedings", "report of", "contested election", "charges against", "catalogue", "register"],
}
# Tags that a tag list leaves out.
HIDDEN_TAGS = ["NotFiction", "UnknownCategory", "ContainsBiogMaterial"]
FICTION_TAGS = ["Fiction", "Novel", "Short stories"]


def nonfiction(tags: Column) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, NONFICTION_TAGS)))


def category_evidence(tags: Column, title: Column, category: str) -> tuple[Column, Column]:
    """Whether metadata confirm, and whether they deny, a category."""
    any_of = lambda names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    low, non = F.lower(title), nonfiction(tags)
    return {
        "fic": (any_of(FICTION_TAGS), any_of(["Drama", "Poetry"]) | non),
        "poe": (any_of(["Poetry"]) | low.contains("poems"), any_of(["Drama", "Fiction"]) | non),
        "dra": (any_of(["Drama"]) | low.contains("plays"), any_of(["Fiction", "Poetry"]) | non),
        "non": (non, any_of([*FICTION_TAGS, "Poetry", "Drama"])),
    }[category]


def volume_features(volumes: DataFrame) -> DataFrame:
    """Confidence features of ``volumes(vol, maxcategory, tags, title, ...)``: a pair of 0/1 flags for each category; other columns stay."""
    out = volumes
    for g in ("fic", "poe", "dra", "non"):
        for name, flag in zip(("confirm", "deny"), category_evidence(F.col("tags"), F.col("title"), g), strict=True):
            out = out.withColumn(f"{g}_{name}", F.when((F.col("maxcategory") == g) & flag, 1).otherwise(0))
    return out


SEQUENCE_FEATURES = ["maxratio", "rawflipratio", "smoothflips", "gap", "maxprob"]
OVERALL_FEATURES = [f"{g}_{n}" for g in ("fic", "poe", "dra", "non") for n in ("confirm", "deny")] + SEQUENCE_FEATURES
CATEGORY_FEATURES = ["confirm", "deny", "proportion", "rawflipratio", "smoothflips", "gap", "maxprob", "maxratio"]


def sequence_features(pages: DataFrame, certainty: DataFrame) -> DataFrame:
    """``vol, pages, maxcategory`` and ``SEQUENCE_FEATURES`` from ``pages(vol, page, raw, smooth)`` and ``certainty(vol, maxprob, gap)``.

    The share of the commonest category, the changes of the raw predictions for each page and those of
    the smoothed ones, and how certain the pages are on average.
    """
    smooth = pages.select("vol", "page", F.col("smooth").alias("category"))
    sizes = pages.groupBy("vol").agg(F.count("*").alias("pages"))
    raw = S.flips(pages.select("vol", "page", F.col("raw").alias("category"))).withColumnRenamed("flips", "rawflips")
    every = S.largest_category(smooth).join(sizes, "vol").join(raw, "vol").join(S.flips(smooth), "vol").join(certainty.select("vol", "maxprob", "gap"), "vol", "left")
    return every.select("vol", "pages", "maxcategory", (F.col("n") / F.col("pages")).alias("maxratio"), (F.col("rawflips") / F.col("pages")).alias("rawflipratio"), F.col("flips").alias("smoothflips"), "gap", "maxprob")


def overall_features(volumes: DataFrame, sequence: DataFrame) -> DataFrame:
    """``vol`` and the thirteen ``OVERALL_FEATURES`` of ``volumes(vol, tags, title)``; volumes without metadata have no confirmation and no denial."""
    known = sequence.join(volumes.select("vol", "tags", "title"), "vol", "left")
    return volume_features(known).select("vol", *OVERALL_FEATURES)


def category_features(volumes: DataFrame, sequence: DataFrame, pages: DataFrame, categories: tuple[str, ...] = ("fic", "poe", "dra")) -> DataFrame:
    """``vol, category, pages`` and the eight ``CATEGORY_FEATURES`` of each volume and category; ``pages(vol, page, smooth)``."""
    counts = S.category_counts(pages.select("vol", F.col("smooth").alias("category"))).withColumnRenamed("n", "own")
    each = sequence.join(volumes.select("vol", "tags", "title"), "vol", "left").withColumn("category", F.explode(F.array(*map(F.lit, categories)))).join(counts, ["vol", "category"], "left")
    flags = {n: F.lit(False) for n in ("confirm", "deny")}
    for g in categories:
        for n, found in zip(flags, category_evidence(F.col("tags"), F.col("title"), g), strict=True):
            flags[n] = flags[n] | ((F.col("category") == g) & found)
    own = F.coalesce("own", F.lit(0))
    each = each.withColumns({n: F.coalesce(f, F.lit(False)).cast("int") for n, f in flags.items()} | {"proportion": own / F.col("pages")}).withColumn("pages", own)
    return each.select("vol", "category", "pages", *CATEGORY_FEATURES)


def century(year: Column) -> Column:
    return F.when(year.between(1700, 1799), "18c").when(year.between(1800, 1899), "19c").when(year.between(1900, 1922), "20c")


def period(year: Column) -> Column:
    bounds = ((1700, 1799), (1800, 1849), (1850, 1874), (1875, 1899), (1900, 1922))
    out = F.when(year < 1700, "uncertain")
    for a, b in bounds:
        out = out.when(year.between(a, b), f"{a}-{b % 100:02d}")
    return out


def overall_curve(scored: DataFrame, steps: int = 100) -> DataFrame:
    """``idx, precision, recall`` over thresholds ``idx / steps`` of ``scored(score, correct, total)``.

    Rows above a threshold are those in higher buckets, so one aggregation by bucket and a reverse
    running sum over ``steps`` rows replace the join with all thresholds.
    """
    bucket = F.least(F.ceil(F.col("score") * steps - 1e-9) - 1, F.lit(steps - 1)).cast("int")
    sums = scored.groupBy(bucket.alias("idx")).agg(F.sum("correct").alias("c"), F.sum("total").alias("t"))
    spine = scored.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("idx"))
    full = spine.join(F.broadcast(sums), "idx", "left")
    w = Window.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    over = full.select("idx", F.sum(F.coalesce("c", F.lit(0))).over(w).alias("c"), F.sum(F.coalesce("t", F.lit(0))).over(w).alias("t"), F.sum(F.coalesce("t", F.lit(0))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    return over.where("idx >= 0").select("idx", F.try_divide(F.col("c").cast("double"), "t").alias("precision"), F.try_divide(F.col("c").cast("double"), "all").alias("recall"))


def fill_forward(curve: DataFrame, column: str, key: str | None = None) -> DataFrame:
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy("idx")
    return curve.withColumn(column, F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def curve_index(p: Column) -> Column:
    """The curve row of a probability: truncated hundredths, from 0 to 99."""
    return F.greatest(F.lit(0), F.least(F.lit(99), (p * F.lit(100.0)).cast("int")))


def calibrate(scored: DataFrame, curve: DataFrame) -> DataFrame:
    """``scored(.., score)`` with the curve's precision and recall at its score; the curve has 100 rows."""
    return scored.withColumn("idx", curve_index(F.col("score"))).join(F.broadcast(curve), "idx", "left")


def tag_list(tags: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.array_except(tags, F.array(*map(F.lit, HIDDEN_TAGS))), F.lower)), ";")


def title_filter(volumes: DataFrame, category: str) -> DataFrame:
    """Volumes (``score, discard, title, author``) of a collection: over the threshold, not discarded, no forbidden words; no memoirs named after their author."""
    title = F.translate(F.lower("title"), ",.", "  ")
    bad = F.lit(False)
    for w in FORBIDDEN[category]:
        bad = bad | title.contains(w)
    if category == "fic":
        words = F.split(title, r"\s+")
        names = F.filter(F.split(F.replace(F.lower("author"), F.lit(","), F.lit("")), r"\s+"), lambda x: F.length(x) > 4)
        memoir = (title.contains("memoirs") | title.contains("autobiography")) & F.arrays_overlap(names, words) & ~F.array_contains(words, "novels")
        bad = bad | memoir
    return volumes.where((F.col("score") >= THRESHOLDS[category]) & ~F.col("discard").eqNullSafe("x") & ~bad)


def ringers(candidates: DataFrame, accepted: DataFrame, order: list[str], metadata: DataFrame | None = None) -> DataFrame:
    """``vol, category, since``: candidates (``vol, category``) that no collection accepted (``vol, category``), one row each.

    Categories are gone through in ``order``. A candidate of one is a ringer unless that or an earlier
    collection has it, and stops being one when a later collection takes it. Its category is the last
    one that it was a candidate of, ``since`` the first. Both follow from the first place where a volume
    is blocked and the first and last where it is a candidate, in one aggregation of both tables. With
    ``metadata`` (``vol, ..``) its columns are added, and volumes without it are left out.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    said = candidates.select("vol", place.alias("at"), F.lit(None).cast("long").alias("blocked")).unionByName(accepted.select("vol", F.lit(None).cast("long").alias("at"), place.alias("blocked")))
    each = said.where("at > 0 OR blocked > 0").groupBy("vol").agg(F.max("at").alias("last"), F.min("at").alias("first"), F.min("blocked").alias("blocked"))
    name = lambda c: F.element_at(F.array(*map(F.lit, order)), F.col(c).cast("int"))
    found = each.where("blocked IS NULL").select("vol", name("last").alias("category"), name("first").alias("since"))
    return found if metadata is None else found.join(metadata, "vol")


def weighted_draws(volumes: DataFrame, draws: DataFrame) -> DataFrame:
    """Draws (``stratum, draw, u`` in [0, 1)) of volumes (``stratum, vol, weight``) in proportion to weight; adds the ordinal inside the volume.

    Volumes lie one after the other on a line of their weights. Their places come from running sums in
    the range partitions of the sorted volumes and from the sums of those before, so a stratum may be
    many tasks. The line is cut into as many cells as the stratum has volumes, and a draw meets only
    those of its cell.
    """
    sorted_ = volumes.where("weight > 0").repartitionByRange("stratum", "vol").withColumn("part", F.spark_partition_id())
    parts = written(sorted_.select("stratum", "vol", "weight", "part"), "draw-volumes")
    sums = parts.groupBy("stratum", "part").agg(F.sum("weight").alias("own"), F.count("*").alias("n"))  # a row for each partition and stratum
    w = Window.partitionBy("stratum")
    sums = written(sums.select("stratum", "part", (F.sum("own").over(w.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(w).alias("all"), F.sum("n").over(w).alias("n")), "draw-sums")
    width = F.col("all") / F.col("n")
    within = F.sum("weight").over(Window.partitionBy("stratum", "part").orderBy("vol"))
    v = parts.withColumn("within", within).join(sums, ["stratum", "part"]).withColumn("top", F.col("before") + F.col("within")).withColumn("floor", F.col("top") - F.col("weight"))
    cells = F.sequence(F.floor(F.col("floor") / width), F.floor(F.col("top") / width))
    v = v.select("stratum", "vol", "floor", "top", F.explode(cells).alias("cell"))
    strata = sums.groupBy("stratum").agg(F.first("all").alias("all"), F.first("n").alias("n"))
    d = draws.join(strata, "stratum").withColumn("at", F.floor(F.col("u") * F.col("all"))).withColumn("cell", F.floor(F.col("at") / width))
    picked = d.select("stratum", "draw", "at", "cell").join(v, ["stratum", "cell"]).where((F.col("at") >= F.col("floor")) & (F.col("at") < F.col("top")))
    return picked.select("stratum", "draw", "vol", (F.col("at") - F.col("floor")).alias("ordinal"))


def drawn_pages(draws: DataFrame, pages: DataFrame) -> DataFrame:
    """``draws(.., vol, ordinal)`` with ``page``: the page of that place among the volume's ``pages(vol, page)`` of the category.

    Only the pages of drawn volumes are numbered. A draw whose volume has fewer pages keeps a null page.
    """
    own = pages.select("vol", "page").join(draws.select("vol").distinct(), "vol", "left_semi")
    placed = own.withColumn("ordinal", (F.row_number().over(Window.partitionBy("vol").orderBy("page")) - 1).cast("long"))
    return draws.join(placed, ["vol", "ordinal"], "left")


def size_audit(pages: DataFrame, most: int | None = None) -> DataFrame:
    """``rank, vol, pages``: all volumes, largest first, equal ones by name; with ``most`` the first so many.

    Volumes are numbered inside the ranges of their order; the counts of the ranges before, as many as there are ranges, are added.
    """
    sizes = pages.groupBy("vol").agg(F.count("*").alias("pages"))
    if most is not None:
        sizes = sizes.orderBy(F.desc("pages"), F.asc_nulls_last("vol")).limit(most)
    order = sizes.repartitionByRange(F.desc("pages"), F.asc_nulls_last("vol")).sortWithinPartitions(F.desc("pages"), F.asc_nulls_last("vol"))
    ranges = written(order.select("vol", "pages", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "volume-sizes")
    shifts, before = [F.lit(-1), F.lit(0).cast("long")], 0
    for r in ranges.groupBy("part").agg(F.count("*").alias("size"), F.min("at").alias("first")).orderBy("part").collect():
        shifts += [F.lit(r.part), F.lit(before - r["first"] + 1).cast("long")]
        before += r["size"]
    return ranges.select((F.col("at") + F.element_at(F.create_map(*shifts), F.col("part"))).cast("int").alias("rank"), "vol", "pages")


def yearly_share(pages: DataFrame, reach: int = 2) -> DataFrame:
    """``year, share, smoothed`` of ``pages(year, hits, total)``: the moving sum is divided by one less than the years it spans."""
    yearly = pages.groupBy("year").agg((F.sum("hits") / F.sum("total")).alias("share"))
    w = Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(-reach, reach)  # one row a year
    return yearly.withColumn("smoothed", F.try_divide(F.sum("share").over(w), F.count("share").over(w) - 1))
