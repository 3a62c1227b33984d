"""Page features, vectors and vocabularies. ``features(vol, page, feature, count)`` is the long form; names with ``#`` are structural."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import lines as L
from leafmill.sources.staged import written

OTHER = "wordNotInVocab"
PAGE = ["vol", "page"]

# Category codes and the broad categories they fold into.
CONVERSIONS = {
    "subsc": "front", "argum": "non", "pref": "non", "aut": "non", "bio": "non", "toc": "front", "title": "front", "bookp": "front",
    "bibli": "ads", "gloss": "back", "index": "back", "epi": "fic", "errat": "non", "notes": "non", "ora": "non",
    "let": "non", "trv": "non", "lyr": "poe", "nar": "poe", "vdr": "dra", "pdr": "dra",
    "clo": "dra", "impri": "front", "libra": "back",
}
# Words that a vocabulary always has.
FORCED_WORDS = ["index", "glossary", "argument", "biographical", "memoir", "memoirs", "autobiography", "dramatis", "personae", "contents", "table", "arabicprice", "appendix", "preface", "ode", "scene"]


def word_features(words: DataFrame) -> DataFrame:
    """``features`` from the words of pages, ``words(vol, page, word, n)``."""
    return words.select(*PAGE, F.col("word").alias("feature"), F.col("n").alias("count"))


def line_features(lines: DataFrame, lexicon: DataFrame, names: DataFrame) -> DataFrame:
    """``features`` of what ``lines(vol, page, line, text)`` and their capitals say, under ``#`` names.

    ``lexicon(word)`` and ``names(word)`` tell which lines begin with a name.
    """

    def long(wide: DataFrame, *names: str) -> DataFrame:
        return wide.select(*PAGE, F.inline(F.array(*[F.struct(F.lit("#" + c).alias("feature"), F.col(c).cast("long").alias("count")) for c in names])))

    parts = [
        long(L.structure_counts(lines), "lines", "textlines", "caplines", "commas", "exclamationpoints", "questionmarks", "endwpunct", "endwnumeral"),
        long(L.initials(lines), "maxinitial", "maxpair"),
        long(L.line_starts(lines, lexicon, names), "startwname", "startwrubric"),
        long(L.capital_runs(lines), "sequentialcaps"),
    ]
    return reduce(DataFrame.unionByName, parts)


def fold_vocabulary(features: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Words outside ``vocabulary(word)`` become one catch-all feature of their page, with counts summed."""
    known = features.join(vocabulary.select(F.col("word").alias("feature"), F.lit(True).alias("known")), "feature", "left")
    name = F.when(F.col("known").isNotNull() | F.col("feature").startswith("#"), F.col("feature")).otherwise(OTHER)
    return known.groupBy(*PAGE, name.alias("feature")).agg(F.sum("count").alias("count"))


def fold_page_words(words: DataFrame, structural: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``fold_vocabulary`` of ``words(vol, page, word, n)``, one row for each page and word, and of ``structural`` features.

    Known words stay as they are; only what becomes the catch-all, and names with ``#``, which a word may share, are summed.
    """
    features = word_features(words)
    plain, known = features.where(~F.col("feature").startswith("#")), vocabulary.select(F.col("word").alias("feature"))
    other = plain.join(known, "feature", "left_anti").groupBy(*PAGE).agg(F.lit(OTHER).alias("feature"), F.sum("count").alias("count"))
    named = structural.unionByName(features.where(F.col("feature").startswith("#"))).groupBy(*PAGE, "feature").agg(F.sum("count").alias("count"))
    return plain.join(known, "feature", "left_semi").unionByName(other).unionByName(named)


def volume_totals(features: DataFrame) -> DataFrame:
    """Per volume: distinct pages, largest page, words, and mean lines and words of a page (1 where 0)."""
    own = features.where("page >= 0")
    words = F.when(~F.col("feature").startswith("#"), F.col("count"))
    lines = F.when(F.col("feature") == "#textlines", F.col("count"))
    t = own.groupBy("vol").agg(F.count_distinct("page").alias("pages"), F.max("page").alias("max_page"), F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.coalesce(F.sum(lines), F.lit(0)).alias("lines"))
    mean = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c) / F.col("pages"))
    return t.select("vol", "pages", "max_page", "words", mean("lines").alias("mean_lines"), mean("words").alias("mean_words"))


def relative_frequencies(features: DataFrame) -> DataFrame:
    """Each word's count and share of its page's words, of which there are at least 0.0001."""
    own = features.where((F.col("page") >= 0) & ~F.col("feature").startswith("#"))
    total = 0.0001 + F.sum("count").over(Window.partitionBy(*PAGE))
    return own.select(*PAGE, "feature", "count", (F.col("count") / total).alias("share"))


def structural_features(features: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The 26 structural features of each page in one aggregation and one join with the totals of its volume.

    ``evidence(vol, biography, fiction)`` gives the last two; volumes without have 0 there.
    """
    f, n = F.col("feature"), F.col("count")
    value = lambda name, least=0.0: F.coalesce(F.max(F.when(f == name, n)).cast("double"), F.lit(least))
    word = ~f.startswith("#")
    types = F.sum(F.when(word, F.when(f == OTHER, n).when(f.isin("propernoun", "placename"), n).otherwise(1)).otherwise(0))
    page = features.where("page >= 0").groupBy(*PAGE).agg(
        (0.0001 + F.coalesce(F.sum(F.when(word, n)), F.lit(0))).alias("W"), types.alias("types"), value("#textlines", 0.0001).alias("T0"), value("#lines", 0.0001).alias("L"), value("#caplines", 0.0001).alias("C"),
        *[value("#" + x).alias(x) for x in ("allcapswords", "maxinitial", "maxpair", "commas", "exclamationpoints", "questionmarks", "endwpunct", "endwnumeral", "startwname", "startwrubric", "sequentialcaps")],
    )
    page = page.withColumn("T", F.when(F.col("T0") < 0.1, 0.001).otherwise(F.col("T0"))).join(volume_totals(features), "vol")
    if evidence is None:
        page = page.withColumns({x: F.lit(None).cast("boolean") for x in ("biography", "fiction")})
    else:
        page = page.join(evidence.select("vol", "biography", "fiction"), "vol", "left")
    e = F.expr
    type_token = "(types + 1) / (W + 1.5)"
    return page.select(
        *PAGE,
        e("try_divide(page, max_page)").alias("pos_in_vol"), e("T / mean_lines").alias("line_length_ratio"), e("C / T").alias("cap_ratio"), e("W / mean_words").alias("word_ratio"),
        e("try_divide(abs(page - (max_page div 2)), max_page)").alias("distance_from_mid"), e("allcapswords / W").alias("all_cap_ratio"), e("(maxinitial + 0.2) / (T + 0.5)").alias("max_initial_ratio"),
        e("(maxpair + 0.1) / (T + 0.5)").alias("max_pair_ratio"), e("W / T").alias("words_per_line"), e("W").alias("total_words"), e(type_token).alias("type_token"), e("commas / W").alias("commas_norm"),
        e("T / L").alias("textlines_per_line"), e(f"pow({type_token}, 2)").alias("type_token_squared"), e("exclamationpoints / W").alias("exclamations_norm"), e("questionmarks / W").alias("questions_norm"),
        e("(endwpunct + 0.1) / (T + 0.3)").alias("end_with_punct"), e("(endwnumeral + 0.01) / (T + 0.2)").alias("end_with_num"), e("startwname / T").alias("start_with_name"), e("startwrubric / T").alias("start_with_rubric"),
        e("sequentialcaps").alias("cap_sequence"), e("(sequentialcaps + 0.2) / (C + 2)").alias("cap_seq_norm"), e(f"{type_token} * ln(W + 50)").alias("log_type_token"), e("abs(W - mean_words) / mean_words").alias("abs_word_ratio"), *[F.coalesce(F.col(x).cast("int"), F.lit(0)).alias(f"meta_{x}") for x in ("biography", "fiction")],
    )


def zscore_fit(long: DataFrame) -> DataFrame:
    """Mean and population deviation of ``x`` for each ``feature``.

    Sums of many rows lose digits, so a first mean is taken off before the second sum, which then stays small.
    """
    near = long.groupBy("feature").agg(F.avg("x").alias("near"))
    off = long.join(F.broadcast(near), "feature").withColumn("off", F.col("x") - F.col("near"))
    return off.groupBy("feature").agg((F.first("near") + F.avg("off")).alias("mean"), F.stddev_pop("off").alias("sd"))


def zscore_apply(long: DataFrame, stats: DataFrame) -> DataFrame:
    """``x`` in deviations from the mean; 0 where the deviation is 0 or the value is null."""
    return long.join(stats, "feature").withColumn("z", F.when((F.col("sd") > 0) & F.col("x").isNotNull(), (F.col("x") - F.col("mean")) / F.col("sd")).otherwise(0.0))


def rounded(x, digits: int):
    """``x`` rounded as a double, ties of the scaled value away from zero; what rounds to zero keeps its sign."""
    scaled = x * F.lit(10.0**digits)
    near = F.signum(scaled) * F.round(F.abs(scaled)) / F.lit(10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), near).otherwise(x)


def magnitude(vector):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def fold_categories(frame: DataFrame, column: str = "category", separate: dict[str, str] | None = None) -> DataFrame:
    """Codes in ``column`` folded into broad categories; ``separate`` overrides the table."""
    table = CONVERSIONS | (separate or {})
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return frame.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def select_vocabulary(features: DataFrame, truth: DataFrame, per_category: int = 500, total: int = 2000, cap: int = 3) -> DataFrame:
    """``word, n``: the commonest words of each category, counted up to ``cap`` on a page, and the forced ones.

    Ties go to the larger word. The last page of a volume is left out.
    """
    last = features.groupBy("vol").agg(F.max("page").alias("last"))
    own = features.join(last, "vol").where((F.col("page") >= 0) & (F.col("page") < F.col("last")) & ~F.col("feature").startswith("#")).join(truth, PAGE)
    return _commonest(own.select("category", F.col("feature").alias("word"), F.col("count").alias("n")), per_category, total, cap)


def select_page_vocabulary(pages: DataFrame, per_category: int = 500, total: int = 2000, cap: int = 3) -> DataFrame:
    """``select_vocabulary`` from ``pages(vol, page, category, text)``, whose lines that are not markup make a page's features.

    Words are counted where their page is read: of pages only keys are shuffled, of words the sums for each category.
    """
    keys = written(L.page_keys(pages), "page-keys")
    last = written(keys.where("lined").groupBy("vol").agg(F.max("page").alias("last")), "last-pages")
    own = L.whole_pages(pages.join(last, "vol").where((F.col("page") >= 0) & (F.col("page") < F.col("last"))), keys, "category")
    counted = L.counted_words(own).where(~F.col("word").startswith("#"))
    return _commonest(counted.select(F.inline("rows"), "word", "n"), per_category, total, cap)


def _commonest(counted: DataFrame, per_category: int, total: int, cap: int) -> DataFrame:
    """The vocabulary from ``category, word, n``, one row for each category, page and word."""
    counts = counted.groupBy("category", "word").agg(F.sum(F.least("n", F.lit(cap))).alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), F.desc("word")))).where(F.col("rank") <= per_category)
    chosen = best.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("word")).limit(total)
    forced = counted.sparkSession.createDataFrame([(w,) for w in FORCED_WORDS], "word string")
    return chosen.unionByName(forced.join(chosen, "word", "left_anti").withColumn("n", F.lit(0).cast("long")))


def category_order(truth: DataFrame, position: str) -> DataFrame:
    """``idx, category``: begin, end, then the categories by first appearance."""
    first = truth.groupBy("category").agg(F.min(position).alias("first"))
    order = first.withColumn("idx", F.row_number().over(Window.orderBy("first", "category")) + 1).select("idx", "category")
    return truth.sparkSession.createDataFrame([(0, "begin"), (1, "end")], "idx int, category string").unionByName(order)


# The tags that stand for each kind of evidence.
EVIDENCE_TAGS = {"biography": ["Biography", "Autobiography"], "fiction": ["Fiction", "Novel"], "poetry": ["Poetry", "Poems"], "drama": ["Drama", "Tragedies", "Comedies"]}


def tag_evidence(volumes: DataFrame, metadata: DataFrame) -> DataFrame:
    """A flag for each kind of tag in ``metadata(vol, categories)`` (``;``-separated); all false for volumes without metadata."""
    tags = F.split("categories", ";")
    flags = [F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, names))), F.lit(False)).alias(kind) for kind, names in EVIDENCE_TAGS.items()]
    return volumes.join(metadata, "vol", "left").select("vol", *flags)


def dense_vectors(long: DataFrame, order: DataFrame) -> DataFrame:
    """``vol, page, features``: an ML vector of each page from ``long(vol, page, feature, z)``, by the index of ``order(feature, idx)``; absent features are 0.

    Features that ``order`` doesn't have are no part of the vector; a page of these alone has zeros.
    """
    from pyspark.ml.functions import array_to_vector

    n = order.count()
    known = F.when(F.col("idx").isNotNull(), F.struct("idx", "z"))
    entries = long.join(F.broadcast(order) if n <= 10_000 else order, "feature", "left").groupBy("vol", "page").agg(F.map_from_entries(F.collect_list(known)).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return entries.select("vol", "page", array_to_vector(cells).alias("features"))
