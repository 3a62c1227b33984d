"""Line and page structure. Input: ``lines(vol, page, line, text)`` or ``tokens(vol, page, line, pos, token)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import words
from leafmill.sources.staged import written

PAGE = ["vol", "page"]


def accepted_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not markup, with ``s``: the text without blanks at its ends."""
    return lines.where(~words.is_markup(F.col("text"))).withColumn("s", F.trim("text"))


def structure_counts(lines: DataFrame) -> DataFrame:
    """The line, punctuation, line-end and length features of each page in one aggregation."""
    own, s = accepted_lines(lines), F.col("s")
    some = F.length(s) > 0
    count = lambda *marks: F.sum(F.length(s) - F.length(reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit("")), marks, s)))
    return own.groupBy(*PAGE).agg(
        F.count("*").alias("lines"),
        F.count_if(F.length(s) > 1).alias("textlines"),
        F.count_if(s.rlike(r"^\p{Lu}")).alias("caplines"),
        count(",").alias("commas"),
        count(".").alias("periods"),
        count('"', "“", "”").alias("quotations"),
        count("!").alias("exclamationpoints"),
        count("?").alias("questionmarks"),
        F.count_if(F.right(s, F.lit(2)).rlike(words.PUNCTUATION + "$") & ~s.endswith("-")).alias("endwpunct"),
        F.count_if(F.right(s, F.lit(3)).rlike(r"\p{Nd}.?$")).alias("endwnumeral"),
        F.floor(100 * F.coalesce(F.stddev_pop(F.when(some, F.length(s))), F.lit(0.0)) + 1e-9).cast("long").alias("stdev"),
    )


def line_starts(lines: DataFrame, lexicon: DataFrame, names: DataFrame) -> DataFrame:
    """``startwname``: capitalised first words that are not in the lexicon, or are names or honorifics; ``startwrubric``: those that end in a dot."""
    first = accepted_lines(lines).where("s <> ''").select(*PAGE, F.split("s", " ").getItem(0).alias("first"))
    first = first.where(F.col("first").rlike(r"^\p{Lu}")).withColumn("word", F.lower(words.stripped(F.col("first"))))
    known = first.join(lexicon.select("word", F.lit(True).alias("known")), "word", "left").join(names.select("word", F.lit(True).alias("name")), "word", "left")
    return known.groupBy(*PAGE).agg(
        F.count_if(F.col("known").isNull() | F.col("name").isNotNull() | F.col("word").isin(words.HONORIFICS)).alias("startwname"), F.count_if(F.col("first").endswith(".")).alias("startwrubric")
    )


def initials(lines: DataFrame) -> DataFrame:
    """``maxinitial``: the commonest first letter's count; ``maxpair``: the largest count of two neighbouring letters."""
    counts = accepted_lines(lines).where("s <> ''").select(*PAGE, F.lower(F.substring("s", 1, 1)).alias("letter")).where(F.col("letter").rlike("^[a-z]$")).groupBy(*PAGE, "letter").count()
    n = F.ascii("letter")
    w = Window.partitionBy(*PAGE).orderBy(n)
    before = F.when(F.lag(n).over(w) == n - 1, F.lag("count").over(w)).otherwise(0)
    return counts.withColumn("pair", F.col("count") + before).groupBy(*PAGE).agg(F.max("count").alias("maxinitial"), F.max("pair").alias("maxpair"))


def capital_runs(lines: DataFrame) -> DataFrame:
    """``sequentialcaps``: the longest run of first capitals in alphabetical order; the first of a run does not count.

    Lines without a first capital neither break nor count. Before the first stands a vertical bar.
    """
    w = Window.partitionBy(*PAGE).orderBy("line")
    caps = accepted_lines(lines).where(F.col("s").rlike(r"^\p{Lu}")).withColumn("cap", F.substring("s", 1, 1))
    runs = caps.withColumn("stays", F.col("cap") >= F.lag("cap", 1, "|").over(w)).withColumn("run", F.sum(F.when(F.col("stays"), 0).otherwise(1)).over(w))
    return runs.groupBy(*PAGE, "run").agg(F.count_if("stays").alias("n")).groupBy(*PAGE).agg(F.max("n").alias("sequentialcaps"))


def tokens(lines: DataFrame) -> DataFrame:
    """``vol, page, line, pos, token`` of lines that are not markup."""
    own = lines.where(~words.is_markup(F.col("text")))
    return own.select(*PAGE, "line", F.posexplode(words.tokens_of(F.col("text"))).alias("pos", "token"))


def neighboured_tokens(lines: DataFrame) -> DataFrame:
    """``tokens(lines)`` with ``before`` and ``after``, their neighbours in the volume; the window is over lines, and texts are shuffled instead of tokens."""
    by_line = Window.partitionBy("vol").orderBy("page", "line")
    own = lines.where(~words.is_markup(F.col("text"))).select(*PAGE, "line", "text").repartition("vol").select(*PAGE, "line", words.tokens_of(F.col("text")).alias("own_")).where(F.size("own_") > 0)
    own = own.withColumn("last_", F.lag(F.element_at("own_", -1)).over(by_line)).withColumn("next_", F.lead(F.get("own_", F.lit(0))).over(by_line))
    size = F.size("own_")
    own = own.select(*PAGE, "line", "own_", F.concat(F.array("last_"), F.slice("own_", F.lit(1), size - 1)).alias("before_"), F.concat(F.slice("own_", F.lit(2), size), F.array("next_")).alias("after_"))
    told = own.select(*PAGE, "line", F.posexplode(F.arrays_zip("own_", "before_", "after_")).alias("pos", "w_"))
    return told.select(*PAGE, "line", "pos", F.col("w_.own_").alias("token"), F.col("w_.before_").alias("before"), F.col("w_.after_").alias("after"))


def token_counts(lines: DataFrame) -> DataFrame:
    """``token, n``: the tokens of lines that are not markup, counted.

    What makes tokens of a line looks at nothing beyond white space, so words between spaces are counted first and each is taken apart once.
    """
    return _said_tokens(lines).groupBy("token").agg(F.sum("n").alias("n"))


def _said_tokens(lines: DataFrame) -> DataFrame:
    own = lines.where(~words.is_markup(F.col("text"))).select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return own.select(F.explode(words.tokens_of(F.col("word"))).alias("token"), "n")


def word_counts(tokens: DataFrame, with_caps: bool = False) -> DataFrame:
    """``vol, page, word, n``; tokens without letters and digits are left out. With ``with_caps`` also ``caps``: those in capitals."""
    caps = [F.count_if(words.case_of(F.col("token")) == "upper").alias("caps")] * with_caps
    return tokens.where(~words.no_alphanumeric(F.col("token"))).groupBy(*PAGE, F.lower("token").alias("word")).agg(F.count("*").alias("n"), *caps)


def page_keys(pages: DataFrame) -> DataFrame:
    """``vol, page, times, lined`` from ``pages(vol, page, text)``: the rows that a page has, and whether one of its lines is not markup."""
    text = F.col("text")
    lined = ~F.ltrim(text).startswith("<") | F.exists(F.split(text, "\n", -1), lambda x: ~words.is_markup(x))
    return pages.groupBy(*PAGE).agg(F.count("*").alias("times"), F.bool_or(lined).alias("lined"))


def whole_pages(pages: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``vol, page, text, rows`` with one row for each page; ``rows``, if ``columns`` are named, has these of each row it was made from. ``keys``: ``page_keys``.

    Texts of rows that repeat a page follow each other as its lines. Only these texts are shuffled.
    """
    repeated = written(keys.where("times > 1").select(*PAGE), "repeated-pages")
    one = pages.join(repeated, PAGE, "left_anti").select(*PAGE, "text", F.array(F.struct(*columns)).alias("rows"))
    more = pages.join(repeated, PAGE, "left_semi").groupBy(*PAGE).agg(F.concat_ws("\n", F.collect_list("text")).alias("text"), F.collect_list(F.struct(*columns)).alias("rows"))
    both = one.unionByName(more)
    return both if columns else both.drop("rows")


def joined_lines(lines: DataFrame) -> DataFrame:
    """``vol, page, text`` with one row for each page of ``lines(vol, page, line, text)``. Null texts are empty lines."""
    own = F.struct("line", F.translate(F.coalesce("text", F.lit("")), "\n", " ").alias("text"))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["text"]), "\n").alias("text"))


def ordered_pages(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """``vol, page, text`` with one row for each page. ``keys(vol, page, times)``: the rows that each has.

    Lines of rows that repeat a page come by their numbers. Only texts of these are shuffled.
    """
    repeated = keys.where("times > 1").select(*PAGE)
    if repeated.isEmpty():
        return pages.select(*PAGE, "text")
    one = pages.join(repeated, PAGE, "left_anti").select(*PAGE, "text")
    more = pages.join(repeated, PAGE, "left_semi").select(*PAGE, F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return one.unionByName(joined_lines(more))


def counted_words(pages: DataFrame, caps_as: str | None = None) -> DataFrame:
    """``word, n`` beside the other columns of ``pages``, which have one row each, instead of ``text``: the words of ``word_counts``.

    A page is counted where it is read, so neither tokens nor counts are shuffled. Marks that make tokens do not reach over the end of a
    line. ``caps_as`` names a row more for each page with words: how many tokens are in capitals.
    """
    others = [c for c in pages.columns if c != "text"]
    plain = F.when(F.col("text").contains("<"), F.regexp_replace("text", words.MARKUP_LINE, "")).otherwise(F.col("text"))
    t = pages.select(*others, F.filter(F.split(words.padded(plain), r"\s+"), lambda x: ~words.no_alphanumeric(x)).alias("own_"))
    caps = [F.size(F.filter("own_", words.is_upper)).cast("long").alias("caps_")] * bool(caps_as)
    t = t.select(*others, *caps, F.sort_array(F.transform("own_", F.lower)).alias("own_"))
    size = F.size("own_")
    first = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("own_", i) != F.get("own_", i - 1)))
    t = t.withColumn("first_", F.when(size > 0, first).otherwise(F.array().cast("array<int>")))
    counted = F.transform("first_", lambda i, k: F.struct(F.get("own_", i).alias("word"), (F.coalesce(F.get("first_", k + 1), size) - i).cast("long").alias("n")))
    if caps_as:
        counted = F.when(size > 0, F.concat(F.array(F.struct(F.lit(caps_as).alias("word"), F.col("caps_").alias("n"))), counted))
    # inline_outer: a filter on the size of the array would be pushed below and work it out anew for each element
    return t.select(*others, counted.alias("counted_")).select(*others, F.inline_outer("counted_")).where(F.col("word").isNotNull())


def lexicon_of(tokens: DataFrame, least: int) -> DataFrame:
    """``word, n``: stripped lower-case tokens that occur at least ``least`` times."""
    return _frequent(tokens.groupBy(words.stripped(F.lower("token")).alias("word")).agg(F.count("*").alias("n")), least)


def lexicon_of_counts(counts: DataFrame, least: int) -> DataFrame:
    """The same from counts of lower-case tokens (``word, n``): a token is stripped once for each count."""
    return _frequent(counts.groupBy(words.stripped(F.col("word")).alias("word")).agg(F.sum("n").alias("n")), least)


def lexicon_of_lines(lines: DataFrame, least: int) -> DataFrame:
    """The same from lines: words between spaces are counted, each is taken apart and stripped once for each count."""
    return lexicon_of_counts(_said_tokens(lines).select(F.lower("token").alias("word"), "n"), least)


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    """Counted words of letters alone; the letters are looked at only where the count is high enough."""
    return counted.where(F.when(F.col("n") >= least, F.col("word").rlike(r"^\p{L}+$")).otherwise(False))


def known_of(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``vol, page, known`` of every token: 1 where its stripped lower-case form is in the lexicon, else null."""
    return tokens.select(*PAGE, F.lower(words.stripped(F.col("token"))).alias("word")).join(lexicon.select("word", F.lit(1).alias("known")), "word", "left").select(*PAGE, "known")


def normal_form(tokens: DataFrame, lexicon: DataFrame, personal: DataFrame, places: DataFrame) -> DataFrame:
    """Each token's logged form: number and name classes, or its normalised word. Rule tables: ``word``.

    ``tokens`` are tokens or counted ones (``token`` and any other columns); ``case`` and ``form`` are added.
    """
    own = tokens.columns
    t = tokens.where(~words.no_alphanumeric(F.col("token"))).withColumn("case", words.case_of(F.col("token")))
    t = t.withColumn("plain", words.without_possessive(words.stripped_by_pattern(words.normal_case(F.col("token"))))).withColumn("word", F.lower("plain"))
    for table, flag in ((lexicon, "known"), (personal, "personal"), (places, "place")):
        t = t.join(table.select("word", F.lit(True).alias(flag)), "word", "left")
    number, capital = words.number_class(F.col("plain")), F.col("case").isin("title", "upper")
    return t.select(
        *own, "case",
        F.when(roman_numeral(F.col("word")), "romannumeral")
        .when(number.isNotNull(), number)
        .when(capital & F.col("personal").isNotNull(), "personalname")
        .when(capital & F.col("place").isNotNull(), "placename")
        .when((F.col("case") == "title") & (F.length("word") > 4) & F.col("known").isNull(), "propernoun")
        .otherwise(F.col("word")).alias("form"),
    )


def roman_numeral(word: Column) -> Column:
    """Whether a lower-case word is a roman numeral from 2 to 499. ``i`` is not taken for one, as it is mostly the pronoun."""
    return word.rlike("^(cd|c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & ~word.isin("", "i")


def match_rates(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per volume: tokens, and the share of non-numeric ones found in the lexicon as they are or with the following one fused."""
    w = Window.partitionBy("vol").orderBy("page", "line", "pos")
    t = tokens.withColumn("word", F.lower(words.stripped(F.col("token")))).withColumn("fused", F.concat("word", F.lead("word").over(w)))
    t = t.where(~words.mostly_numeric(F.col("token")) & ~words.no_alphanumeric(F.col("token")))
    known = lexicon.select("word", F.lit(1).alias("known"))
    t = t.join(known, "word", "left").join(known.select(F.col("word").alias("fused"), F.col("known").alias("pair")), "fused", "left")
    return t.groupBy("vol").agg(F.count("*").alias("tokens"), F.avg(F.when(F.col("known").isNotNull() | F.col("pair").isNotNull(), 1.0).otherwise(0.0)).alias("matched"))


def long_s_suspicion(tokens: DataFrame) -> DataFrame:
    """Per volume: words with f that should have s, and those with s, plus one each; a problem unless the latter are more."""
    t = tokens.select("vol", F.lower(words.stripped(F.col("token"))).alias("word"))
    counted = t.groupBy("vol").agg((F.count_if(F.col("word").isin(words.LONG_S_ERRORS)) + 1).alias("errors"), (F.count_if(F.col("word").isin(words.LONG_S_TRUTHS)) + 1).alias("truths"))
    return counted.withColumn("problem", F.col("truths") <= F.col("errors"))


def running_headers(lines: DataFrame, least: float = 0.8) -> DataFrame:
    """Lines among the first two of a page that resemble one on the two pages before (by edit distance), and those they resemble.

    Of a page's first five lines, the first two that still have five characters without digits count.
    Volumes of under five pages have no headers.
    """
    first = accepted_lines(lines).where(F.col("line") < 5).withColumn("key", F.lower(F.trim(F.regexp_replace(F.regexp_replace("s", r"\p{Nd}", ""), "iii|ii|xx", ""))))
    first = first.where(F.length("key") >= 5)
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line"))
    heads = first.withColumn("rank", rank).where("rank <= 2").select(*PAGE, "line", "key").join(page_order(lines), PAGE)
    large = heads.groupBy("vol").agg(F.count_distinct("page").alias("n")).where("n >= 5").select("vol")
    pairs = near_pairs(heads.join(large, "vol", "left_semi"))
    size = F.greatest(F.length("key"), F.length("key_b"))
    pairs = pairs.where((F.least(F.length("key"), F.length("key_b")) > least * size) & (1 - F.levenshtein("key", "key_b") / size > least))
    return both_lines(pairs)


def page_order(lines: DataFrame) -> DataFrame:
    """``vol, page, seq``: the place of a page in its volume."""
    return lines.select(*PAGE).distinct().withColumn("seq", F.row_number().over(Window.partitionBy("vol").orderBy("page")) - 1)


def near_pairs(heads: DataFrame) -> DataFrame:
    """Each head line with those of the two pages before, as an equi-join on the place they would have."""
    other = heads.select("vol", F.explode(F.array(F.col("seq") + 1, F.col("seq") + 2)).alias("seq"), F.col("page").alias("page_b"), F.col("line").alias("line_b"), F.col("key").alias("key_b"))
    return heads.where("seq >= 2").join(other, ["vol", "seq"])


def both_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select("vol", F.inline(F.array(F.struct("page", "line"), F.struct(F.col("page_b").alias("page"), F.col("line_b").alias("line"))))).distinct()


def without_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    return lines.join(headers.select(*PAGE, "line"), [*PAGE, "line"], "left_anti")


def header_upvote(counts: DataFrame, lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Page word counts in which meaningful header words get two more, or two if they were not there."""
    words_ = tokens(lines.join(headers, [*PAGE, "line"], "left_semi")).select(*PAGE, F.lower(words.stripped(F.col("token"))).alias("word"))
    extra = words_.where(F.col("word").isin(words.HEADER_WORDS)).distinct().withColumn("more", F.lit(2))
    return counts.join(extra, [*PAGE, "word"], "full_outer").select(*PAGE, "word", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))


def caps_outliers(lines: DataFrame, factor: float = 2.25) -> DataFrame:
    """Pages whose share of capitalised lines is far from that of the pages so far. Only pages of over three lines count."""
    own = accepted_lines(lines).where(F.length("s") >= 2)
    share = own.groupBy(*PAGE).agg(F.count("*").alias("n"), F.avg(F.when(F.col("s").rlike(r"""^["“']?\p{Lu}"""), 1.0).otherwise(0.0)).alias("share")).where("n > 3")
    w = Window.partitionBy("vol").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return share.withColumn("outlier", F.abs(F.col("share") - F.avg("share").over(w)) > factor * F.stddev_pop("share").over(w) + 1e-9)


def phrase_counts(tokens: DataFrame, phrases: DataFrame, pages: DataFrame, categories: list[str] | None = None, longest: int = 4) -> DataFrame:
    """``vol, category, phrase, n``: phrases (``phrase``) that end at a token, the shortest at each place.

    A phrase counts only where its first word, or the one after a small ``the``, begins with a capital;
    it is compared in small letters without punctuation at its end, and may begin on an earlier page. It
    counts for the category of its last word's page: that of ``pages(vol, page, category)``, or of the
    last page before that has words and a category; before any of these it counts for none. With
    ``categories`` only those count.
    """
    w = Window.partitionBy("vol").orderBy("page", "line", "pos")
    plain = lambda c: F.regexp_replace(F.lower(c), f"(?<=.){words.PUNCTUATION}+$", "")
    t = tokens.select(*PAGE, "line", "pos", *[F.lag("token", i).over(w).alias(f"w{i}") for i in range(longest)])
    capital = lambda i: F.col(f"w{i}").rlike(r"^\p{Lu}")
    starts = lambda k: capital(k - 1) | ((F.col(f"w{k - 1}") == "the") & capital(k - 2)) if k > 1 else capital(0)
    ends = [F.when(starts(k), F.struct(F.lit(k).alias("k"), plain(F.concat_ws(" ", *[f"w{i}" for i in range(k - 1, -1, -1)])).alias("phrase"))) for k in range(1, longest + 1)]
    found = t.select(*PAGE, "line", "pos", F.inline(F.filter(F.array(*ends), lambda x: x.isNotNull())))
    best = found.join(phrases.select(plain(F.col("phrase")).alias("phrase")).distinct(), "phrase", "left_semi").groupBy(*PAGE, "line", "pos").agg(F.min_by("phrase", "k").alias("phrase"))
    carried = Window.partitionBy("vol").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    own = tokens.select(*PAGE).distinct().join(pages.select(*PAGE, "category"), PAGE, "left").withColumn("category", F.last("category", ignorenulls=True).over(carried)).where("category IS NOT NULL")
    if categories is not None:
        own = own.where(F.col("category").isin(categories))
    return best.join(own, PAGE).groupBy("vol", "category", "phrase").agg(F.count("*").alias("n"))
