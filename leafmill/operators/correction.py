"""Correction of tokens by context, verse-like runs of lines, rejoined line ends, headers by block matching."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import words
from leafmill.operators.lines import PAGE, accepted_lines, both_lines, near_pairs, page_order, roman_numeral

UNSEEN = 3  # the weight of a word pair that the bigrams don't have


def in_volume():
    return Window.partitionBy("vol").orderBy("page", "line", "pos")


def disambiguate(tokens: DataFrame, pairs: DataFrame, bigrams: DataFrame, logs: DataFrame) -> DataFrame:
    """Tokens in which a suspect word (``pairs(first, second)``) has taken the form that fits its neighbours better.

    A form's weight is the product of its bigram weights (``bigrams(a, b, weight)``) with the words
    before and after; a pair that isn't there weighs ``UNSEEN`` plus the form's log frequency. Equal
    weights keep the word. ``logs(word, log)``. The first and last words of a volume have one neighbour.
    Tokens that come with ``before`` and ``after`` need no order.
    """
    w = in_volume()
    t = tokens.withColumn("word", F.lower("token"))
    if "before" in tokens.columns:
        t = t.withColumn("before", F.lower("before")).withColumn("after", F.lower("after"))
    else:
        t = t.withColumn("before", F.lag("word").over(w)).withColumn("after", F.lead("word").over(w))
    t = t.join(pairs.select(F.col("first").alias("word"), F.col("second").alias("other")), "word", "left")
    suspect = t.where(F.col("other").isNotNull())
    for form, name in (("word", "j"), ("other", "h")):
        suspect = suspect.join(logs.select(F.col("word").alias(form), F.col("log").alias(f"{name}_log")), form, "left").withColumn(f"{name}_least", UNSEEN + F.coalesce(f"{name}_log", F.lit(0.0)))
        suspect = suspect.join(bigrams.select(F.col("a").alias("before"), F.col("b").alias(form), F.col("weight").alias(f"{name}_b")), ["before", form], "left")
        suspect = suspect.join(bigrams.select(F.col("a").alias(form), F.col("b").alias("after"), F.col("weight").alias(f"{name}_a")), ["after", form], "left")
        suspect = suspect.withColumn(name, F.coalesce(f"{name}_b", f"{name}_least") * F.coalesce(f"{name}_a", f"{name}_least"))
    return suspect.select(*PAGE, "line", "pos", "word", F.when(F.col("h") > F.col("j"), F.col("other")).otherwise(F.col("word")).alias("form"))


def verse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``tag`` (yes, no, runon, number, blank, amb by the first letter, digit or bracket) and ``verse``.

    A line is verse-like if it and its neighbours in the eight lines before and after, up to a line
    that begins with a small letter, have over four capitals, of which some follow. At most four count
    before and five after. A short small-letter line after a long capital one runs on and is no break.
    """
    w = Window.partitionBy("vol").orderBy("page", "line")
    first, size = F.regexp_extract("text", r"[\p{Lu}\p{Ll}\p{N}<]", 0), F.length("text")
    tag = F.when(size < 1, "blank").when(first.rlike(r"\p{Lu}"), "yes").when(first.rlike(r"\p{Ll}"), "no").when(first.rlike(r"\p{N}"), "number").when(first == "<", "blank").otherwise("amb")
    t = lines.withColumn("tag", tag).withColumn("at", F.row_number().over(w))
    run_on = (F.col("tag") == "no") & (F.lag("tag").over(w) == "yes") & (size < 29) & (F.lag(size).over(w) - size > 12)
    t = t.withColumn("tag", F.when(run_on, "runon").otherwise(F.col("tag"))).withColumn("cap", F.when(F.col("tag") == "yes", 1).otherwise(0))
    t = t.withColumn("part", F.sum(F.when(F.col("tag") == "no", 1).otherwise(0)).over(w))
    part = Window.partitionBy("vol", "part").orderBy("at")
    before, after = F.least(F.lit(4), F.sum("cap").over(part.rangeBetween(-8, 0))), F.least(F.lit(5), F.sum("cap").over(part.rangeBetween(0, 8)))
    verse = (F.col("tag") != "no") & (before + after > 4) & (after > 0)
    return t.withColumn("verse", verse).select(*PAGE, "line", "text", "tag", "verse")


def verse_word_counts(tagged: DataFrame, lexicon: DataFrame, personal: DataFrame) -> DataFrame:
    """``vol, page, verse, word, n`` of lines with ``verse``: known words and classes of tokens by verse and prose.

    Numbers and capitalised names count as ``arabicnumeral``, ``romannumeral`` and ``personalname``,
    unknown words in title case as ``titlecasenodict``; other unknown tokens don't count.
    """
    t = tagged.select(*PAGE, "verse", F.explode(words.tokens_of(F.col("text"))).alias("token")).withColumn("case", words.case_of(F.col("token")))
    t = t.withColumn("plain", words.without_possessive(words.stripped_by_pattern(words.normal_case(F.col("token"))))).withColumn("low", F.lower("plain"))
    for table, flag in ((lexicon, "known"), (personal, "personal")):
        t = t.join(table.select(F.col("word").alias("low"), F.lit(True).alias(flag)), "low", "left")
    form = (
        F.when(roman_numeral(F.col("low")), "romannumeral")
        .when(words.number_class(F.col("plain")).isNotNull(), "arabicnumeral")
        .when(F.col("case").isin("title", "upper") & F.col("personal").isNotNull(), "personalname")
        .when(F.col("known").isNotNull(), F.col("low"))
        .when(F.col("case") == "title", "titlecasenodict")
    )
    return t.withColumn("word", form).where("word IS NOT NULL").groupBy(*PAGE, "verse", "word").agg(F.count("*").alias("n"))


def rejoin_hyphens(lines: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Line ends that a hyphen splits and that should be one word: ``vol, page, line, last, next``.

    They join if the mean-like share of the parts' frequencies (a third of their sum) is below the
    joined word's. One boundary at a time. ``frequencies(word, n)``.
    """
    w = Window.partitionBy(*PAGE).orderBy("line")
    t = lines.where(F.trim("text") != "").withColumn("s", F.lower(F.trim("text"))).withColumn("following", F.lead("s").over(w))
    t = t.where(F.col("s").rlike("[-—]$") & F.col("following").isNotNull())
    t = t.withColumn("last", F.regexp_replace(F.element_at(F.split("s", r"\s+"), -1), "[-—]+$", "")).withColumn("next", words.stripped(F.split("following", r"\s+")[0])).withColumn("joined", F.concat("last", "next"))
    for c in ("last", "next", "joined"):
        t = t.join(frequencies.select(F.col("word").alias(c), F.col("n").alias("n_" + c)), c, "left")
    n = lambda c: F.coalesce("n_" + c, F.lit(0))
    return t.where((n("last") + n("next")) / 3 < n("joined")).select(*PAGE, "line", "last", "next")


def similarity(a: str, b: str):
    """The share of matching characters in blocks of two string columns."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(ratio, "double")(a, b)


def running_headers_exact(lines: DataFrame, least: float = 0.8) -> DataFrame:
    """Like ``running_headers`` with the block-matching ratio; pairs whose lengths rule the bound out are never compared."""
    first = accepted_lines(lines).where(F.col("line") < 5).withColumn("key", F.lower(F.trim(F.regexp_replace("s", r"\p{Nd}", "")))).where(F.length("key") >= 5)
    heads = first.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line"))).where("rank <= 2").select(*PAGE, "line", "key").join(page_order(lines), PAGE)
    a, b = F.length("key"), F.length("key_b")
    pairs = near_pairs(heads).where(2 * F.least(a, b) > least * (a + b)).withColumn("ratio", similarity("key", "key_b"))
    return both_lines(pairs.where(F.col("ratio") > least))
