"""Queries on evaluation, confidence, metadata and alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import catalogue as C
from leafmill.operators import confidence as O
from leafmill.operators import evaluate as E
from leafmill.operators import sequence as S
from leafmill.plans.registry import EVENT_PAGES, CATEGORIES, LINES, PREDICTIONS, VOL_PAGES, query
from leafmill.sources.tables import event_pages, event_predictions, event_probabilities, table, volume_lines, volume_pages

CLASSES = [{"click", "view"}, {"signup", "error"}]
SAME = "(truth = pred OR (truth IN ('click', 'view') AND pred IN ('click', 'view')) OR (truth IN ('error', 'signup') AND pred IN ('error', 'signup')))"
JUDGED = PREDICTIONS + ", judged AS (SELECT vol, page, truth, category AS pred, words, event_id FROM predictions)"


def judged(spark, d):
    return event_predictions(spark, d).select("vol", "page", "truth", F.col("category").alias("pred"), "words", "event_id")


@query("e1_e2_errors", "WITH " + JUDGED + f" SELECT truth, pred, count(*) AS pages, round(sum(words), 2) AS words, {SAME} AS correct FROM judged GROUP BY truth, pred")
def e2(spark, d):
    return E.errors(judged(spark, d), CLASSES).withColumn("words", F.round("words", 2))


@query("e3_micro_accuracy", "WITH " + JUDGED + """, v AS (SELECT 'raw' AS variant, truth, words, pred AS p FROM judged UNION ALL SELECT 'fixed', truth, words, CASE WHEN event_id % 5 = 0 THEN 'view' ELSE pred END FROM judged)
SELECT variant, round(avg(CASE WHEN truth = p THEN 1.0::DOUBLE ELSE 0 END), 6) AS by_page, round(sum(CASE WHEN truth = p THEN words ELSE 0 END) / sum(words), 6) AS by_word FROM v GROUP BY variant""")
def e3(spark, d):
    pages = judged(spark, d).withColumn("fixed", F.when(F.col("event_id") % 5 == 0, "view").otherwise(F.col("pred")))
    return E.micro_accuracy(pages, {"raw": "pred", "fixed": "fixed"}).select("variant", F.round("by_page", 6).alias("by_page"), F.round("by_word", 6).alias("by_word"))


@query("e4_volume_accuracy", "WITH " + JUDGED + f" SELECT vol, round(avg(CASE WHEN {SAME} THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM judged GROUP BY vol")
def e4(spark, d):
    return E.volume_accuracy(judged(spark, d), CLASSES).withColumn("accuracy", F.round("accuracy", 6))


MERGED = "CASE {0} WHEN 'view' THEN 'click' WHEN 'error' THEN 'signup' ELSE {0} END"


@query("e5_precision_recall", "WITH " + JUDGED + f""", c AS (SELECT {MERGED.format('truth')} AS t, {MERGED.format('pred')} AS p, count(*) AS n FROM judged GROUP BY 1, 2),
g AS (SELECT t AS category FROM c UNION SELECT p FROM c), s AS (SELECT category, (SELECT sum(n) FROM c WHERE t = category) AS t, (SELECT sum(n) FROM c WHERE p = category) AS p, (SELECT sum(n) FROM c WHERE t = category AND p = category) AS tp FROM g)
SELECT category, round(100.0::DOUBLE * tp / p, 6) AS precision, round(100.0::DOUBLE * tp / t, 6) AS recall, round(200.0::DOUBLE * tp / (t + p), 6) AS f1 FROM s""")
def e5(spark, d):
    r = E.precision_recall(judged(spark, d), {"view": "click", "error": "signup"})
    return r.select("category", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("e6_failure_report", "WITH " + JUDGED + " SELECT vol, count(*) AS n FROM judged WHERE truth = 'view' AND pred = 'click' GROUP BY vol HAVING count(*) > 1")
def e6(spark, d):
    return judged(spark, d).where("truth = 'view' AND pred = 'click'").groupBy("vol").agg(F.count("*").alias("n")).where("n > 1")


COUNTS = JUDGED + """, counts AS (SELECT vol, g.category, count(*) FILTER (WHERE truth = g.category AND pred = g.category) AS tp, count(*) FILTER (WHERE truth <> g.category AND pred = g.category) AS fp,
  count(*) FILTER (WHERE truth = g.category AND pred <> g.category) AS fn, count(*) FILTER (WHERE truth <> g.category AND pred <> g.category) AS tn,
  round(coalesce(sum(words) FILTER (WHERE truth = g.category AND pred = g.category), 0), 4) AS tp_words, round(coalesce(sum(words) FILTER (WHERE truth <> g.category AND pred = g.category), 0), 4) AS fp_words
  FROM judged, (VALUES ('click'), ('view'), ('purchase')) g(category) GROUP BY vol, g.category)"""
THREE = ["click", "view", "purchase"]


@query("e7_binary_counts", "WITH " + COUNTS + " SELECT * FROM counts")
def e7(spark, d):
    return E.binary_counts(judged(spark, d), THREE).withColumns({c: F.round(c, 4) for c in ("tp_words", "fp_words")})


@query("e8_volume_precision", "WITH " + COUNTS + " SELECT vol, category, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision FROM counts")
def e8(spark, d):
    return E.volume_precision(E.binary_counts(judged(spark, d), THREE)).withColumn("precision", F.round("precision", 6))


@query("e9_match_share", "WITH " + JUDGED + f" SELECT vol, round(sum(CASE WHEN {SAME} THEN words ELSE 0 END) / sum(words), 6) AS share FROM judged GROUP BY vol")
def e9(spark, d):
    hit = F.when(E.equivalent(F.col("truth"), F.col("pred"), CLASSES), F.col("words")).otherwise(0.0)
    return judged(spark, d).groupBy("vol").agg(F.round(F.sum(hit) / F.sum("words"), 6).alias("share"))


TAGS = EVENT_PAGES + """, tags AS (SELECT vol, page, words, r AS rater, CASE WHEN (event_id + r) % 6 = 0 THEN 'view' WHEN (event_id + r) % 11 = 0 THEN 'click' ELSE category END AS category
  FROM event_pages, (VALUES (1), (2), (3)) x(r) WHERE NOT (r > 1 AND vol % 7 = 0)),
cons AS (SELECT vol, page, category FROM (SELECT *, row_number() OVER (PARTITION BY vol, page ORDER BY n DESC, first) AS rank FROM (SELECT vol, page, category, count(*) AS n, min(rater) AS first FROM tags GROUP BY ALL) a) b WHERE rank = 1)"""


def tags_of(spark, d):
    t = event_pages(spark, d).withColumn("rater", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("NOT (rater > 1 AND vol % 7 = 0)")
    k = F.col("event_id") + F.col("rater")
    return t.select("vol", "page", "words", "rater", F.when(k % 6 == 0, "view").when(k % 11 == 0, "click").otherwise(F.col("category")).alias("category"))


@query("e10_rater_agreement", "WITH " + TAGS + """, s AS (SELECT vol, count(DISTINCT rater) AS raters FROM tags GROUP BY vol HAVING count(DISTINCT rater) > 1)
SELECT t.vol, s.raters, round((sum(words) - sum(CASE WHEN t.category <> c.category THEN words ELSE 0 END)) / sum(words), 6) AS agreement FROM tags t JOIN s USING (vol) JOIN cons c ON c.vol = t.vol AND c.page = t.page GROUP BY t.vol, s.raters""")
def e10(spark, d):
    t = tags_of(spark, d)
    return E.rater_agreement(t, E.rater_consensus(t)).withColumn("agreement", F.round("agreement", 6))


PARENTS = {"click": "view", "error": "view", "purchase": "signup"}
ABOVE = ", ".join(f"('{a}', '{b}')" for a, b in PARENTS.items()) + ", " + ", ".join(f"('{g}', '{g}')" for g in CATEGORIES)


@query("e21_rater_consensus", "WITH " + TAGS + f""", line(category, above) AS (VALUES {ABOVE}), c AS (SELECT vol, page, category, count(*) AS n, min(rater) AS first FROM tags GROUP BY ALL),
tied AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY vol, page) AS most FROM c) x WHERE n = most),
general AS (SELECT a.vol, a.page, a.category FROM tied a JOIN tied b ON a.vol = b.vol AND a.page = b.page LEFT JOIN line ON line.category = b.category AND line.above = a.category GROUP BY a.vol, a.page, a.category HAVING count(*) = count(line.above)),
led AS (SELECT vol, page, min_by(category, first) AS category FROM tied GROUP BY vol, page)
SELECT led.vol, led.page, coalesce(general.category, led.category) AS category FROM led LEFT JOIN general ON general.vol = led.vol AND general.page = led.page""")
def e21(spark, d):
    return E.rater_consensus(tags_of(spark, d), PARENTS)


VOLUME_COUNTS = EVENT_PAGES + ", vc AS (SELECT vol, count(*) AS n, count(*) FILTER (WHERE category = 'signup') AS dra, count(*) FILTER (WHERE category = 'error') AS poe, count(*) FILTER (WHERE category = 'click') AS fic, count(*) FILTER (WHERE category = 'view') AS non FROM event_pages GROUP BY vol)"


E12_META = ", cm AS (SELECT c_custkey AS vol, CASE c_custkey % 6 WHEN 0 THEN 'Biography;Maps' WHEN 1 THEN 'Novel' WHEN 2 THEN 'Maps;Tragedies' ELSE 'Maps' END AS categories, CASE c_custkey % 5 WHEN 0 THEN 'The Poetical Works' WHEN 1 THEN 'Displays' ELSE c_name END AS title FROM customer WHERE c_custkey % 4 <> 0)"


@query("e12_cascade_flags", "WITH " + VOLUME_COUNTS + E12_META + """ SELECT vc.vol, fic > 0 AND fic < n / 3 AS not_fiction, dra > 0 AND (non > n / 2 OR fic > n / 2 OR poe > n * 0.9) AS not_drama,
  dra + poe > n / 2 OR coalesce(list_has_any(string_split(categories, ';'), ['Poetry', 'Poems', 'Drama', 'Tragedies', 'Comedies']), FALSE) OR coalesce(regexp_matches(lower(title), '(^|\\s)(poems|ballads|poetical|comedy|tragedy|plays)(\\s|$)'), FALSE) AS mostly_drama_poetry,
  coalesce(list_has_any(string_split(categories, ';'), ['Biography', 'Autobiography']), FALSE) AS probably_biography, coalesce(list_has_any(string_split(categories, ';'), ['Fiction', 'Novel']), FALSE) AS probably_fiction FROM vc LEFT JOIN cm ON cm.vol = vc.vol""")
def e12(spark, d):
    count = lambda g: F.count_if(F.col("category") == g)
    counts = event_pages(spark, d).groupBy("vol").agg(F.count("*").alias("n"), count("signup").alias("dra"), count("error").alias("poe"), count("click").alias("fic"), count("view").alias("non"))
    categories = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'Biography;Maps' WHEN 1 THEN 'Novel' WHEN 2 THEN 'Maps;Tragedies' ELSE 'Maps' END")
    title = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'The Poetical Works' WHEN 1 THEN 'Displays' ELSE c_name END")
    metadata = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("vol"), categories.alias("categories"), title.alias("title"))
    return E.cascade_flags(counts, metadata)


@query("e13_biography_cascade", "WITH " + EVENT_PAGES + " SELECT vol, count(*) FILTER (WHERE category = 'click') AS before, count(*) FILTER (WHERE (CASE WHEN vol % 3 = 0 AND category = 'click' THEN 'purchase' ELSE category END) = 'click') AS after FROM event_pages GROUP BY vol")
def e13(spark, d):
    changed = F.when((F.col("vol") % 3 == 0) & (F.col("category") == "click"), "purchase").otherwise(F.col("category"))
    return event_pages(spark, d).groupBy("vol").agg(F.count_if(F.col("category") == "click").alias("before"), F.count_if(changed == "click").alias("after"))


@query("e14_next_best", "WITH " + PREDICTIONS + """, s AS (SELECT r.vol, r.page, max_by(r.category, (r.p, r.category)) AS second FROM probabilities r JOIN predictions c ON r.vol = c.vol AND r.page = c.page WHERE r.category <> c.category GROUP BY r.vol, r.page)
SELECT p.vol, p.page, CASE WHEN p.vol % 2 = 0 AND category = 'error' THEN second ELSE category END AS category FROM predictions p JOIN s ON s.vol = p.vol AND s.page = p.page""")
def e14(spark, d):
    pages = event_pages(spark, d).select("vol", "page", "category")
    second = S.runner_up(event_probabilities(spark, d), pages)
    return E.replace_with_next_best(pages, second, "error", pages.where("vol % 2 = 0").select("vol").distinct())


@query("e15_merged_models", "WITH " + PREDICTIONS + """, o AS (SELECT vol, page, category, p, CASE WHEN page % 4 = 0 THEN NULL WHEN idx < 2 THEN p * 1.5 ELSE p * 0.5 END AS q, idx FROM probabilities),
b AS (SELECT vol, page, max_by(category, (p, -idx)) AS main, max_by(category, (CASE WHEN q IS NULL THEN p ELSE 0.75 * p + 0.25 * q END, -idx)) AS merged FROM o GROUP BY vol, page)
SELECT vol, page, CASE WHEN main = 'view' THEN merged ELSE main END AS category FROM b""")
def e15(spark, d):
    p = event_probabilities(spark, d)
    other = p.where("page % 4 <> 0").select("vol", "page", "category", F.when(F.col("idx") < 2, F.col("p") * 1.5).otherwise(F.col("p") * 0.5).alias("p"))
    return E.merge_models(p, other, 0.75, "view")


@query("e15_specialist_cascade", "WITH " + PREDICTIONS + """, flags AS (SELECT DISTINCT vol, vol % 3 = 0 AS verse, vol % 2 = 0 AS fiction, vol % 5 = 0 AS biography FROM event_pages),
which AS (SELECT vol, CASE WHEN CAST(verse AS INT) + CAST(fiction AS INT) + CAST(biography AS INT) = 1 THEN CASE WHEN verse THEN 'verse' WHEN fiction THEN 'fiction' ELSE 'biography' END END AS which FROM flags),
said AS (SELECT 'fiction' AS which, 0.75 AS weight, vol, page, category, idx, p * (idx + 1) AS q FROM probabilities WHERE page % 4 <> 0
  UNION ALL SELECT 'verse', 0.5, vol, page, category, idx, 1 - p FROM probabilities WHERE page % 5 <> 0 AND idx < 4 UNION ALL SELECT 'verse', 0.5, vol, page, 'sonnet', 5, p FROM probabilities WHERE page % 5 <> 0 AND idx = 4),
open AS (SELECT e.vol, e.page, w.which FROM event_pages e JOIN which w ON w.vol = e.vol WHERE category = 'view' AND which IN ('verse', 'fiction')),
best AS (SELECT s.vol, s.page, max_by(s.category, (CASE WHEN p IS NULL THEN q ELSE CAST(weight AS DOUBLE) * q + (1 - CAST(weight AS DOUBLE)) * p END, -s.idx)) AS mixed
  FROM said s JOIN open o ON o.vol = s.vol AND o.page = s.page AND o.which = s.which LEFT JOIN probabilities r ON r.vol = s.vol AND r.page = s.page AND r.category = s.category GROUP BY s.vol, s.page),
alone AS (SELECT vol, page, max_by(category, (p, -idx)) AS own FROM probabilities GROUP BY vol, page)
SELECT e.vol, e.page, CASE WHEN which IN ('verse', 'fiction') AND category = 'view' THEN coalesce(mixed, own, category) WHEN which = 'biography' AND category = 'click' THEN 'purchase' ELSE category END AS category
FROM event_pages e JOIN which w ON w.vol = e.vol LEFT JOIN best b ON b.vol = e.vol AND b.page = e.page LEFT JOIN alone a ON a.vol = e.vol AND a.page = e.page""")
def e15_cascade(spark, d):
    p, pages = event_probabilities(spark, d), event_pages(spark, d).select("vol", "page", "category")
    fiction = p.where("page % 4 <> 0").withColumn("p", F.col("p") * (F.col("idx") + 1))
    verse = p.where("page % 5 <> 0 AND idx < 4").withColumn("p", 1 - F.col("p")).unionByName(p.where("page % 5 <> 0 AND idx = 4").withColumn("category", F.lit("sonnet")).withColumn("idx", F.lit(5)))
    flags = pages.select("vol").distinct().select("vol", (F.col("vol") % 3 == 0).alias("verse"), (F.col("vol") % 2 == 0).alias("fiction"), (F.col("vol") % 5 == 0).alias("biography"))
    return E.specialist_cascade(pages, p, {"fiction": (fiction, 0.75), "verse": (verse, 0.5)}, flags, "view", {"biography": ("click", "purchase")})


ACC = JUDGED + f", acc AS (SELECT vol, avg(CASE WHEN {SAME} THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg(words) AS w FROM judged GROUP BY vol)"


@query("e16_correlation", "WITH " + ACC + " SELECT round(corr(accuracy, w), 6) AS r FROM acc")
def e16(spark, d):
    pages = judged(spark, d)
    both = E.volume_accuracy(pages, CLASSES).join(E.mean_words(pages), "vol")
    return both.agg(F.round(F.corr("accuracy", "w"), 6).alias("r"))


@query("e18_without_doubtful", "WITH " + ACC + f" SELECT count(*) AS pages, round(avg(CASE WHEN {SAME} THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM judged WHERE vol NOT IN (SELECT vol FROM acc WHERE accuracy < 0.9)")
def e18(spark, d):
    pages = judged(spark, d)
    doubtful = E.volume_accuracy(pages, CLASSES).where("accuracy < 0.9")
    kept = pages.join(doubtful, "vol", "left_anti")
    return kept.agg(F.count("*").alias("pages"), F.round(F.avg(F.when(E.equivalent(F.col("truth"), F.col("pred"), CLASSES), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("e19_mean_dissent", "WITH " + PREDICTIONS + " SELECT vol, round(avg(CASE WHEN category = truth THEN 0.0::DOUBLE ELSE 0.5 END), 6) AS dissent FROM predictions GROUP BY vol")
def e19(spark, d):
    return event_predictions(spark, d).groupBy("vol").agg(F.round(F.avg(F.when(F.col("category") == F.col("truth"), 0.0).otherwise(0.5)), 6).alias("dissent"))


@query("e20_threshold_agreement", "WITH " + ACC + " SELECT count(*) FILTER (WHERE accuracy > 0.9 AND w > 50) AS both_pass, count(*) FILTER (WHERE accuracy <= 0.9 AND w <= 50) AS both_fail, count(*) FILTER (WHERE (accuracy > 0.9) <> (w > 50)) AS one FROM acc")
def e20(spark, d):
    pages = judged(spark, d)
    both = E.volume_accuracy(pages, CLASSES).join(E.mean_words(pages), "vol")
    a, w = F.col("accuracy") > 0.9, F.col("w") > 50
    return both.agg(F.count_if(a & w).alias("both_pass"), F.count_if(~a & ~w).alias("both_fail"), F.count_if(a != w).alias("one"))


@query("e22_normalised", "WITH " + PREDICTIONS + " SELECT vol, category, round(sum(p) / (SELECT sum(p) FROM probabilities b WHERE b.vol = a.vol), 6) AS share FROM probabilities a GROUP BY vol, category")
def e22(spark, d):
    by = event_probabilities(spark, d).groupBy("vol").pivot("category", list(CATEGORIES)).agg(F.sum("p"))
    total = sum(F.col(g) for g in CATEGORIES)
    return by.select("vol", F.inline(F.array(*[F.struct(F.lit(g).alias("category"), F.round(F.col(g) / total, 6).alias("share")) for g in CATEGORIES])))


# Confidence. Volumes are orders: the year of the order, tags by priority and status, a title from the key.

TAG = "CASE o_orderkey % 9 WHEN 0 THEN 'Fiction' WHEN 1 THEN 'Poetry' WHEN 2 THEN 'Drama' WHEN 3 THEN 'Essays' WHEN 4 THEN 'Novel' WHEN 5 THEN 'Letters' WHEN 6 THEN 'NotFiction' WHEN 7 THEN 'UnknownCategory' ELSE 'Humor' END"
CATEGORY = "CASE o_orderkey % 4 WHEN 0 THEN 'fic' WHEN 1 THEN 'poe' WHEN 2 THEN 'dra' ELSE 'non' END"
TITLE = "CASE o_orderkey % 6 WHEN 0 THEN 'The Plays, of Smith' WHEN 1 THEN 'Poems. By a Lady' WHEN 2 THEN 'Memoirs of Walpole' WHEN 3 THEN 'A Dictionary' WHEN 4 THEN 'Report of the Board' ELSE 'Tales' END"
AUTHOR = "CASE o_orderkey % 5 WHEN 0 THEN 'Walpole, Horace' ELSE 'Smith, J.' END"
VOLUMES = f"volumes AS (SELECT o_orderkey AS vol, {CATEGORY} AS maxcategory, [{TAG}, CASE WHEN o_orderkey % 7 = 0 THEN 'Poetry' ELSE 'Maps' END] AS tags, {TITLE} AS title, {AUTHOR} AS author, CAST(o_orderkey * 37 % 1000 AS DOUBLE) / 1000 AS score, CASE WHEN o_orderkey % 50 = 0 THEN 'x' END AS discard, CAST(year(o_orderdate) AS INTEGER) - 150 AS year, o_totalprice FROM orders)"


def volumes_of(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("vol"), F.expr(CATEGORY).alias("maxcategory"), F.array(F.expr(TAG), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'Poetry' ELSE 'Maps' END")).alias("tags"), F.expr(TITLE).alias("title"), F.expr(AUTHOR).alias("author"),
        (F.expr("CAST(o_orderkey * 37 % 1000 AS DOUBLE)") / 1000).alias("score"), F.expr("CASE WHEN o_orderkey % 50 = 0 THEN 'x' END").alias("discard"), (F.year("o_orderdate") - 150).alias("year"), "o_totalprice",
    )


NON = "list_has_any(tags, [" + ", ".join(f"'{t}'" for t in O.NONFICTION_TAGS) + "])"
has = lambda *t: "list_has_any(tags, [" + ", ".join(f"'{x}'" for x in t) + "])"
EVIDENCE = {
    "fic": (has("Fiction", "Novel", "Short stories"), has("Drama", "Poetry") + " OR " + NON), "poe": (has("Poetry") + " OR contains(lower(title), 'poems')", has("Drama", "Fiction") + " OR " + NON),
    "dra": (has("Drama") + " OR contains(lower(title), 'plays')", has("Fiction", "Poetry") + " OR " + NON), "non": (NON, has("Fiction", "Novel", "Short stories", "Poetry", "Drama")),
}


@query("o1_o2_o3_confidence_features", "WITH " + VOLUMES + " SELECT vol, " + ", ".join(f"CASE WHEN maxcategory = '{g}' AND ({e[i]}) THEN 1 ELSE 0 END AS {g}_{n}" for g, e in EVIDENCE.items() for i, n in enumerate(("confirm", "deny"))) + " FROM volumes")
def o1(spark, d):
    return O.volume_features(volumes_of(spark, d)).select("vol", *[f"{g}_{n}" for g in EVIDENCE for n in ("confirm", "deny")])


# Volumes of the events: the categories stand for fiction, poetry, drama, nonfiction and biography; metadata come from the customers.
AS_BOOKS = "CASE {0} WHEN 'click' THEN 'fic' WHEN 'error' THEN 'poe' WHEN 'purchase' THEN 'dra' WHEN 'view' THEN 'non' ELSE 'bio' END"
BOOK_TAG = "CASE c_custkey % 5 WHEN 0 THEN 'Fiction' WHEN 1 THEN 'Poetry' WHEN 2 THEN 'Drama' WHEN 3 THEN 'Biography' ELSE 'Maps' END"
BOOK_TITLE = "CASE c_custkey % 3 WHEN 0 THEN 'Poems and Plays' ELSE c_name END"
BOOKS = PREDICTIONS + f""", books AS (SELECT vol, page, {AS_BOOKS.format("category")} AS raw, {AS_BOOKS.format("truth")} AS smooth FROM predictions),
known AS (SELECT c_custkey AS vol, [{BOOK_TAG}, 'Maps'] AS tags, {BOOK_TITLE} AS title FROM customer WHERE c_custkey % 7 <> 0),
counted AS MATERIALIZED (SELECT vol, smooth AS category, count(*) AS own FROM books GROUP BY ALL), largest AS (SELECT vol, max_by(category, (own, category)) AS maxcategory, max(own) AS most, CAST(sum(own) AS BIGINT) AS pages FROM counted GROUP BY vol),
lagged AS (SELECT *, lag(raw) OVER w AS raw_before, lag(smooth) OVER w AS smooth_before FROM books WINDOW w AS (PARTITION BY vol ORDER BY page)),
changes AS (SELECT vol, count(*) FILTER (WHERE raw IS DISTINCT FROM raw_before) AS rawflips, count(*) FILTER (WHERE smooth IS DISTINCT FROM smooth_before) AS smoothflips FROM lagged GROUP BY vol),
steps AS (SELECT vol, page, idx, p, p - coalesce(max(p) OVER (PARTITION BY vol, page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM probabilities),
certain AS (SELECT vol, avg(maxprob) AS maxprob, avg(gap) AS gap FROM (SELECT vol, page, max(p) AS maxprob, max_by(step, idx) AS gap FROM steps WHERE step > 0 GROUP BY vol, page) x GROUP BY vol),
seqs AS MATERIALIZED (SELECT l.vol, maxcategory, pages, most / pages AS maxratio, rawflips / pages AS rawflipratio, smoothflips, gap, maxprob, tags, title FROM largest l JOIN changes USING (vol) LEFT JOIN certain USING (vol) LEFT JOIN known USING (vol))"""


def books_of(spark, d):
    p = event_predictions(spark, d).select("vol", "page", F.expr(AS_BOOKS.format("category")).alias("raw"), F.expr(AS_BOOKS.format("truth")).alias("smooth"))
    known = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("vol"), F.array(F.expr(BOOK_TAG), F.lit("Maps")).alias("tags"), F.expr(BOOK_TITLE).alias("title"))
    return p, known, O.sequence_features(p, S.max_and_gap(event_probabilities(spark, d)))


ROUNDED = ("maxratio", "rawflipratio", "gap", "maxprob", "proportion")


@query("o1_overall_features", "WITH " + BOOKS + " SELECT vol, " + ", ".join(f"CASE WHEN maxcategory = '{g}' AND coalesce({e[i]}, FALSE) THEN 1 ELSE 0 END AS {g}_{n}" for g, e in EVIDENCE.items() for i, n in enumerate(("confirm", "deny"))) + ", round(maxratio, 6) AS maxratio, round(rawflipratio, 6) AS rawflipratio, smoothflips, round(gap, 6) AS gap, round(maxprob, 6) AS maxprob FROM seqs")
def o1_overall(spark, d):
    _, known, sequence = books_of(spark, d)
    f = O.overall_features(known, sequence)
    return f.select(*[F.round(c, 6).alias(c) if c in ROUNDED else c for c in f.columns])


@query("o2_category_features", "WITH " + BOOKS + " SELECT s.vol, g.category, coalesce(own, 0) AS pages, " + ", ".join(f"CASE WHEN coalesce(CASE g.category " + " ".join(f"WHEN '{g}' THEN {EVIDENCE[g][i]}" for g in ("fic", "poe", "dra")) + f" END, FALSE) THEN 1 ELSE 0 END AS {n}" for i, n in enumerate(("confirm", "deny"))) + """, round(coalesce(own, 0) / s.pages, 6) AS proportion,
  round(rawflipratio, 6) AS rawflipratio, smoothflips, round(gap, 6) AS gap, round(maxprob, 6) AS maxprob, round(maxratio, 6) AS maxratio FROM seqs s, (VALUES ('fic'), ('poe'), ('dra')) g(category) LEFT JOIN counted c ON c.vol || c.category = s.vol || g.category""")
def o2_category(spark, d):
    p, known, sequence = books_of(spark, d)
    f = O.category_features(known, sequence, p)
    return f.select(*[F.round(c, 6).alias(c) if c in ROUNDED else c for c in f.columns])


@query("o4_binarised", "WITH " + VOLUMES + " SELECT maxcategory, count(*) FILTER (WHERE score > 0.95) AS overall, count(*) FILTER (WHERE score > 0.8) AS category FROM volumes GROUP BY maxcategory")
def o4(spark, d):
    return volumes_of(spark, d).groupBy("maxcategory").agg(F.count_if(F.col("score") > 0.95).alias("overall"), F.count_if(F.col("score") > 0.8).alias("category"))


@query("o5_o6_periods", "WITH " + VOLUMES + """, b AS (SELECT CASE WHEN year BETWEEN 1700 AND 1799 THEN '18c' WHEN year BETWEEN 1800 AND 1899 THEN '19c' WHEN year BETWEEN 1900 AND 1922 THEN '20c' END AS century, CASE WHEN year < 1700 THEN 'uncertain' WHEN year <= 1799 THEN '1700-99' WHEN year <= 1849 THEN '1800-49' WHEN year <= 1874 THEN '1850-74' WHEN year <= 1899 THEN '1875-99' WHEN year <= 1922 THEN '1900-22' END AS period FROM volumes)
SELECT century, period, count(*) AS n FROM b GROUP BY ALL""")
def o5(spark, d):
    return volumes_of(spark, d).groupBy(O.century(F.col("year")).alias("century"), O.period(F.col("year")).alias("period")).agg(F.count("*").alias("n"))


@query("o9_unpacked_scores", "WITH " + VOLUMES + " SELECT v.vol, coalesce(s.score, 0) AS score FROM volumes v LEFT JOIN (SELECT vol, score FROM volumes WHERE vol % 3 = 0) s ON s.vol = v.vol")
def o9(spark, d):
    v = volumes_of(spark, d)
    return v.select("vol").join(v.where("vol % 3 = 0").select("vol", "score"), "vol", "left").select("vol", F.coalesce("score", F.lit(0.0)).alias("score"))


CURVE = VOLUMES + ", scored AS (SELECT score, vol % 13 AS correct, vol % 13 + vol % 3 AS total, maxcategory FROM volumes), curve AS (SELECT CAST(t AS INTEGER) AS idx, (SELECT sum(correct) FROM scored WHERE score > t / 100.0::DOUBLE + 1e-11) AS c, (SELECT sum(total) FROM scored WHERE score > t / 100.0::DOUBLE + 1e-11) AS t, (SELECT sum(total) FROM scored) AS every FROM range(100) r(t))"


def scored_of(spark, d):
    return volumes_of(spark, d).select("vol", "score", (F.col("vol") % 13).alias("correct"), (F.col("vol") % 13 + F.col("vol") % 3).alias("total"), "maxcategory")


@query("o10_overall_curve", "WITH " + CURVE + " SELECT idx, round(c / t, 6) AS precision, round(coalesce(c, 0) / every, 6) AS recall FROM curve")
def o10(spark, d):
    return O.overall_curve(scored_of(spark, d)).select("idx", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("o11_category_curve", "WITH " + CURVE.replace("FROM volumes), curve", "FROM volumes WHERE maxcategory = 'fic'), curve") + " SELECT idx, round(c / t, 6) AS precision, round(coalesce(c, 0) / every, 6) AS recall FROM curve")
def o11(spark, d):
    return O.overall_curve(scored_of(spark, d).where("maxcategory = 'fic'")).select("idx", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("o12_filled_forward", "WITH " + EVENT_PAGES + ", g AS (SELECT vol, page, CASE WHEN event_id % 3 = 0 THEN words END AS x FROM event_pages) SELECT vol, page AS idx, last_value(x IGNORE NULLS) OVER (PARTITION BY vol ORDER BY page) AS x FROM g")
def o12(spark, d):
    g = event_pages(spark, d).select("vol", F.col("page").alias("idx"), F.when(F.col("event_id") % 3 == 0, F.col("words")).alias("x"))
    return O.fill_forward(g, "x", "vol")


@query("o14_calibrated", "WITH " + CURVE + " SELECT v.vol, v.idx, round(c / t, 6) AS precision FROM (SELECT vol, greatest(0, least(99, CAST(floor(score * 100.0::DOUBLE) AS INTEGER))) AS idx FROM volumes) v JOIN curve k ON k.idx = v.idx")
def o14(spark, d):
    s = scored_of(spark, d)
    return O.calibrate(s.select("vol", "score"), O.overall_curve(s)).select("vol", "idx", F.round("precision", 6).alias("precision"))


@query("o16_tag_list", "WITH " + VOLUMES + " SELECT vol, array_to_string(list_sort(list_distinct([lower(t) FOR t IN tags IF t NOT IN ('NotFiction', 'UnknownCategory', 'ContainsBiogMaterial')])), ';') AS tags FROM volumes")
def o16(spark, d):
    return volumes_of(spark, d).select("vol", O.tag_list(F.col("tags")).alias("tags"))


@query("o17_collection_cut", "WITH " + VOLUMES + " SELECT vol, category FROM volumes, (VALUES ('fic', 0.95), ('dra', 0.95), ('poe', 0.939)) g(category, least) WHERE maxcategory = category AND score >= least")
def o17(spark, d):
    cut = F.col("score") >= F.when(F.col("maxcategory") == "poe", 0.939).otherwise(0.95)
    return volumes_of(spark, d).where(F.col("maxcategory").isin("fic", "dra", "poe") & cut).select("vol", F.col("maxcategory").alias("category"))


def _filter_sql(g):
    bad = " OR ".join(f"contains(t, '{w}')" for w in O.FORBIDDEN[g])
    if g == "fic":
        bad += r" OR ((contains(t, 'memoirs') OR contains(t, 'autobiography')) AND list_has_any([x FOR x IN string_split_regex(replace(lower(author), ',', ''), '\s+') IF length(x) > 4], string_split_regex(t, '\s+')) AND NOT list_contains(string_split_regex(t, '\s+'), 'novels'))"
    return f"SELECT vol, '{g}' AS category FROM (SELECT *, translate(lower(title), ',.', '  ') AS t FROM volumes) x WHERE score >= {O.THRESHOLDS[g]} AND discard IS DISTINCT FROM 'x' AND NOT ({bad})"


FILTERED = VOLUMES + ", filtered AS (" + " UNION ALL ".join(_filter_sql(g) for g in O.THRESHOLDS) + ")"


@query("o18_title_filter", "WITH " + FILTERED + " SELECT * FROM filtered")
def o18(spark, d):
    v = volumes_of(spark, d)
    parts = [O.title_filter(v, g).select("vol", F.lit(g).alias("category")) for g in O.THRESHOLDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ORDER = ["dra", "fic", "poe"]
CANDIDATE = {"dra": "vol % 3 = 0", "fic": "vol % 3 <> 1", "poe": "vol % 2 = 0"}  # who was in each collection before it was filtered


@query("o19_ringers", "WITH " + FILTERED + ", cand AS (" + " UNION ALL ".join(f"SELECT vol, {i} AS place, '{g}' AS category FROM volumes WHERE score >= {O.THRESHOLDS[g]} AND {CANDIDATE[g]}" for i, g in enumerate(ORDER)) + """),
taken AS (SELECT f.vol FROM filtered f JOIN volumes v ON v.vol = f.vol WHERE v.maxcategory = f.category)
SELECT c.vol, max_by(c.category, c.place) AS category, min_by(c.category, c.place) AS since, any_value(v.title) AS title, any_value(v.author) AS author, any_value(v.year) AS year
FROM cand c JOIN volumes v ON v.vol = c.vol WHERE c.vol NOT IN (SELECT vol FROM taken) GROUP BY c.vol""")
def o19(spark, d):
    v = volumes_of(spark, d)
    parts = lambda f: reduce(DataFrame.unionByName, [f(g).select("vol", F.lit(g).alias("category")) for g in ORDER])
    candidates = parts(lambda g: v.where((F.col("score") >= O.THRESHOLDS[g]) & F.expr(CANDIDATE[g])))
    return O.ringers(candidates, parts(lambda g: O.title_filter(v.where(F.col("maxcategory") == g), g)), ORDER, v.select("vol", "title", "author", "year"))


@query("o20_weighted_draws", """WITH w AS (SELECT l_returnflag AS stratum, l_partkey AS vol, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY ALL),
draws AS (SELECT DISTINCT l_returnflag AS stratum, l_linenumber AS draw, CAST('0x' || substr(md5(l_returnflag || l_linenumber), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM lineitem),
v AS (SELECT *, sum(weight) OVER (PARTITION BY stratum ORDER BY vol) AS top, sum(weight) OVER (PARTITION BY stratum) AS every FROM w)
SELECT d.stratum, draw, vol, CAST(floor(u * every) - (top - weight) AS BIGINT) AS ordinal FROM draws d JOIN v ON v.stratum = d.stratum AND floor(u * every) >= top - weight AND floor(u * every) < top""")
def o20(spark, d):
    lines = table(spark, d, "lineitem")
    volumes = lines.groupBy(F.col("l_returnflag").alias("stratum"), F.col("l_partkey").alias("vol")).agg(F.sum("l_quantity").cast("long").alias("weight"))
    u = F.conv(F.substring(F.md5(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))), 1, 7), 16, 10).cast("double") / 268435456.0
    draws = lines.select(F.col("l_returnflag").alias("stratum"), F.col("l_linenumber").alias("draw"), u.alias("u")).distinct()
    return O.weighted_draws(volumes, draws)


DRAWN = EVENT_PAGES + """, own AS (SELECT vol % 3 AS stratum, vol, page, row_number() OVER (PARTITION BY vol ORDER BY page) - 1 AS ordinal FROM event_pages WHERE category = 'click'),
w AS (SELECT stratum, vol, count(*) AS weight FROM own GROUP BY ALL), v AS (SELECT *, sum(weight) OVER (PARTITION BY stratum ORDER BY vol) AS top, sum(weight) OVER (PARTITION BY stratum) AS every FROM w),
draws AS (SELECT user_id % 3 AS stratum, event_id AS draw, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM events WHERE event_id % 20 = 0),
d AS (SELECT d.stratum, draw, vol, CAST(floor(u * every) - (top - weight) AS BIGINT) AS ordinal FROM draws d JOIN v ON v.stratum = d.stratum AND floor(u * every) >= top - weight AND floor(u * every) < top)"""


@query("o20_drawn_pages", "WITH " + DRAWN + " SELECT d.stratum, draw, d.vol, d.ordinal, page FROM d LEFT JOIN own ON own.vol = d.vol AND own.ordinal = d.ordinal")
def o20_pages(spark, d):
    pages = event_pages(spark, d).where("category = 'click'").select("vol", "page")
    volumes = pages.groupBy((F.col("vol") % 3).alias("stratum"), "vol").agg(F.count("*").alias("weight"))
    u = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 7), 16, 10).cast("double") / 268435456.0
    draws = table(spark, d, "events").where("event_id % 20 = 0").select((F.col("user_id") % 3).alias("stratum"), F.col("event_id").alias("draw"), u.alias("u"))
    return O.drawn_pages(O.weighted_draws(volumes, draws), pages).select("stratum", "draw", "vol", "ordinal", "page")


@query("o21_yearly_share", """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*) AS share FROM orders GROUP BY 1)
SELECT year, round(share, 6) AS share, round(sum(share) OVER w / nullif(count(share) OVER w - 1, 0), 6) AS smoothed FROM y WINDOW w AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def o21(spark, d):
    pages = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("hits"), F.lit(1).alias("total"))
    return O.yearly_share(pages).select("year", F.round("share", 6).alias("share"), F.round("smoothed", 6).alias("smoothed"))


@query("o22_size_audit", "WITH " + EVENT_PAGES + ", n AS (SELECT vol, count(*) AS pages FROM event_pages GROUP BY vol) SELECT CAST(row_number() OVER (ORDER BY pages DESC, vol) AS INTEGER) AS rank, vol, pages FROM n")
def o22(spark, d):
    return O.size_audit(event_pages(spark, d))


# Metadata

FIELD = "rpad(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6) || substr('stqrc', 1 + o_orderkey % 5, 1) || CASE o_orderkey % 4 WHEN 0 THEN '18uu' WHEN 1 THEN '189u' ELSE CAST(year(o_orderdate) AS VARCHAR) END || CASE WHEN o_orderkey % 3 = 0 THEN '9999' ELSE CAST(year(o_orderdate) - o_orderkey % 40 AS VARCHAR) END || 'enk' || substr(md5(o_orderpriority || o_orderkey), 1, 20), 40, '#')"


def fields_of(spark, d):
    sql = FIELD.replace("CAST(o_orderkey AS VARCHAR)", "CAST(o_orderkey AS STRING)").replace("AS VARCHAR", "AS STRING")
    return table(spark, d, "orders").select("o_orderkey", F.expr(sql).alias("field"))


at = lambda i, n=1: f"substr(field, {i + 1}, {n})"
cases = lambda t, key: f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.items())


@query("b2_fixed_fields", f"WITH f AS (SELECT o_orderkey, {FIELD} AS field FROM orders) SELECT o_orderkey, {at(6)} AS datetype, {at(7, 4)} AS date1, {at(11, 4)} AS date2, {at(15, 3)} AS place, array_to_string(list_sort([t FOR t IN [CASE WHEN {at(22)} IN ('b', 'c', 'd', 'j') THEN 'Juvenile audience' END, "
       + ", ".join(f"CASE WHEN contains({at(24, 4)}, '{k}') THEN '{t}' END" for k, t in C.CONTENT_TAGS.items()) + f", {cases(C.FORM_TAGS, at(33))} ELSE 'UnknownCategory' END, {cases(C.BIOGRAPHY_TAGS, at(34))} END] IF t IS NOT NULL]), ';') AS tags FROM f")
def b2(spark, d):
    return fields_of(spark, d).select("o_orderkey", C.fixed_field(F.col("field")).alias("f")).select("o_orderkey", "f.datetype", "f.date1", "f.date2", "f.place", F.array_join("f.tags", ";").alias("tags"))


LEADER = "substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) || substr('acdbims', 1 + o_orderkey % 7, 1) || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 16)"


@query("b3_material_types", f"WITH f AS (SELECT {LEADER} AS l FROM orders), k AS (SELECT substr(l, 8, 1) AS a, substr(l, 20, 1) AS b FROM f) SELECT CASE WHEN a IN ('a', 'c', 'd') THEN 'monograph part(s)' WHEN a = 'b' THEN 'serial part' WHEN a = 'i' THEN 'serial integration' WHEN a = 'm' AND b = 'a' THEN 'monograph set' WHEN a = 'm' AND b IN ('b', 'c') THEN 'monograph part' WHEN a = 'm' THEN 'monograph' WHEN a = 's' THEN 'serial' ELSE '<blank>' END AS kind, count(*) AS n FROM k GROUP BY 1")
def b3(spark, d):
    leader = F.expr(LEADER.replace("VARCHAR", "STRING"))
    return table(spark, d, "orders").groupBy(C.material_type(leader).alias("kind")).agg(F.count("*").alias("n"))


@query("b8_inferred_years", f"""WITH f AS (SELECT o_orderkey, {FIELD} AS field FROM orders), p AS (SELECT o_orderkey, {at(6)} AS dt, {at(7, 4)} AS a, {at(11, 4)} AS b, CASE WHEN o_orderkey % 11 = 0 THEN '<estimate="18--?">' ELSE '' END AS t FROM f),
y AS (SELECT *, CASE WHEN regexp_matches(a, '^\\d+$') THEN CAST(a AS INTEGER) WHEN ends_with(a, 'uu') THEN 0 WHEN regexp_matches(a, '^\\d{{3}}u$') THEN CAST(substr(a, 1, 3) AS INTEGER) * 10 ELSE 0 END AS y1, CASE WHEN regexp_matches(b, '^\\d+$') THEN CAST(b AS INTEGER) ELSE 0 END AS y2 FROM p),
z AS (SELECT *, CASE WHEN y2 - y1 > 25 THEN 0 ELSE y1 END AS y3 FROM y)
SELECT o_orderkey, CASE WHEN contains(t, '--') AND contains(t, 'estimate') THEN 0 WHEN dt = 't' AND y2 > 0 AND y2 < y3 THEN y2 ELSE y3 END AS year FROM z""")
def b8(spark, d):
    f = fields_of(spark, d).select("o_orderkey", C.fixed_field(F.col("field")).alias("f"), F.when(F.col("o_orderkey") % 11 == 0, '<estimate="18--?">').otherwise("").alias("t"))
    return f.select("o_orderkey", C.inferred_year(F.col("f.datetype"), F.col("f.date1"), F.col("f.date2"), F.col("t")).alias("year"))


@query("b9_tag_frequency", "WITH " + VOLUMES + ", t AS (SELECT unnest(tags) AS tag FROM volumes) SELECT tag, count(*) AS n FROM t GROUP BY tag HAVING count(*) >= 3")
def b9(spark, d):
    return C.tag_frequency(volumes_of(spark, d))


# Alignment and assembly: works are conversations, volumes their roles, pages their turns.


@query("a1_alignment", "WITH " + EVENT_PAGES + """, g AS (SELECT vol, count(*) AS n FROM event_pages WHERE vol % 5 <> 0 AND NOT (vol % 7 = 0 AND page = 0) GROUP BY vol), p AS (SELECT vol, count(*) AS n FROM event_pages GROUP BY vol), w AS (SELECT DISTINCT c_custkey AS vol FROM customer)
SELECT w.vol, CASE WHEN p.n IS NULL THEN 'missing data' WHEN g.n IS NULL THEN 'category prediction not found' WHEN p.n <> g.n THEN 'mismatched lengths' ELSE 'success' END AS status FROM w LEFT JOIN p ON p.vol = w.vol LEFT JOIN g ON g.vol = w.vol""")
def a1(spark, d):
    pages = event_pages(spark, d).select("vol", "page")
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("vol")).distinct()
    return C.align(wanted, pages, pages.where("vol % 5 <> 0 AND NOT (vol % 7 = 0 AND page = 0)"))


@query("a5_failed_volumes", "WITH " + EVENT_PAGES + " SELECT c_custkey AS vol, 'missing data' AS status FROM (SELECT DISTINCT c_custkey FROM customer) c WHERE c_custkey NOT IN (SELECT vol FROM event_pages)")
def a5(spark, d):
    pages = event_pages(spark, d).select("vol", "page")
    return C.align(table(spark, d, "customer").select(F.col("c_custkey").alias("vol")).distinct(), pages, pages).where("status <> 'success'")


@query("a2_category_filter", "WITH " + EVENT_PAGES + " SELECT vol, count(*) AS n FROM event_pages WHERE category IN ('click', 'view') GROUP BY vol")
def a2(spark, d):
    return event_pages(spark, d).where(F.col("category").isin("click", "view")).groupBy("vol").agg(F.count("*").alias("n"))


WORKS = EVENT_PAGES + ", works AS (SELECT DISTINCT vol // 3 AS work, vol % 3 AS seq, vol FROM event_pages), asm AS (SELECT work, seq, page, row_number() OVER (PARTITION BY work ORDER BY seq, page) - 1 AS pos, count(*) OVER (PARTITION BY work) AS pages FROM works JOIN event_pages USING (vol))"


def works_of(spark, d):
    pages = event_pages(spark, d).select("vol", "page")
    return C.assemble(pages.select(F.expr("vol div 3").alias("work"), (F.col("vol") % 3).alias("seq"), "vol").distinct(), pages)


@query("a3_assembled_works", "WITH " + WORKS + " SELECT work, CAST(pos AS INTEGER) AS pos, seq, page FROM asm")
def a3(spark, d):
    return works_of(spark, d).select("work", "pos", "seq", "page")


@query("a4_chunks", "WITH " + WORKS + ", c AS (SELECT work, pos, ntile(10) OVER (PARTITION BY work ORDER BY pos) AS chunk FROM asm WHERE pages > 20) SELECT work, CAST(chunk AS INTEGER) AS chunk, count(*) AS n, CAST(min(pos) AS INTEGER) AS first FROM c GROUP BY ALL")
def a4(spark, d):
    return C.chunks(works_of(spark, d)).groupBy("work", "chunk").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


# Sources and training sets


@query("s6_pagination_check", "WITH " + VOL_PAGES + ", p AS (SELECT vol, page, lag(page) OVER (PARTITION BY vol ORDER BY page) AS before FROM vol_pages) SELECT vol, count(*) AS pages, count(*) FILTER (WHERE page <> before + 1) AS gaps FROM p GROUP BY vol")
def s6(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("vol").orderBy("page")
    return volume_pages(spark, d).withColumn("before", F.lag("page").over(w)).groupBy("vol").agg(F.count("*").alias("pages"), F.count_if(F.col("page") != F.col("before") + 1).alias("gaps"))


@query("s14_without_bad_ids", "WITH " + VOL_PAGES + " SELECT vol, count(*) AS n FROM vol_pages WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY vol")
def s14(spark, d):
    return volume_pages(spark, d).join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti").groupBy("vol").agg(F.count("*").alias("n"))


@query("s16_vocabulary", "WITH " + LINES + ", w AS (SELECT unnest(string_split(lower(text), ' ')) AS word FROM lines), c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word) SELECT word FROM (SELECT word FROM c ORDER BY n DESC, encode(word) LIMIT 1000) x UNION ALL SELECT 'wordNotInVocab'")
def s16(spark, d):
    words = volume_lines(spark, d).select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    best = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(1000).select("word")
    return best.unionByName(spark.createDataFrame([("wordNotInVocab",)], "word string"))


@query("s19_matched_volumes", "WITH " + VOL_PAGES + " SELECT DISTINCT vol FROM vol_pages JOIN labels USING (doc_id)")
def s19(spark, d):
    return volume_pages(spark, d).join(table(spark, d, "labels"), "doc_id", "left_semi").select("vol").distinct()


@query("m7_undersampled", "WITH " + VOL_PAGES + """, x AS (SELECT doc_id, lang = 'en' AS pos FROM vol_pages), n AS (SELECT count(*) FILTER (WHERE NOT pos) AS p, count(*) FILTER (WHERE pos) AS q FROM x), r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY pos ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM x)
SELECT doc_id FROM r, n WHERE NOT pos OR k <= ceil(ln(1.73 + q / p) * p)""")
def m7(spark, d):
    from leafmill.operators.models import undersample

    docs = volume_pages(spark, d).select("doc_id", (F.col("lang") != "en").alias("positive"))
    return undersample(docs, "positive", "doc_id").select("doc_id")


@query("m8_folds", "WITH v AS (SELECT DISTINCT user_id AS vol FROM events) SELECT vol, (row_number() OVER (ORDER BY vol) - 1) % 5 AS fold FROM v")
def m8(spark, d):
    from leafmill.operators.models import folds

    return folds(event_pages(spark, d)).select("vol", F.col("fold").cast("long").alias("fold"))
