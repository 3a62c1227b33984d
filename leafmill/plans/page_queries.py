"""Queries on page vectors and page sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import lines as L
from leafmill.operators import sequence as S
from leafmill.operators import vectors as V
from leafmill.plans.registry import EVENT_PAGES, PREDICTIONS, TOKENS, VOL_PAGES, WORD_COUNTS, query
from leafmill.plans.text_queries import ACC, CASE, LEXICON, P, PERSONAL, STRIP, rules_of_lexicon
from leafmill.sources.staged import written
from leafmill.sources.tables import CATEGORIES, event_pages, event_predictions, event_probabilities, table, volume_lines, volume_pages

STRUCTURE = r""", st AS (SELECT vol, page, count(*) AS lines, count(*) FILTER (WHERE length(s) > 1) AS textlines, count(*) FILTER (WHERE regexp_matches(s, '^\p{Lu}')) AS caplines,
  sum(length(s) - length(replace(s, ',', ''))) AS commas, sum(length(s) - length(replace(s, '!', ''))) AS exclamationpoints, sum(length(s) - length(replace(s, '?', ''))) AS questionmarks,
  count(*) FILTER (WHERE regexp_matches(s, '""" + P + r"""$') AND NOT ends_with(s, '-')) AS endwpunct, count(*) FILTER (WHERE regexp_matches(s, '\p{Nd}.?$')) AS endwnumeral FROM acc GROUP BY vol, page),
caps AS (SELECT vol, page, count(*) FILTER (WHERE """ + CASE + r""" = 'upper') AS allcapswords FROM tokens WHERE regexp_matches(token, '[\p{L}\p{Nd}]') GROUP BY vol, page),
letters AS (SELECT vol, page, ascii(lower(substr(s, 1, 1))) AS a, count(*) AS n FROM acc WHERE regexp_matches(lower(substr(s, 1, 1)), '^[a-z]$') GROUP BY ALL),
ini AS (SELECT c.vol, c.page, max(c.n) AS maxinitial, max(c.n + coalesce(b.n, 0)) AS maxpair FROM letters c LEFT JOIN letters b ON b.vol = c.vol AND b.page = c.page AND b.a = c.a - 1 GROUP BY c.vol, c.page),
first AS (SELECT vol, page, split_part(s, ' ', 1) AS token FROM acc WHERE s <> ''),
named AS (SELECT vol, page, token, lower(""" + STRIP + r""") AS word FROM first WHERE regexp_matches(token, '^\p{Lu}')),
stn AS (SELECT vol, page, count(*) FILTER (WHERE word NOT IN (SELECT word FROM lexicon) OR word IN (SELECT word FROM personal) OR word IN ('sir', 'mr', 'm', 'miss', 'mrs', 'lord', 'lady', 'prince', 'king', 'queen')) AS startwname,
  count(*) FILTER (WHERE ends_with(token, '.')) AS startwrubric FROM named GROUP BY vol, page),
capital AS (SELECT vol, page, line, encode(substr(s, 1, 1)) AS cap FROM acc WHERE regexp_matches(s, '^\p{Lu}')),
stay AS (SELECT *, cap >= coalesce(lag(cap) OVER (PARTITION BY vol, page ORDER BY line), encode('|')) AS stays FROM capital),
caprun AS (SELECT *, sum(CASE WHEN stays THEN 0 ELSE 1 END) OVER (PARTITION BY vol, page ORDER BY line) AS run FROM stay),
runlen AS (SELECT vol, page, run, count(*) FILTER (WHERE stays) AS n FROM caprun GROUP BY ALL),
seqcap AS (SELECT vol, page, max(n) AS sequentialcaps FROM runlen GROUP BY vol, page),
features AS (SELECT vol, page, word AS feature, n AS count FROM word_counts""" + "".join(
    f" UNION ALL SELECT vol, page, '#{c}', CAST({c} AS BIGINT) FROM {t}"
    for t, cs in {"st": ["lines", "textlines", "caplines", "commas", "exclamationpoints", "questionmarks", "endwpunct", "endwnumeral"], "caps": ["allcapswords"], "ini": ["maxinitial", "maxpair"], "stn": ["startwname", "startwrubric"], "seqcap": ["sequentialcaps"]}.items()
    for c in cs
) + ")"
FEATURES = WORD_COUNTS + LEXICON[len(TOKENS) :] + PERSONAL + ", acc AS" + ACC.split(", acc AS", 1)[1] + STRUCTURE
TOTALS = FEATURES + """, totals AS (SELECT vol, count(DISTINCT page) AS pages, max(page) AS max_page, CAST(coalesce(sum(CASE WHEN NOT starts_with(feature, '#') THEN count END), 0) AS BIGINT) AS words,
  coalesce(sum(CASE WHEN feature = '#textlines' THEN count END), 0) AS lines FROM features GROUP BY vol),
vt AS (SELECT vol, pages, max_page, words, CASE WHEN lines = 0 THEN 1.0::DOUBLE ELSE lines / pages END AS mean_lines, CASE WHEN words = 0 THEN 1.0::DOUBLE ELSE words / pages END AS mean_words FROM totals)"""
VOCAB = ", vocab AS (SELECT feature AS word FROM features WHERE NOT starts_with(feature, '#') GROUP BY feature HAVING sum(count) >= 50)"


ALLCAPS = "#allcapswords"


def page_words_of(spark, d):
    """``vol, page, word, n`` of the documents, written once, with a row ``#allcapswords`` for each page; and the sums of ``word, n``, written too."""
    pages = volume_pages(spark, d).select("vol", "page", "text")
    whole = L.whole_pages(pages, L.page_keys(pages))
    words = written(L.counted_words(whole, caps_as=ALLCAPS), "page-words")  # the only pass over tokens
    return words, written(words.where(F.col("word") != ALLCAPS).groupBy("word").agg(F.sum("n").alias("n")), "word-sums")


def structure_of(spark, d, sums):
    """What the lines of pages say, in the form of page features."""
    lexicon, personal, _ = rules_of_lexicon(L.lexicon_of_counts(sums, 20))
    return V.line_features(volume_lines(spark, d), lexicon, personal)


def features_of(spark, d):
    """The page features of the documents in long form, written once for all that read them."""
    words, sums = page_words_of(spark, d)
    return written(V.word_features(words).unionByName(structure_of(spark, d, sums)), "page-features")


def word_features_of(spark, d):
    """Words of the pages, volume by volume: texts are shuffled, and neither counts nor what is summed by page or volume after that."""
    lines = volume_lines(spark, d).repartition("vol")
    return L.word_counts(L.tokens(lines)).select("vol", "page", F.col("word").alias("feature"), F.col("n").alias("count"))


def word_and_line_features_of(spark, d):
    """Words and numbers of text lines: what totals and vocabularies need of the page features."""
    lines = L.structure_counts(volume_lines(spark, d)).select("vol", "page", F.lit("#textlines").alias("feature"), F.col("textlines").alias("count"))
    return word_features_of(spark, d).unionByName(lines)


def vocabulary_of(features):
    return features.where("NOT startswith(feature, '#')").groupBy(F.col("feature").alias("word")).agg(F.sum("count").alias("n")).where("n >= 50").select("word")


@query("k1_v2_folded_features", "WITH " + FEATURES + VOCAB + " SELECT vol, page, CASE WHEN feature IN (SELECT word FROM vocab) OR starts_with(feature, '#') THEN feature ELSE 'wordNotInVocab' END AS feature, CAST(sum(count) AS BIGINT) AS count FROM features GROUP BY ALL")
def v2(spark, d):
    words, sums = page_words_of(spark, d)
    return V.fold_page_words(words, structure_of(spark, d, sums), written(vocabulary_of(sums.withColumnsRenamed({"word": "feature", "n": "count"})), "vocabulary"))


@query("v3_volume_totals", "WITH " + TOTALS + " SELECT * FROM vt")
def v3(spark, d):
    return V.volume_totals(word_and_line_features_of(spark, d))


V4_RELATIVE_FREQUENCIES_SQL = (
    "WITH " + WORD_COUNTS + " SELECT vol, word, round(sum(share), 6) AS share FROM (SELECT vol, page, word, n / (0.0001::DOUBLE + sum(n) OVER (PARTITION BY vol, page)) AS share FROM word_counts) x GROUP BY vol, word".replace("SELECT vol, page, word, n / ", "SELECT vol, page, word, n AS n_, n / ")
)


@query("v4_relative_frequencies", V4_RELATIVE_FREQUENCIES_SQL)
@query("v4_relative_frequencies_all", V4_RELATIVE_FREQUENCIES_SQL)
def v4_all(spark, d):
    shares = V.relative_frequencies(word_features_of(spark, d))
    return shares.groupBy("vol", F.col("feature").alias("word")).agg(F.round(F.sum("share"), 6).alias("share"), F.sum("count").alias("n")).drop("n")


COUNTED = ("allcapswords", "maxinitial", "maxpair", "commas", "exclamationpoints", "questionmarks", "endwpunct", "endwnumeral", "startwname", "startwrubric", "sequentialcaps")
V6_SQL = (
    "WITH " + TOTALS + r""", pg AS (SELECT vol, page, 0.0001::DOUBLE + coalesce(sum(CASE WHEN NOT starts_with(feature, '#') THEN count END), 0) AS W,
  sum(CASE WHEN NOT starts_with(feature, '#') THEN 1 ELSE 0 END) AS types, coalesce(max(CASE WHEN feature = '#textlines' THEN count END)::DOUBLE, 0.0001) AS T0, coalesce(max(CASE WHEN feature = '#lines' THEN count END)::DOUBLE, 0.0001) AS L,
  coalesce(max(CASE WHEN feature = '#caplines' THEN count END)::DOUBLE, 0.0001) AS C, """ + ", ".join(f"coalesce(max(CASE WHEN feature = '#{c}' THEN count END)::DOUBLE, 0) AS {c}" for c in COUNTED) + r"""
  FROM features GROUP BY vol, page), p2 AS (SELECT *, CASE WHEN T0 < 0.1 THEN 0.001 ELSE T0 END AS T, (types + 1) / (W + 1.5) AS tt FROM pg)
SELECT p.vol, page, CASE WHEN max_page = 0 THEN NULL ELSE page / max_page END AS pos_in_vol, round(T / mean_lines, 4) AS line_length_ratio, round(C / T, 4) AS cap_ratio, round(W / mean_words, 4) AS word_ratio,
  CASE WHEN max_page = 0 THEN NULL ELSE abs(page - max_page // 2) / max_page END AS distance_from_mid, round(allcapswords / W, 4) AS all_cap_ratio, round((maxinitial + 0.2) / (T + 0.5), 4) AS max_initial_ratio, round((maxpair + 0.1) / (T + 0.5), 4) AS max_pair_ratio,
  round(W / T, 3) AS words_per_line, round(W, 4) AS total_words, round(tt, 4) AS type_token, round(commas / W, 4) AS commas_norm, round(T / L, 4) AS textlines_per_line, round(tt * tt, 4) AS type_token_squared,
  round(exclamationpoints / W, 4) AS exclamations_norm, round(questionmarks / W, 4) AS questions_norm, round((endwpunct + 0.1) / (T + 0.3), 4) AS end_with_punct, round((endwnumeral + 0.01) / (T + 0.2), 4) AS end_with_num,
  round(startwname / T, 4) AS start_with_name, round(startwrubric / T, 4) AS start_with_rubric, round(sequentialcaps, 4) AS cap_sequence, round((sequentialcaps + 0.2) / (C + 2), 4) AS cap_seq_norm,
  round(tt * ln(W + 50), 4) AS log_type_token, round(abs(W - mean_words) / mean_words, 4) AS abs_word_ratio,
  CASE WHEN hash_ = '0' THEN 1 ELSE 0 END AS meta_biography, CASE WHEN hash_ IN ('1', '2') THEN 1 ELSE 0 END AS meta_fiction FROM (SELECT *, substr(md5(vol), 1, 1) AS hash_ FROM p2) p JOIN vt USING (vol)"""
)


def tags_of(volumes):
    """Catalogue tags of volumes, picked by a digest of their names; most have none."""
    pick = F.substring(F.md5("vol"), 1, 1)
    return volumes.select("vol", F.when(pick == "0", "Biography;Letters").when(pick == "1", "Fiction").when(pick == "2", "Maps;Novel").alias("categories")).where("categories IS NOT NULL")


@query("v5_v6_structural_features", V6_SQL)
def v6(spark, d):
    features = features_of(spark, d)
    volumes = features.select("vol").distinct()
    f = V.structural_features(features, V.tag_evidence(volumes, tags_of(volumes)))
    exact = ("vol", "page", "pos_in_vol", "distance_from_mid", "meta_biography", "meta_fiction")
    return f.select(*[c if c in exact else F.round(c, 3 if c == "words_per_line" else 4).alias(c) for c in f.columns])


LONG = EVENT_PAGES + ", long AS (SELECT vol, page, category AS feature, words AS x FROM event_pages)"


def long_of(spark, d):
    return event_pages(spark, d).select("vol", "page", F.col("category").alias("feature"), F.col("words").alias("x"))


@query("v7_zscore_fit", "WITH " + LONG + " SELECT feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM long GROUP BY feature")
def v7(spark, d):
    s = V.zscore_fit(long_of(spark, d))
    return s.select("feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("v8_zscore_apply", "WITH " + LONG + ", s AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY feature) SELECT vol, page, l.feature, round(CASE WHEN sd > 0 AND x IS NOT NULL THEN (x - m) / sd ELSE 0 END, 5) AS z FROM long l JOIN s USING (feature)")
def v8(spark, d):
    long = long_of(spark, d)
    return V.zscore_apply(long, V.zscore_fit(long)).select("vol", "page", "feature", V.rounded(F.col("z"), 5).alias("z"))


V10_VOLUME_VECTORS_SQL = (
    "WITH " + WORD_COUNTS + " SELECT vol, word, CAST(sum(n) AS BIGINT) AS n FROM word_counts GROUP BY vol, word"
)


@query("v10_volume_vectors", V10_VOLUME_VECTORS_SQL)
@query("v10_volume_vectors_all", V10_VOLUME_VECTORS_SQL)
def v10_all(spark, d):
    return L.word_counts(L.tokens(volume_lines(spark, d))).groupBy("vol", "word").agg(F.sum("n").alias("n"))


@query("v11_magnitudes", "SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 5) AS magnitude FROM embeddings")
def v11(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.magnitude(F.col("embedding")), 5).alias("magnitude"))


CODES = list(V.CONVERSIONS)


@query("v12_folded_categories", "WITH c AS (SELECT page_id, CASE page_id % 24 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END AS code FROM pages) SELECT page_id, CASE code " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.CONVERSIONS.items()) + " ELSE code END AS category FROM c")
def v12(spark, d):
    codes = F.array(*[F.lit(c) for c in CODES])
    return V.fold_categories(table(spark, d, "pages").select("page_id", F.get(codes, (F.col("page_id") % 24).cast("int")).alias("category")))


@query("v13_pages_with_labels", "WITH " + VOL_PAGES + " SELECT vol, count(*) AS pages, count(quality) AS labelled, CAST(sum(quality) AS BIGINT) AS good FROM vol_pages LEFT JOIN labels USING (doc_id) GROUP BY vol")
def v13(spark, d):
    return volume_pages(spark, d).join(table(spark, d, "labels"), "doc_id", "left").groupBy("vol").agg(F.count("*").alias("pages"), F.count("quality").alias("labelled"), F.sum("quality").alias("good"))


@query("v14_selected_vocabulary", "WITH " + FEATURES + """, last AS (SELECT vol, max(page) AS last FROM features GROUP BY vol),
own AS (SELECT lang, feature AS word, CAST(sum(least(count, 3)) AS BIGINT) AS n FROM features JOIN last USING (vol) JOIN vol_pages USING (vol, page) WHERE page < last AND NOT starts_with(feature, '#') GROUP BY lang, feature),
best AS (SELECT word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(word) DESC) AS r FROM own) x WHERE r <= 500),
chosen AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM best GROUP BY word ORDER BY n DESC, encode(word) DESC LIMIT 2000)
SELECT word, n FROM chosen UNION ALL SELECT word, 0 FROM (SELECT unnest([""" + ", ".join(f"'{w}'" for w in V.FORCED_WORDS) + "]) AS word) f WHERE word NOT IN (SELECT word FROM chosen)")
def v14(spark, d):
    return V.select_page_vocabulary(volume_pages(spark, d).select("vol", "page", F.col("lang").alias("category"), "text"))


@query("v15_category_order", "WITH " + EVENT_PAGES + " SELECT CAST(row_number() OVER (ORDER BY min(event_id), category) + 1 AS INTEGER) AS idx, category FROM event_pages GROUP BY category UNION ALL SELECT 0, 'begin' UNION ALL SELECT 1, 'end'")
def v15(spark, d):
    return V.category_order(event_pages(spark, d), "event_id")


# Sequences


@query("q1_transition_counts", "WITH " + EVENT_PAGES + " SELECT prev, next, count(*) AS n FROM (SELECT coalesce(lag(category) OVER (PARTITION BY vol ORDER BY page), 'begin') AS prev, category AS next FROM event_pages UNION ALL SELECT max_by(category, page), 'end' FROM event_pages GROUP BY vol) x GROUP BY prev, next")
def q1(spark, d):
    return S.transition_counts(event_pages(spark, d))


@query("q2_transition_probabilities", "WITH " + EVENT_PAGES + """, c AS (SELECT prev, next, count(*) AS n FROM (SELECT coalesce(lag(category) OVER (PARTITION BY vol ORDER BY page), 'begin') AS prev, category AS next FROM event_pages UNION ALL SELECT max_by(category, page), 'end' FROM event_pages GROUP BY vol) x GROUP BY prev, next),
g AS (SELECT DISTINCT category FROM event_pages UNION ALL SELECT 'begin' UNION ALL SELECT 'end'), u AS (SELECT next, sum(n) AS u FROM c GROUP BY next),
r AS (SELECT a.category AS prev, b.category AS next, CASE WHEN b.category = 'begin' THEN 0.0::DOUBLE ELSE coalesce(n, 0) + 0.0001::DOUBLE * coalesce(u, 0) + 2 END AS raw FROM g a CROSS JOIN g b LEFT JOIN c ON c.prev = a.category AND c.next = b.category LEFT JOIN u ON u.next = b.category)
SELECT prev, next, round(raw / sum(raw) OVER (PARTITION BY prev), 6) AS p FROM r""")
def q2(spark, d):
    return S.transition_probabilities(event_pages(spark, d)).select("prev", "next", F.round("p", 6).alias("p"))


TRANSITIONS = [[0.6 if i == j else 0.1 for j in range(5)] for i in range(5)]
BEGIN, END = [0.2] * 5, [0.1, 0.2, 0.3, 0.2, 0.1]


def smoothed_of(spark, d, times=1):
    pages = event_predictions(spark, d).select("vol", "page", "words", F.array(*[F.col(f"p_{g}") for g in CATEGORIES]).alias("probs"))
    for _ in range(times):
        out = S.smooth(pages, TRANSITIONS, BEGIN, END)
        pages = out.withColumnRenamed("smoothed", "probs")
    return out


def _vec(name, f):
    return ", ".join(f"{f(i)} AS {name}{i}" for i in range(5))


def _step(prev, soft, back):
    cells = [" + ".join(f"{TRANSITIONS[i][j] if not back else TRANSITIONS[j][i]}::DOUBLE * {prev}{i}" for i in range(5)) for j in range(5)]
    raw = [f"({c}) * {soft}{j}" for j, c in enumerate(cells)]
    return [f"({r}) / ({' + '.join(raw)})" for r in raw]


def _smoothing(given, out):
    """SQL of one smoothing of ``given(vol, page, words, p_..)`` into ``out`` with the same columns."""
    e = [f"p_{g}" for g in CATEGORIES]
    begin = [f"{BEGIN[i]}::DOUBLE * e{i}" for i in range(5)]
    end = [f"{END[i]}::DOUBLE * e{i}" for i in range(5)]
    norm = lambda xs: [f"({x}) / ({' + '.join(xs)})" for x in xs]
    f, b = _step(f"fw_{out}.f", f"soft_{out}.s", False), _step(f"bw_{out}.b", f"soft_{out}.s", True)
    return f""", sized_{out} AS (SELECT *, count(*) OVER (PARTITION BY vol) AS n FROM {given}),
soft_{out} AS MATERIALIZED (SELECT vol, page, n, words, {_vec("e", lambda i: e[i])}, {_vec("s", lambda i: f"{e[i]} + CASE WHEN words > 5 OR page < n // 10 OR page > n - n // 8 THEN 0 ELSE 0.25::DOUBLE END")} FROM sized_{out}),
fw_{out} AS (SELECT vol, page, {_vec("f", lambda i: norm(begin)[i])} FROM soft_{out} WHERE page = 0
  UNION ALL SELECT soft_{out}.vol, soft_{out}.page, {_vec("f", lambda i: f[i])} FROM fw_{out} JOIN soft_{out} ON soft_{out}.vol = fw_{out}.vol AND soft_{out}.page = fw_{out}.page + 1),
bw_{out} AS (SELECT vol, page, {_vec("b", lambda i: norm(end)[i])} FROM soft_{out} WHERE page = n - 1
  UNION ALL SELECT soft_{out}.vol, soft_{out}.page, {_vec("b", lambda i: b[i])} FROM bw_{out} JOIN soft_{out} ON soft_{out}.vol = bw_{out}.vol AND soft_{out}.page = bw_{out}.page - 1),
prod_{out} AS (SELECT s.vol, s.page, s.words, {_vec("r", lambda i: f"CASE WHEN s.page = s.n - 1 THEN b{i} * b{i} ELSE f{i} * b{i} END")} FROM soft_{out} s JOIN fw_{out} f ON f.vol = s.vol AND f.page = s.page JOIN bw_{out} b ON b.vol = s.vol AND b.page = s.page),
{out} AS MATERIALIZED (SELECT vol, page, words, {", ".join(f"r{i} / (r0 + r1 + r2 + r3 + r4) AS p_{g}" for i, g in enumerate(CATEGORIES))} FROM prod_{out})"""


SMOOTHED_COLUMNS = "SELECT vol, page, " + ", ".join(f"round(p_{g}, 6) AS {g}" for g in CATEGORIES)


@query("q3_smoothing", "WITH RECURSIVE " + PREDICTIONS + _smoothing("predictions", "once") + SMOOTHED_COLUMNS + " FROM once")
def q3(spark, d):
    return smoothed_of(spark, d).select("vol", "page", *[F.round(F.get("smoothed", F.lit(i)), 6).alias(g) for i, g in enumerate(CATEGORIES)])


@query("q4_double_smoothing", "WITH RECURSIVE " + PREDICTIONS + _smoothing("predictions", "once") + _smoothing("once", "twice") + SMOOTHED_COLUMNS + " FROM twice")
def q4(spark, d):
    return smoothed_of(spark, d, 2).select("vol", "page", *[F.round(F.get("smoothed", F.lit(i)), 6).alias(g) for i, g in enumerate(CATEGORIES)])


@query("q5_best_category", "WITH " + PREDICTIONS + " SELECT vol, page, max_by(category, (p, -idx)) AS category, max(p) AS p FROM probabilities GROUP BY vol, page")
def q5(spark, d):
    return S.best_category(event_probabilities(spark, d))


@query("q6_max_and_gap", "WITH " + PREDICTIONS + """, s AS (SELECT vol, page, idx, p, p - coalesce(max(p) OVER (PARTITION BY vol, page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM probabilities),
m AS (SELECT vol, page, max(p) AS maxprob, max_by(step, idx) AS gap FROM s WHERE step > 0 GROUP BY vol, page) SELECT vol, round(avg(maxprob), 6) AS maxprob, round(avg(gap), 6) AS gap FROM m GROUP BY vol""")
def q6(spark, d):
    return S.max_and_gap(event_probabilities(spark, d)).select("vol", F.round("maxprob", 6).alias("maxprob"), F.round("gap", 6).alias("gap"))


LAGGED = EVENT_PAGES + ", g AS (SELECT *, lag(category) OVER (PARTITION BY vol ORDER BY page) AS before FROM event_pages)"
RUNS = LAGGED + ", n AS (SELECT *, sum(CASE WHEN category = before THEN 0 ELSE 1 END) OVER (PARTITION BY vol ORDER BY page) AS run FROM g), runs AS (SELECT vol, CAST(run AS BIGINT) AS run, category, min(page) AS start, count(*) AS length FROM n GROUP BY vol, run, category)"


@query("q7_flips", "WITH " + LAGGED + " SELECT vol, count(*) FILTER (WHERE category IS DISTINCT FROM before) AS flips FROM g GROUP BY vol")
def q7(spark, d):
    return S.flips(event_pages(spark, d))


@query("q8_transitions_between", "WITH " + LAGGED + " SELECT vol, count(*) FILTER (WHERE before IN ('click') AND category IN ('view', 'signup')) AS n FROM g GROUP BY vol")
def q8(spark, d):
    return S.transitions_between(event_pages(spark, d), ["click"], ["view", "signup"])


@query("q9_runs", "WITH " + RUNS + " SELECT * FROM runs")
def q9(spark, d):
    return S.runs(event_pages(spark, d))


@query("q10_coalesced_runs", "WITH " + RUNS + """, w AS (SELECT *, lag(category) OVER o AS bg, lag(length) OVER o AS bl, lead(category) OVER o AS ag, lead(length) OVER o AS al FROM runs WINDOW o AS (PARTITION BY vol ORDER BY run)),
c AS (SELECT vol, start, length, CASE WHEN length <= 2 AND bg = ag AND least(bl, al) > length THEN bg ELSE category END AS category FROM w)
SELECT vol, CAST(start + i AS INTEGER) AS page, category FROM c, unnest(range(0, length)) AS u(i)""")
def q10(spark, d):
    return S.coalesce_runs(event_pages(spark, d))


@query("q11_largest_category", "WITH " + EVENT_PAGES + ", c AS (SELECT vol, category, count(*) AS n FROM event_pages GROUP BY vol, category) SELECT vol, max_by(category, (n, category)) AS maxcategory, max(n) AS n FROM c GROUP BY vol")
def q11(spark, d):
    return S.largest_category(event_pages(spark, d))


FOLD, SPINE = {"signup": "view", "error": "purchase"}, ["click", "drama", "purchase", "view"]


@query("q11_folded_counts", "WITH " + EVENT_PAGES + ", f AS (SELECT vol, CASE category " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FOLD.items()) + f""" ELSE category END AS category FROM event_pages),
c AS (SELECT vol, category, sum(n) AS n FROM (SELECT vol, category, 1 AS n FROM f UNION ALL SELECT DISTINCT vol, g, 0 FROM f, (SELECT unnest({SPINE}) AS g) s) x GROUP BY vol, category)
SELECT vol, category, CAST(n AS BIGINT) AS n, max_by(category, (n, category)) OVER (PARTITION BY vol) AS maxcategory FROM c""")
def q11_folded(spark, d):
    return S.folded_counts(event_pages(spark, d), FOLD, SPINE)


MODELS = PREDICTIONS + ", models AS (SELECT 'a' AS model, vol, page, category, p FROM probabilities UNION ALL SELECT 'b', vol, page, category, CASE WHEN idx % 2 = 0 THEN p * 3 ELSE p END FROM probabilities)"


def models_of(spark, d):
    p = event_probabilities(spark, d)
    return p.select(F.lit("a").alias("model"), "vol", "page", "category", "p").unionByName(p.select(F.lit("b").alias("model"), "vol", "page", "category", F.when(F.col("idx") % 2 == 0, F.col("p") * 3).otherwise(F.col("p")).alias("p")))


MEANS = MODELS + ", nm AS (SELECT vol, page, category, p / sum(p) OVER (PARTITION BY model, vol, page) AS p FROM models), tot AS (SELECT vol, page, category, sum(p) AS p FROM nm GROUP BY ALL), means AS (SELECT vol, page, category, p / sum(p) OVER (PARTITION BY vol, page) AS p FROM tot)"


@query("q12_mean_probabilities", "WITH " + MEANS + " SELECT vol, page, category, round(p, 6) AS p FROM means")
def q12(spark, d):
    return S.mean_probabilities(models_of(spark, d)).select("vol", "page", "category", F.round("p", 6).alias("p"))


VOTES = MEANS + """, votes AS (SELECT vol, page, category FROM predictions UNION ALL SELECT vol, page, truth FROM predictions UNION ALL SELECT vol, page, max_by(category, (p, -idx)) FROM probabilities GROUP BY vol, page
  UNION ALL SELECT vol, page, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE category END FROM predictions),
cnt AS (SELECT vol, page, category, count(*) AS votes FROM votes GROUP BY ALL), fav AS (SELECT vol, page, max_by(category, (round(p, 9), category)) AS favourite FROM means GROUP BY vol, page),
rk AS (SELECT c.*, row_number() OVER (PARTITION BY c.vol, c.page ORDER BY votes DESC, CASE WHEN category = favourite THEN 1 ELSE 0 END DESC, category) AS rank, sum(votes) OVER (PARTITION BY c.vol, c.page) AS every FROM cnt c JOIN fav f ON c.vol = f.vol AND c.page = f.page)"""


@query("q13_q14_consensus", "WITH " + VOTES + " SELECT vol, page, category, (every - votes) / every AS dissent FROM rk WHERE rank = 1")
def q13(spark, d):
    p = event_predictions(spark, d)
    votes = p.select("vol", "page", "category").unionByName(p.select("vol", "page", F.col("truth").alias("category"))).unionByName(S.best_category(event_probabilities(spark, d)).select("vol", "page", "category"))
    votes = votes.unionByName(p.select("vol", "page", F.when(F.col("event_id") % 3 == 0, "view").otherwise(F.col("category")).alias("category")))
    return S.consensus(votes, S.mean_probabilities(models_of(spark, d)).withColumn("p", F.round("p", 9)))


@query("q15_runner_up", "WITH " + PREDICTIONS + " SELECT r.vol, r.page, max_by(r.category, (r.p, r.category)) AS second FROM probabilities r JOIN predictions c ON r.vol = c.vol AND r.page = c.page WHERE r.category <> c.category GROUP BY r.vol, r.page")
def q15(spark, d):
    return S.runner_up(event_probabilities(spark, d), event_pages(spark, d))
