"""Queries on identifiers, lines and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import ids, words
from leafmill.operators import lines as L
from leafmill.plans.registry import ACC, ACCEPTED, LEXICON, LINES, P, PLAIN, STRIP, TOKENS, VOL_PAGES, WORD_COUNTS, query, token_list_sql
from leafmill.sources.staged import written
from leafmill.sources.tables import table, volume_lines, volume_pages

PERSONAL = ", personal AS (SELECT word FROM lexicon WHERE substr(md5(word), 1, 1) = '0'), places AS (SELECT word FROM lexicon WHERE substr(md5(word), 1, 1) = '1')"


def tokens_of(spark, d):
    return L.tokens(volume_lines(spark, d))


def rules_of(tokens):
    """Rule tables picked from the words of the documents: lexicon, personal names, place names. The words are counted once."""
    return rules_of_lexicon(L.lexicon_of(tokens, 20))


def rules_of_lexicon(lexicon):
    lexicon = written(lexicon, "lexicon")
    pick = lambda x: lexicon.where(F.substring(F.md5("word"), 1, 1) == x).select("word")
    return lexicon, pick("0"), pick("1")


HEAD, TAIL = "split_part(url, '.', 1)", "substr(url, length(split_part(url, '.', 1)) + 2)"


def id_query(name, f, sql):
    @query(name, f"SELECT page_id, {sql} AS id FROM pages")
    def run(spark, d):
        return table(spark, d, "pages").select("page_id", f(F.col("url")).alias("id"))

    return run


W_URL = "replace(url, 'http://', 'w.')"
id_query(
    "i1_clean_id",
    lambda x: ids.clean_id(F.replace(x, F.lit("http://"), F.lit("w."))),
    f"CASE WHEN contains({W_URL}, '.') AND contains(substr({W_URL}, length(split_part({W_URL}, '.', 1)) + 2), ':') THEN split_part({W_URL}, '.', 1) || '.' || translate(substr({W_URL}, length(split_part({W_URL}, '.', 1)) + 2), ':/', '+=') ELSE {W_URL} END",
)
id_query("i2_dirty_id", ids.dirty_id, f"CASE WHEN contains(url, '.') AND contains({TAIL}, '=') THEN {HEAD} || '.' || translate({TAIL}, '+=', ':/') ELSE url END")
id_query("i3_file_id", ids.file_id, "translate(url, ':/', '+=')")
id_query("i3_label_id", ids.label_id, "translate(url, '+=', ':/')")
id_query("i4_pairtree_path", ids.pairtree_path, f"{HEAD} || '/pairtree_root/' || regexp_replace(translate({TAIL}, ':/.', '+=,'), '(.{{1,2}})', '\\1/', 'g') || translate({TAIL}, ':/.', '+=,')")


@query("i5_id_variants", f"SELECT DISTINCT page_id, unnest([url, replace(url, ',', '.'), CASE WHEN contains(url, '.') AND contains({TAIL}, '=') THEN {HEAD} || '.' || translate({TAIL}, '+=', ':/') ELSE url END]) AS id FROM pages")
def i5(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(ids.variants(F.col("url"))).alias("id"))


@query("s2_paged_text", "WITH " + LINES + " SELECT vol, page, count(*) AS lines, sum(length(text)) AS chars FROM lines GROUP BY vol, page")
def s2(spark, d):
    return volume_lines(spark, d).groupBy("vol", "page").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("l1_accepted_lines", "WITH " + ACC + " SELECT vol, page, count(*) AS n FROM acc GROUP BY vol, page")
def l1(spark, d):
    return L.accepted_lines(volume_lines(spark, d)).groupBy("vol", "page").agg(F.count("*").alias("n"))


@query(
    "l2_l4_l8_structure",
    "WITH " + ACC + r"""
SELECT vol, page, count(*) AS lines, count(*) FILTER (WHERE length(s) > 1) AS textlines, count(*) FILTER (WHERE regexp_matches(s, '^\p{Lu}')) AS caplines,
  CAST(sum(length(s) - length(replace(s, ',', ''))) AS BIGINT) AS commas, CAST(sum(length(s) - length(replace(s, '.', ''))) AS BIGINT) AS periods,
  CAST(sum(length(s) - length(regexp_replace(s, '["“”]', '', 'g'))) AS BIGINT) AS quotations,
  CAST(sum(length(s) - length(replace(s, '!', ''))) AS BIGINT) AS exclamationpoints, CAST(sum(length(s) - length(replace(s, '?', ''))) AS BIGINT) AS questionmarks,
  count(*) FILTER (WHERE regexp_matches(s, '""" + P + r"""$') AND NOT ends_with(s, '-')) AS endwpunct, count(*) FILTER (WHERE regexp_matches(s, '\p{Nd}.?$')) AS endwnumeral,
  CAST(floor(100 * coalesce(stddev_pop(CASE WHEN length(s) > 0 THEN length(s) END), 0) + 1e-9) AS BIGINT) AS stdev
FROM acc GROUP BY vol, page""",
)
def l2(spark, d):
    return L.structure_counts(volume_lines(spark, d))


@query(
    "l5_line_starts",
    "WITH " + LEXICON + PERSONAL + r""", first AS (
  SELECT vol, page, split_part(trim(text, ' '), ' ', 1) AS token FROM lines WHERE trim(text, ' ') <> '' AND """ + ACCEPTED + r"""
), f AS (SELECT vol, page, token, lower(""" + STRIP + r""") AS word FROM first WHERE regexp_matches(token, '^\p{Lu}'))
SELECT vol, page, count(*) FILTER (WHERE word NOT IN (SELECT word FROM lexicon) OR word IN (SELECT word FROM personal)
    OR word IN ('sir', 'mr', 'm', 'miss', 'mrs', 'lord', 'lady', 'prince', 'king', 'queen')) AS startwname,
  count(*) FILTER (WHERE ends_with(token, '.')) AS startwrubric FROM f GROUP BY vol, page""",
)
def l5(spark, d):
    lines = volume_lines(spark, d)
    lexicon, personal, _ = rules_of(L.tokens(lines))
    return L.line_starts(lines, lexicon, personal)


@query(
    "l6_initials",
    "WITH " + ACC + """, c AS (SELECT vol, page, ascii(lower(substr(s, 1, 1))) AS a, count(*) AS n FROM acc WHERE regexp_matches(lower(substr(s, 1, 1)), '^[a-z]$') GROUP BY ALL)
SELECT c.vol, c.page, max(c.n) AS maxinitial, max(c.n + coalesce(b.n, 0)) AS maxpair FROM c LEFT JOIN c b ON b.vol = c.vol AND b.page = c.page AND b.a = c.a - 1 GROUP BY c.vol, c.page""",
)
def l6(spark, d):
    return L.initials(volume_lines(spark, d))


@query(
    "l7_capital_runs",
    "WITH " + ACC + r""", caps AS (SELECT vol, page, line, encode(substr(s, 1, 1)) AS cap FROM acc WHERE regexp_matches(s, '^\p{Lu}')),
b AS (SELECT *, cap >= coalesce(lag(cap) OVER (PARTITION BY vol, page ORDER BY line), encode('|')) AS stays FROM caps),
r AS (SELECT *, sum(CASE WHEN stays THEN 0 ELSE 1 END) OVER (PARTITION BY vol, page ORDER BY line) AS run FROM b),
n AS (SELECT vol, page, run, count(*) FILTER (WHERE stays) AS n FROM r GROUP BY ALL)
SELECT vol, page, max(n) AS sequentialcaps FROM n GROUP BY vol, page""",
)
def l7(spark, d):
    return L.capital_runs(volume_lines(spark, d))


@query("l9_tokens", "WITH " + TOKENS + " SELECT vol, page, count(*) AS n, sum(length(token)) AS chars, count(DISTINCT token) AS types FROM tokens GROUP BY vol, page")
def l9(spark, d):
    return tokens_of(spark, d).groupBy("vol", "page").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("chars"), F.count_distinct("token").alias("types"))


L10_STRIP_PUNCTUATION_SQL = (
    "WITH " + TOKENS + f", s AS (SELECT token, {STRIP} AS stripped FROM tokens) SELECT token, stripped, count(*) AS n FROM s WHERE token <> stripped GROUP BY ALL"
)


@query("l10_strip_punctuation", L10_STRIP_PUNCTUATION_SQL)
@query("l10_strip_punctuation_all", L10_STRIP_PUNCTUATION_SQL)
def l10_all(spark, d):
    t = tokens_of(spark, d).select("token", words.stripped(F.col("token")).alias("stripped")).where("token <> stripped")
    return t.groupBy("token", "stripped").agg(F.count("*").alias("n"))


CASE = r"""CASE WHEN regexp_matches(token, '\p{Ll}') AND NOT regexp_matches(token, '[\p{Lu}\p{Lt}]') THEN 'lower'
  WHEN regexp_matches(replace(token, '''', ''), '\p{Lu}') AND NOT regexp_matches(replace(token, '''', ''), '[\p{Ll}\p{Lt}]') THEN 'upper'
  WHEN regexp_matches(replace(token, '''', ''), '\p{Lu}') AND NOT regexp_matches(replace(token, '''', ''), '\p{L}\p{Lu}') AND NOT regexp_matches(replace(token, '''', ''), '(^|\P{L})\p{Ll}') THEN 'title'
  ELSE 'heterogenous' END"""


@query("l11_case", "WITH " + TOKENS + f" SELECT vol, {CASE} AS kind, count(*) AS n FROM tokens GROUP BY ALL")
def l11(spark, d):
    return tokens_of(spark, d).groupBy("vol", words.case_of(F.col("token")).alias("kind")).agg(F.count("*").alias("n"))


DIGITS = r"(length(token) - length(regexp_replace(token, '\p{Nd}', '', 'g')))"
NUMBER = rf"CASE WHEN length(token) > 0 AND {DIGITS} * 10 >= length(token) * 4 THEN CASE WHEN regexp_matches(token, '[$£¢]') OR ends_with(token, 's') OR ends_with(token, 'd') THEN 'arabicprice' WHEN {DIGITS} < 5 THEN 'arabic' || greatest({DIGITS}, 1) || 'digit' ELSE 'arabic5+digit' END END"


@query("l12_l13_numbers", "WITH " + TOKENS + f" SELECT vol, {NUMBER} AS kind, {DIGITS} > 0.35 * length(token) AS numeric, count(*) AS n FROM tokens GROUP BY ALL")
def l12(spark, d):
    return tokens_of(spark, d).groupBy("vol", words.number_class(F.col("token")).alias("kind"), words.mostly_numeric(F.col("token")).alias("numeric")).agg(F.count("*").alias("n"))


@query("l15_lexicon_membership", "WITH " + LEXICON + " SELECT vol, page, count(*) AS n, count(*) FILTER (WHERE word IN (SELECT word FROM lexicon)) AS known FROM plain GROUP BY vol, page")
def l15(spark, d):
    t = tokens_of(spark, d)
    return L.known_of(t, written(L.lexicon_of(t, 20), "lexicon")).groupBy("vol", "page").agg(F.count("*").alias("n"), F.count("known").alias("known"))


@query("l16_without_alphanumerics", "WITH " + TOKENS + r" SELECT vol, page, count(*) AS n FROM tokens WHERE NOT regexp_matches(token, '[\p{L}\p{Nd}]') GROUP BY vol, page")
def l16(spark, d):
    return tokens_of(spark, d).where(words.no_alphanumeric(F.col("token"))).groupBy("vol", "page").agg(F.count("*").alias("n"))


L17_POSSESSIVES_SQL = (
    "WITH " + TOKENS + r" SELECT CASE WHEN length(token) > 2 THEN regexp_replace(token, '''[sS]$', '') ELSE token END AS word, count(*) AS n FROM tokens GROUP BY 1"
)


@query("l17_possessives", L17_POSSESSIVES_SQL)
@query("l17_possessives_all", L17_POSSESSIVES_SQL)
def l17_all(spark, d):
    return tokens_of(spark, d).groupBy(words.without_possessive(F.col("token")).alias("word")).agg(F.count("*").alias("n"))


ROMAN_ONES = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
ROMAN_TENS = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
ROMAN_HUNDREDS = ["", "c", "cc", "ccc", "cd"]
FORMS = LEXICON + PERSONAL + rf""", cased AS (SELECT vol, page, token, {CASE} AS kind FROM tokens WHERE regexp_matches(token, '[\p{{L}}\p{{Nd}}]')),
c2 AS (SELECT vol, page, kind, CASE WHEN kind = 'heterogenous' THEN token ELSE lower(token) END AS token FROM cased),
c3 AS (SELECT vol, page, kind, {STRIP} AS token FROM c2),
c4 AS (SELECT vol, page, kind, CASE WHEN length(token) > 2 THEN regexp_replace(token, '''[sS]$', '') ELSE token END AS token FROM c3),
roman AS (SELECT h || t || o AS word FROM (SELECT unnest({ROMAN_HUNDREDS}) AS h) a, (SELECT unnest({ROMAN_TENS}) AS t) b, (SELECT unnest({ROMAN_ONES}) AS o) c WHERE h || t || o NOT IN ('', 'i')),
forms AS (SELECT vol, page, CASE WHEN lower(token) IN (SELECT word FROM roman) THEN 'romannumeral'
  WHEN {NUMBER} IS NOT NULL THEN {NUMBER}
  WHEN kind IN ('title', 'upper') AND lower(token) IN (SELECT word FROM personal) THEN 'personalname'
  WHEN kind IN ('title', 'upper') AND lower(token) IN (SELECT word FROM places) THEN 'placename'
  WHEN kind = 'title' AND length(lower(token)) > 4 AND lower(token) NOT IN (SELECT word FROM lexicon) THEN 'propernoun'
  ELSE lower(token) END AS form FROM c4)"""


L14_L19_L21_FORMS_SQL = (
    "WITH " + FORMS + " SELECT vol, form, count(*) AS n FROM forms GROUP BY ALL"
)


@query("l14_l19_l21_forms", L14_L19_L21_FORMS_SQL)
@query("l14_l19_l21_forms_all", L14_L19_L21_FORMS_SQL)
def l19_all(spark, d):
    counts = written(tokens_of(spark, d).groupBy("vol", "token").agg(F.count("*").alias("n")), "volume-tokens")
    rules = rules_of_lexicon(L.lexicon_of_counts(counts.select(F.lower("token").alias("word"), "n"), 20))
    return L.normal_form(counts, *rules).groupBy("vol", "form").agg(F.sum("n").alias("n"))


@query("l20_allcaps_words", "WITH " + TOKENS + f" SELECT vol, page, count(*) FILTER (WHERE {CASE} = 'upper') AS allcaps FROM tokens GROUP BY vol, page")
def l20(spark, d):
    return tokens_of(spark, d).groupBy("vol", "page").agg(F.count_if(words.case_of(F.col("token")) == "upper").alias("allcaps"))


L21_WORD_COUNTS_SQL = (
    "WITH " + WORD_COUNTS + " SELECT vol, page, word, n FROM word_counts"
)


@query("l21_word_counts", L21_WORD_COUNTS_SQL)
@query("l21_word_counts_all", L21_WORD_COUNTS_SQL)
def l21_all(spark, d):
    return L.word_counts(tokens_of(spark, d))


@query(
    "l22_l26_match_rates",
    "WITH " + LEXICON + rf""", f AS (SELECT *, word || lead(word) OVER (PARTITION BY vol ORDER BY page, line, pos) AS fused FROM plain)
SELECT vol, count(*) AS tokens, avg(CASE WHEN word IN (SELECT word FROM lexicon) OR coalesce(fused IN (SELECT word FROM lexicon), FALSE) THEN 1.0::DOUBLE ELSE 0.0 END) AS matched
FROM f WHERE NOT ({DIGITS} > 0.35 * length(token)) AND regexp_matches(token, '[\p{{L}}\p{{Nd}}]') GROUP BY vol""",
)
def l22(spark, d):
    lines = volume_lines(spark, d)
    return L.match_rates(L.tokens(lines), written(L.lexicon_of_lines(lines, 20), "lexicon"))


@query("l27_flags", "WITH " + LEXICON + ", m AS (SELECT vol, count(*) AS n, avg(CASE WHEN word IN (SELECT word FROM lexicon) THEN 1.0::DOUBLE ELSE 0.0 END) AS rate FROM plain GROUP BY vol) SELECT vol, CASE WHEN n < 10 THEN 'short' WHEN rate < 0.6 THEN 'not english' ELSE 'good' END AS status FROM m")
def l27(spark, d):
    t = tokens_of(spark, d)
    m = L.known_of(t, written(L.lexicon_of(t, 20), "lexicon")).groupBy("vol").agg(F.count("*").alias("n"), F.avg(F.when(F.col("known").isNull(), 0.0).otherwise(1.0)).alias("rate"))
    return m.select("vol", F.when(F.col("n") < 10, "short").when(F.col("rate") < 0.6, "not english").otherwise("good").alias("status"))


HEADED = "CASE WHEN i = 1 AND page % 4 < 3 THEN 'Journal of ' || vol || ' part ' || page ELSE l[i] END AS text"  # a running title on three of four pages


def headed_lines(spark, d):
    title = F.concat(F.lit("Journal of "), "vol", F.lit(" part "), F.col("page").cast("string"))
    return volume_lines(spark, d).withColumn("text", F.when((F.col("line") == 0) & (F.col("page") % 4 < 3), title).otherwise(F.col("text")))


HEADERS = ACC.replace("l[i] AS text", HEADED) + r""", k AS (SELECT vol, page, line, lower(trim(regexp_replace(regexp_replace(s, '\p{Nd}', '', 'g'), 'iii|ii|xx', '', 'g'), ' ')) AS key FROM acc WHERE line < 5),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vol, page ORDER BY line) AS rank FROM k WHERE length(key) >= 5) x WHERE rank <= 2),
seqs AS (SELECT vol, page, row_number() OVER (PARTITION BY vol ORDER BY page) - 1 AS seq FROM vol_pages),
heads AS (SELECT h.*, seq FROM h JOIN seqs USING (vol, page) WHERE vol IN (SELECT vol FROM h GROUP BY vol HAVING count(DISTINCT page) >= 5)),
hp AS (SELECT a.vol, a.page, a.line, b.page AS page_b, b.line AS line_b FROM heads a JOIN heads b ON a.vol = b.vol AND b.seq BETWEEN a.seq - 2 AND a.seq - 1 AND a.seq >= 2
  WHERE least(length(a.key), length(b.key)) > 0.8 * greatest(length(a.key), length(b.key)) AND 1 - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key)) > 0.8),
headers AS (SELECT vol, page, line FROM hp UNION SELECT vol, page_b, line_b FROM hp)"""


L28_RUNNING_HEADERS_SQL = (
    "WITH " + HEADERS + " SELECT vol, page, line FROM headers"
)


@query("l28_running_headers", L28_RUNNING_HEADERS_SQL)
@query("l28_running_headers_all", L28_RUNNING_HEADERS_SQL)
def l28_all(spark, d):
    return L.running_headers(headed_lines(spark, d))


@query("l29_header_upvote", "WITH " + WORD_COUNTS.replace("l[i] AS text", HEADED) + ", " + HEADERS.split(", acc AS", 1)[1].join(["acc AS", ""]) + f""", hw AS (SELECT DISTINCT vol, page, lower({STRIP}) AS word FROM tokens WHERE (vol, page, line) IN (SELECT vol, page, line FROM headers)),
more AS (SELECT * FROM hw WHERE word IN ({", ".join(f"'{w}'" for w in words.HEADER_WORDS)}))
SELECT coalesce(c.vol, m.vol) AS vol, coalesce(c.page, m.page) AS page, sum(coalesce(c.n, 0) + CASE WHEN m.word IS NULL THEN 0 ELSE 2 END) AS n FROM word_counts c FULL JOIN more m ON c.vol = m.vol AND c.page = m.page AND c.word = m.word GROUP BY 1, 2""")
def l29(spark, d):
    lines = headed_lines(spark, d)
    up = L.header_upvote(L.word_counts(L.tokens(lines)), lines, L.running_headers(lines))
    return up.groupBy("vol", "page").agg(F.sum("n").alias("n"))


@query("l30_header_removal", "WITH " + HEADERS + " SELECT vol, page, count(*) AS lines FROM lines l WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.vol = l.vol AND h.page = l.page AND h.line = l.line) GROUP BY vol, page")
def l30(spark, d):
    lines = headed_lines(spark, d)
    return L.without_headers(lines, L.running_headers(lines)).groupBy("vol", "page").agg(F.count("*").alias("lines"))


@query("l31_long_s_suspicion", "WITH " + PLAIN + f""", c AS (SELECT vol, count(*) FILTER (WHERE word IN ({", ".join(f"'{w}'" for w in words.LONG_S_ERRORS)})) + 1 AS errors, count(*) FILTER (WHERE word IN ({", ".join(f"'{w}'" for w in words.LONG_S_TRUTHS)})) + 1 AS truths FROM plain GROUP BY vol)
SELECT vol, errors, truths, truths <= errors AS problem FROM c""")
def l31(spark, d):
    return L.long_s_suspicion(tokens_of(spark, d))


@query("l33_trailing_punctuation", "WITH " + TOKENS + " SELECT vol, page, sum(CASE WHEN length(token) > 1 AND regexp_matches(token, '[.,?!;)]$') THEN 2 ELSE 1 END) AS n FROM tokens GROUP BY vol, page")
def l33(spark, d):
    split = F.when((F.length("token") > 1) & F.col("token").rlike("[.,?!;)]$"), F.array(F.expr("left(token, length(token) - 1)"), F.expr("right(token, 1)"))).otherwise(F.array("token"))
    return tokens_of(spark, d).select("vol", "page", F.explode(split).alias("token")).groupBy("vol", "page").agg(F.count("*").alias("n"))


@query("l34_long_s_letters", "WITH " + VOL_PAGES + r" SELECT vol, page, length(regexp_replace(translate(replace(text, 'ﬅ', 'st'), 'ſ', 's'), '([.,;:?!])', ' \1 ', 'g')) AS chars FROM vol_pages")
def l34(spark, d):
    text = F.regexp_replace(F.translate(F.replace(F.col("text"), F.lit("ﬅ"), F.lit("st")), "ſ", "s"), "([.,;:?!])", " $1 ")
    return volume_pages(spark, d).select("vol", "page", F.length(text).alias("chars"))


@query(
    "l40_caps_outliers",
    "WITH " + ACC + r""", p AS (SELECT vol, page, count(*) AS n, avg(CASE WHEN regexp_matches(s, '^["“'']?\p{Lu}') THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM acc WHERE length(s) >= 2 GROUP BY vol, page HAVING count(*) > 3)
SELECT vol, page, n, share, abs(share - avg(share) OVER w) > 2.25 * stddev_pop(share) OVER w + 1e-9 AS outlier FROM p WINDOW w AS (PARTITION BY vol ORDER BY page ROWS UNBOUNDED PRECEDING)""",
)
def l40(spark, d):
    return L.caps_outliers(volume_lines(spark, d))


@query(
    "l32_disambiguated",
    "WITH " + TOKENS + """, low AS (SELECT *, lower(token) AS word FROM tokens), t AS (SELECT *, lag(word) OVER w AS b, lead(word) OVER w AS a FROM low WINDOW w AS (PARTITION BY vol ORDER BY page, line, pos)),
c AS (SELECT word, count(*) AS n FROM low GROUP BY word HAVING count(*) >= 5), logs AS (SELECT word, round(ln(n), 6) AS log FROM c),
bigrams AS (SELECT word AS x, a AS y, count(*) AS weight FROM t WHERE a IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
p AS (SELECT word AS first, replace(word, 'f', 's') AS second FROM c WHERE contains(word, 'f')),
s AS (SELECT t.vol, t.page, t.word, p.second AS other, 3 + coalesce(lj.log, 0) AS dj, 3 + coalesce(lh.log, 0) AS dh, jb.weight AS jb, ja.weight AS ja, hb.weight AS hb, ha.weight AS ha FROM t JOIN p ON p.first = t.word
  LEFT JOIN logs lj ON lj.word = t.word LEFT JOIN logs lh ON lh.word = p.second LEFT JOIN bigrams jb ON jb.x = t.b AND jb.y = t.word LEFT JOIN bigrams ja ON ja.x = t.word AND ja.y = t.a
  LEFT JOIN bigrams hb ON hb.x = t.b AND hb.y = p.second LEFT JOIN bigrams ha ON ha.x = p.second AND ha.y = t.a)
SELECT vol, word, CASE WHEN coalesce(hb, dh) * coalesce(ha, dh) > coalesce(jb, dj) * coalesce(ja, dj) THEN other ELSE word END AS form, count(*) AS n FROM s GROUP BY ALL""",
)
def l32(spark, d):
    from leafmill.operators import correction as K

    lines = volume_lines(spark, d)
    t = L.neighboured_tokens(lines)
    counts = written(L.token_counts(lines).groupBy(F.lower("token").alias("word")).agg(F.sum("n").alias("n")).where("n >= 5"), "word-counts")
    near = t.select(F.lower("token").alias("a"), F.lower("after").alias("b")).where("b IS NOT NULL")
    near = near.where("contains(a, 'f') OR contains(b, 'f') OR contains(a, 's') OR contains(b, 's')")  # a suspect word has an f, the other form an s
    bigrams = near.groupBy("a", "b").agg(F.count("*").alias("weight")).where("weight >= 3")
    pairs = counts.where(F.col("word").contains("f")).select(F.col("word").alias("first"), F.replace("word", F.lit("f"), F.lit("s")).alias("second"))
    found = K.disambiguate(t, pairs, bigrams, counts.select("word", F.round(F.log("n"), 6).alias("log")))
    return found.groupBy("vol", "word", "form").agg(F.count("*").alias("n"))


VERSE = LINES + r""", f AS (SELECT vol, page, line, text, regexp_extract(text, '[\p{Lu}\p{Ll}\p{N}<]') AS c, row_number() OVER (PARTITION BY vol ORDER BY page, line) AS nr FROM lines),
g AS (SELECT *, CASE WHEN length(text) < 1 THEN 'blank' WHEN regexp_matches(c, '\p{Lu}') THEN 'yes' WHEN regexp_matches(c, '\p{Ll}') THEN 'no' WHEN regexp_matches(c, '\p{N}') THEN 'number' WHEN c = '<' THEN 'blank' ELSE 'amb' END AS t0 FROM f),
h AS (SELECT *, CASE WHEN t0 = 'no' AND lag(t0) OVER w = 'yes' AND length(text) < 29 AND lag(length(text)) OVER w - length(text) > 12 THEN 'runon' ELSE t0 END AS tag FROM g WINDOW w AS (PARTITION BY vol ORDER BY nr)),
i AS (SELECT *, CASE WHEN tag = 'yes' THEN 1 ELSE 0 END AS cap, sum(CASE WHEN tag = 'no' THEN 1 ELSE 0 END) OVER (PARTITION BY vol ORDER BY nr) AS part FROM h),
k AS (SELECT *, least(4, sum(cap) OVER (PARTITION BY vol, part ORDER BY nr RANGE BETWEEN 8 PRECEDING AND CURRENT ROW)) AS b, least(5, sum(cap) OVER (PARTITION BY vol, part ORDER BY nr RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING)) AS a FROM i),
verse AS (SELECT vol, page, line, text, tag, tag <> 'no' AND b + a > 4 AND a > 0 AS verse FROM k)"""


@query("l36_l37_verse_lines", "WITH " + VERSE + " SELECT vol, page, count(*) FILTER (WHERE tag IN ('yes', 'no', 'runon')) AS lines, count(*) FILTER (WHERE tag = 'yes') AS caps, count(*) FILTER (WHERE verse) AS verse FROM verse GROUP BY vol, page")
def l36(spark, d):
    from leafmill.operators import correction as K

    v = K.verse_lines(volume_lines(spark, d))
    return v.groupBy("vol", "page").agg(F.count_if(F.col("tag").isin("yes", "no", "runon")).alias("lines"), F.count_if(F.col("tag") == "yes").alias("caps"), F.count_if("verse").alias("verse"))


L38_VERSE_WORD_COUNTS_SQL = (
    "WITH " + LEXICON + ", " + VERSE.split(", f AS (SELECT", 1)[1].join(["f AS (SELECT", ""]) + PERSONAL + rf""", roman AS (SELECT h || t || o AS word FROM (SELECT unnest({ROMAN_HUNDREDS}) AS h) a, (SELECT unnest({ROMAN_TENS}) AS t) b, (SELECT unnest({ROMAN_ONES}) AS o) c WHERE h || t || o NOT IN ('', 'i')),
vt AS (SELECT vol, page, verse, unnest({token_list_sql("text")}) AS token FROM verse), vc AS (SELECT vol, page, verse, {CASE} AS kind, CASE WHEN {CASE} = 'heterogenous' THEN token ELSE lower(token) END AS token FROM vt),
vs AS (SELECT vol, page, verse, kind, {STRIP} AS token FROM vc), vp AS (SELECT vol, page, verse, kind, CASE WHEN length(token) > 2 THEN regexp_replace(token, '''[sS]$', '') ELSE token END AS token FROM vs),
w AS (SELECT vol, page, verse, CASE WHEN lower(token) IN (SELECT word FROM roman) THEN 'romannumeral' WHEN {NUMBER} IS NOT NULL THEN 'arabicnumeral' WHEN kind IN ('title', 'upper') AND lower(token) IN (SELECT word FROM personal) THEN 'personalname'
  WHEN lower(token) IN (SELECT word FROM lexicon) THEN lower(token) WHEN kind = 'title' THEN 'titlecasenodict' END AS word FROM vp)
SELECT vol, page, verse, word, count(*) AS n FROM w WHERE word IS NOT NULL GROUP BY ALL"""
)


@query("l38_verse_word_counts", L38_VERSE_WORD_COUNTS_SQL)
@query("l38_verse_word_counts_all", L38_VERSE_WORD_COUNTS_SQL)
def l38_all(spark, d):
    from leafmill.operators import correction as K

    lines = volume_lines(spark, d)
    lexicon, personal, _ = rules_of(L.tokens(lines))
    return K.verse_word_counts(K.verse_lines(lines), lexicon.select("word"), personal)


@query(
    "l39_hyphen_rejoin",
    "WITH " + LINES + r""", cut AS (SELECT vol, page, line, lower(trim(CASE WHEN length(text) > 40 THEN substr(text, 1, 20) || '-' ELSE text END, ' ')) AS a, CASE WHEN length(text) > 40 THEN lower(trim(substr(text, 21), ' ')) END AS b FROM lines),
s AS (SELECT vol, page, line * 2 AS line, a AS s FROM cut WHERE a <> '' UNION ALL SELECT vol, page, line * 2 + 1, b FROM cut WHERE b <> ''),
n AS (SELECT *, lead(s) OVER (PARTITION BY vol, page ORDER BY line) AS f FROM s),
p AS (SELECT vol, page, line, regexp_replace(string_split_regex(s, '\s+')[-1], '[-—]+$', '') AS last, string_split_regex(f, '\s+')[1] AS token FROM n WHERE (ends_with(s, '-') OR ends_with(s, '—')) AND f IS NOT NULL),
q AS MATERIALIZED (SELECT vol, page, line, last, """ + STRIP + r""" AS next FROM p),
parts AS MATERIALIZED (SELECT vol, page, line, last, next, last AS word, 1 AS part FROM q UNION ALL SELECT vol, page, line, last, next, next, 2 FROM q UNION ALL SELECT vol, page, line, last, next, last || next, 3 FROM q),
said AS (SELECT unnest(string_split(lower(text), ' ')) AS word FROM lines), fr AS MATERIALIZED (SELECT word, count(*) AS n FROM said GROUP BY word)
SELECT vol, page, line, any_value(last) AS last, any_value(next) AS next FROM parts LEFT JOIN fr ON fr.word = parts.word GROUP BY vol, page, line
HAVING sum(CASE WHEN part < 3 THEN coalesce(n, 0) ELSE 0 END) / 3 < sum(CASE WHEN part = 3 THEN coalesce(n, 0) ELSE 0 END)""",
)
def l39(spark, d):
    from leafmill.operators import correction as K

    lines = volume_lines(spark, d)
    long = F.length("text") > 40
    first = lines.select("vol", "page", (F.col("line") * 2).alias("line"), F.when(long, F.concat(F.substring("text", 1, 20), F.lit("-"))).otherwise(F.col("text")).alias("text"))
    rest = lines.where(long).select("vol", "page", (F.col("line") * 2 + 1).alias("line"), F.expr("substring(text, 21)").alias("text"))
    frequencies = lines.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return K.rejoin_hyphens(first.unionByName(rest), frequencies)


@query("l28_running_headers_exact")
def l28_exact(spark, d):
    from leafmill.operators import correction as K

    return K.running_headers_exact(headed_lines(spark, d))
