"""Queries and the SQL that says the same, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Common table expressions that mirror leafmill.sources.tables.
VOL_PAGES = """vol_pages AS (
  SELECT source || '.' || CAST(doc_id // 1000 AS VARCHAR) AS vol, CAST(doc_id % 1000 AS INTEGER) AS page, doc_id, lang, text
  FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"""
LINES = VOL_PAGES + """, lines AS (
  SELECT vol, page, CAST(i - 1 AS INTEGER) AS line, l[i] AS text
  FROM (SELECT vol, page, string_split(text, chr(10)) AS l FROM vol_pages) s, unnest(range(1, len(l) + 1)) AS u(i))"""
TOKENS = LINES + r""", padded AS (
  SELECT vol, page, line, replace(replace(replace(
    regexp_replace(replace(replace(replace(replace(text, '”', '” '), ':', ': '), ';', '; '), ',,', ', , '), ',(\D)', ', \1', 'g'),
    '—', ' — '), '--', ' -- '), '_', ' ') AS t
  FROM lines WHERE NOT (starts_with(trim(text, ' '), '<') AND ends_with(trim(text, ' '), '>'))
), tokens AS (
  SELECT vol, page, line, CAST(i - 1 AS INTEGER) AS pos, l[i] AS token
  FROM (SELECT vol, page, line, [x FOR x IN string_split_regex(t, '\s+') IF x <> ''] AS l FROM padded) s, unnest(range(1, len(l) + 1)) AS u(i))"""
WORD_COUNTS = TOKENS + r""", word_counts AS (
  SELECT vol, page, lower(token) AS word, count(*) AS n FROM tokens WHERE regexp_matches(token, '[\p{L}\p{Nd}]') GROUP BY ALL)"""
P = r"""[.,?!;"“”:—)(''`\[\]{}]"""
STRIP = rf"""regexp_replace(CASE WHEN regexp_matches(token, '^{P}+$') THEN substr(token, 1, 1) ELSE regexp_replace(token, '{P}+$', '') END, '^{P}+(.)', '\1')"""
ACCEPTED = "NOT (starts_with(trim(text, ' '), '<') AND ends_with(trim(text, ' '), '>'))"
ACC = LINES + f", acc AS (SELECT vol, page, line, text, trim(text, ' ') AS s FROM lines WHERE {ACCEPTED})"
PLAIN = TOKENS + f", plain AS (SELECT *, lower({STRIP}) AS word FROM tokens)"
LEXICON = PLAIN + r", lexicon AS (SELECT word, count(*) AS n FROM plain WHERE regexp_matches(word, '^\p{L}+$') GROUP BY word HAVING count(*) >= 20)"
EVENT_PAGES = """event_pages AS (
  SELECT user_id AS vol, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS page,
    event_type AS category, value AS words, event_id FROM events)"""

CATEGORIES = ("click", "error", "signup", "purchase", "view")


def _weight(g: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':{g}'), 1, 7) AS BIGINT) % 1000 + 1 + CASE WHEN category = '{g}' THEN 1000 ELSE 0 END)"


PREDICTIONS = EVENT_PAGES + f""", truths AS (
  SELECT *, CASE WHEN event_id % 7 = 0 THEN coalesce(lead(category) OVER (PARTITION BY vol ORDER BY page), category) ELSE category END AS truth
  FROM event_pages
), weights AS (
  SELECT *, {", ".join(f"CAST({_weight(g)} AS DOUBLE) AS w_{g}" for g in CATEGORIES)} FROM truths
), predictions AS (
  SELECT vol, page, category, words, event_id, truth, {", ".join(f"w_{g} / ({' + '.join('w_' + x for x in CATEGORIES)}) AS p_{g}" for g in CATEGORIES)} FROM weights
), probabilities AS (
  {" UNION ALL ".join(f"SELECT vol, page, {i} AS idx, '{g}' AS category, p_{g} AS p FROM predictions" for i, g in enumerate(CATEGORIES))})"""


def token_list_sql(text: str) -> str:
    """The tokens of a line as a list."""
    marks = text
    for old, new in (("”", "” "), (":", ": "), (";", "; "), (",,", ", , ")):
        marks = f"replace({marks}, '{old}', '{new}')"
    marks = rf"regexp_replace({marks}, ',(\D)', ', \1', 'g')"
    for old, new in (("—", " — "), ("--", " -- "), ("_", " ")):
        marks = f"replace({marks}, '{old}', '{new}')"
    return rf"[x FOR x IN string_split_regex({marks}, '\s+') IF x <> '']"


def trailing_sql(x: str) -> str:
    """``x`` without punctuation at its end; one character is left."""
    return f"CASE WHEN regexp_matches({x}, '^{P}+$') THEN substr({x}, 1, 1) ELSE regexp_replace({x}, '{P}+$', '') END"


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
