"""The queries ``opN_<name>`` over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import byte_bpe, exact_dedup, exact_topk, html_extract, jaccard_join, language_id, line_dedup, merkle, packing, prefix_trie, shards, substring_dedup, token_counts
from leafmill.llm.common import new_path, written
from leafmill.sources import tables

WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.spread(tables.table(spark, sf_dir, name))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.exact_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals of documents, compacted; the rows of the last version as its shards hold them.

    ``compacted`` says that no tier is left to merge, that fewer shards are listed than were written,
    and that the manifest counts the rows that arrived.
    """
    store = shards.ShardStore(spark, new_path(spark, "shard-store"), target_bytes=128 << 20, fanout=4)
    docs = table(spark, sf_dir, "documents")
    store.append_all(docs.withColumn("arrival", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(8))), "arrival")
    written = store.shards()
    store.compact()
    store.vacuum()
    left = store.shards()
    compacted = not store.full_tiers() and (len(left) < len(written) or len(written) < 4) and sum(s.rows for s in left) == sum(s.rows for s in written)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), F.lit(compacted).alias("compacted"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, TRUE AS compacted FROM documents"


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, with_decoded=True)
    return byte_bpe.digests(encoded)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_dropped")


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, lines[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) s, unnest(range(1, len(lines) + 1)) AS u(i)
), flats AS (
  SELECT doc_id, i, line, trim(regexp_replace(line, '[ \t\r\f\x0B]+', ' ', 'g'), ' ') AS flat FROM lines
), parsed AS (
  SELECT doc_id, i, line, flat, regexp_replace(flat, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked, len(string_split(flat, ' ')) AS n FROM flats
), judged AS (
  SELECT *, n - len(list_filter(string_split(masked, ' '), lambda t: t = '<*>')) AS constants FROM parsed
), variants AS (
  SELECT DISTINCT masked, n, constants, array_to_string(string_split(masked, ' ')[1:3], ' ') AS lead FROM judged WHERE flat <> '' AND constants >= 5 AND 100 * constants >= 80 * n
), places AS (
  SELECT masked, n, lead, constants, pos, string_split(masked, ' ')[pos] AS token FROM variants, unnest(range(1, n + 1)) AS u(pos)
), support AS (
  SELECT n, lead, pos, token, count(*) AS c FROM places GROUP BY n, lead, pos, token
), ranked AS (
  SELECT p.masked, p.n, p.constants, p.pos, p.token, CASE WHEN p.token <> '<*>' AND p.pos > 3 THEN row_number() OVER (PARTITION BY p.masked, p.n, p.token <> '<*>' AND p.pos > 3 ORDER BY s.c, p.pos) END AS rare, s.c
  FROM places p JOIN support s ON p.n = s.n AND p.lead = s.lead AND p.pos = s.pos AND p.token = s.token
), alone AS (
  SELECT masked, count(*) FILTER (WHERE c = 1 AND rare IS NOT NULL) AS k FROM ranked GROUP BY masked
), steps AS (
  SELECT v.masked, n, j FROM variants v JOIN alone a ON a.masked = v.masked, unnest(range(k, n + 1)) AS u(j) WHERE constants - j >= 5 AND 100 * (constants - j) >= 80 * n
), templates AS (
  SELECT t.masked, t.j, string_agg(CASE WHEN r.rare <= t.j THEN '<*>' ELSE r.token END, ' ' ORDER BY r.pos) AS template
  FROM steps t JOIN ranked r ON r.masked = t.masked AND r.n = t.n GROUP BY t.masked, t.j
), placed AS (
  SELECT doc_id, i, CASE WHEN 100 * constants >= 80 * n AND constants >= 5 THEN masked ELSE chr(10) || flat END AS template FROM judged WHERE flat <> ''
  UNION ALL SELECT j.doc_id, j.i, 'general ' || t.template FROM judged j JOIN templates t ON j.masked = t.masked
), recurring AS (
  SELECT template, min(doc_id) AS home FROM placed GROUP BY template HAVING count(DISTINCT doc_id) >= 2
), hit AS (
  SELECT DISTINCT p.doc_id, p.i FROM placed p JOIN recurring r ON p.template = r.template WHERE p.doc_id <> r.home
), marked AS (
  SELECT l.doc_id, l.i, l.line, h.i IS NOT NULL AS gone FROM lines l LEFT JOIN hit h ON h.doc_id = l.doc_id AND h.i = l.i
)
SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '') AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM marked GROUP BY doc_id
"""


def op9_line_dedup_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows: short lines are templates like any other."""
    return op9_line_dedup(spark, sf_dir)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


# crc32 of a decimal text: its bytes taken through the table of the reflected polynomial.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def crc_sql(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) for x in string_split({text}, '')]), lambda v, b: xor(v >> 8, crc.t[xor(v & 255, b) + 1])))"


def rebuilt_conversations(ordered: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and their ids: the first h turns of c - c % 5, then c's own after its first h."""
    c = F.col("conv_id")
    convs = ordered.select("conv_id").distinct().select("conv_id", (F.crc32(c.cast("string")) % 9).alias("h"), (c - c % 5).alias("head"))
    first = ordered.where((c % 5 == 0) & (F.col("place") < most)).groupBy(c.alias("head")).agg(F.sort_array(F.collect_list(F.struct("place", "turn", "n_bytes"))).alias("turns"))
    taken = F.coalesce(F.slice("turns", F.lit(1), F.col("h").cast("int")), F.expr("CAST(array() AS array<struct<place:bigint,turn:binary,n_bytes:bigint>>)"))
    convs = written(convs.join(first, "head", "left").select("conv_id", "h", taken.alias("taken")), "rebuilt")
    heads = convs.select("conv_id", F.inline("taken")).select("conv_id", F.col("place").alias("position"), "turn", "n_bytes")
    own = ordered.join(convs.select("conv_id", "h", F.size("taken").alias("n")), "conv_id").where("place >= h")
    return heads.unionByName(own.select("conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("position"), "turn", "n_bytes")), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt_conversations(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    nodes, ends = prefix_trie.prefix_trie(turns, convs)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, "parent", "left").join(prefix_trie.end_digests(ends), "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


OP11_SQL = f"""
WITH {CRC_TABLE}, t AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL
), o AS MATERIALIZED (
  SELECT conv_id, k, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS place FROM t
), c AS MATERIALIZED (
  SELECT conv_id, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS head FROM (SELECT DISTINCT conv_id FROM o) x, crc
), n AS (
  SELECT c.conv_id, any_value(c.h) AS h, count(o.place) AS n FROM c LEFT JOIN o ON o.conv_id = c.head AND o.place < c.h GROUP BY c.conv_id
), r AS MATERIALIZED (
  SELECT c.conv_id, o.place AS pos, k, bytes FROM c JOIN o ON o.conv_id = c.head AND o.place < c.h
  UNION ALL SELECT n.conv_id, o.place - n.h + n.n, k, bytes FROM n JOIN o ON o.conv_id = n.conv_id AND o.place >= n.h
), p AS (
  SELECT conv_id, pos + 1 AS depth, bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS node FROM r
), m AS MATERIALIZED (
  SELECT conv_id, depth, bytes, node, substr(node, 1, 32 * (depth - 1)) AS parent FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c
), nodes AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(bytes) AS bytes FROM m GROUP BY node, depth
), kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
judged AS MATERIALIZED (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.parent = nodes.node),
sums AS (
  SELECT m.node, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * u.bytes) AS BIGINT) AS saved
  FROM judged u JOIN m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.node
), lens AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
ends AS (SELECT m.node, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM m JOIN lens USING (conv_id, depth) GROUP BY m.node)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM judged v JOIN sums s ON s.node = v.node LEFT JOIN judged q ON q.node = v.parent LEFT JOIN ends e ON e.node = v.node
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def _merkle_level(nodes: str, made: str, key: str) -> str:
    """Runs of 16 nodes, and what they become; a tree of one node stays as it is."""
    return f"""{made} AS (
  SELECT {key}, p // 16 AS p, CASE WHEN any_value(total) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY p)) END AS node, CAST(ceil(any_value(total) / 16) AS BIGINT) AS total
  FROM {nodes} GROUP BY {key}, p // 16)"""


def _merkle_step(rows: str, nodes: str, made: str, key: str, place: str) -> str:
    """``rows`` one level higher: the siblings join the proof, and the tampered node is folded with them."""
    same = f"n.{key} IS NOT DISTINCT FROM r.{key} AND n.p // 16 = r.{place} // 16"
    part = lambda op: f"coalesce(string_agg(n.node, '' ORDER BY n.p) FILTER (WHERE n.p {op} r.{place}), '')"
    columns = ["doc_id", "source", "leaf", "p", "sp", "proof", "fold", "n"]
    kept = ", ".join(f"r.{c}" for c in columns if c not in (place, "proof", "fold"))
    return f"""{made} AS MATERIALIZED (
  SELECT {kept}, r.{place} // 16 AS {place}, r.proof || {part("<>")} AS proof, CASE WHEN any_value(n.total) = 1 THEN r.fold ELSE sha256({part("<")} || r.fold || {part(">")}) END AS fold
  FROM {rows} r JOIN {nodes} n ON {same} GROUP BY {kept}, r.{place}, r.proof, r.fold)"""


def _op12_sql(levels: int, source_levels: int) -> str:
    """SQL for sources of at most 16^levels documents and at most 16^source_levels sources."""
    part = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
    leaf = lambda text: f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} || {part(text)})"
    up = [_merkle_level(f"t{i}", f"t{i + 1}", "source") for i in range(levels)]
    top = [_merkle_level(f"s{i}", f"s{i + 1}", "k") for i in range(source_levels)]
    fold = [_merkle_step(f"r{i}", f"t{i}", f"r{i + 1}", "source", "p") for i in range(levels)]
    fold += [_merkle_step(f"r{levels + i}" if i else f"q{levels}", f"s{i}", f"r{levels + 1 + i}", "k", "sp").replace("r.k", "0") for i in range(source_levels)]
    return f"""
WITH {CRC_TABLE}, d AS MATERIALIZED (
  SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0
    THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents, crc
), n AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS total FROM d
), t0 AS (SELECT source, p, leaf AS node, total FROM n), {", ".join(up)},
s0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS p, count(*) OVER () AS total, node, source FROM t{levels}), {", ".join(top)},
r0 AS MATERIALIZED (
  SELECT doc_id, n.source, leaf, n.p, s0.p AS sp, '' AS proof, coalesce(changed, leaf) AS fold, row_number() OVER () AS n
  FROM n JOIN s0 ON n.source IS NOT DISTINCT FROM s0.source
), {", ".join(fold[:levels])}, q{levels} AS (SELECT * FROM r{levels}), {", ".join(fold[levels:])}
SELECT r.doc_id, r.leaf, t.node AS subroot, s.node AS root, sha256(r.proof) AS proof_sha256, r.fold AS folded_root, r.fold = s.node AS verified
FROM r{levels + source_levels} r JOIN t{levels} t ON r.source IS NOT DISTINCT FROM t.source, s{source_levels} s
"""


OP12_SQL = _op12_sql(4, 2)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, doc_id, i, w[i] AS word, CASE WHEN doc_id IS NOT NULL AND i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS k FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
s AS MATERIALIZED (SELECT *, k IS NOT NULL AND rank() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM p),
c AS (SELECT *, max(CASE WHEN later THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM s),
k AS (SELECT r, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op9_line_dedup_short_lines": op9_line_dedup_short_lines,
    "op10_html_extract": op10_html_extract,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL = {"op1_exact_topk": OP1_SQL, "op2_sharding": OP2_SQL, "op7_exact_dedup": OP7_SQL, "op9_line_dedup": OP9_SQL, "op9_line_dedup_short_lines": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_substring_dedup": OP13_SQL}
