"""Queries through the file formats: a given table is written by a sink to the shared folder and read back by a source."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from leafmill.operators import catalogue as C
from leafmill.operators import sequence as S
from leafmill.plans.page_queries import FEATURES, features_of
from leafmill.plans.registry import EVENT_PAGES, LINES, PREDICTIONS, TOKENS, VOL_PAGES, query
from leafmill.plans.report_queries import VOLUMES, volumes_of
from leafmill.plans.text_queries import tokens_of
from leafmill.sources import files, sinks
from leafmill.sources.staged import new_path, written
from leafmill.sources.tables import CATEGORIES, event_pages, event_predictions, event_probabilities, table, volume_lines, volume_pages

FILE_TASKS = 4  # for each core, where volumes are written to files of their own
SEQ_LINES = LINES + ", seqs AS (SELECT vol, page, CAST(row_number() OVER (PARTITION BY vol ORDER BY page) - 1 AS INTEGER) AS seq FROM vol_pages)"


def in_folders(spark, rows, label, **options):
    """``rows(vol, value)`` as text files, one folder a volume; the path.

    The cost is that of the files, so volumes are dealt over a fixed number of tasks: by their few bytes they would be one. Tasks move
    their own files to the folder, as nothing reads it before all are there; else the driver would move the folders of all volumes one by one.
    """
    path = new_path(spark, label)
    own = {"mapreduce.fileoutputcommitter.algorithm.version": "2"} | options
    rows.select("vol", "value").repartition(FILE_TASKS * spark.sparkContext.defaultParallelism, "vol").write.partitionBy("vol").options(**own).text(path)
    return path


def paged_texts(spark, d):
    """``vol, value``: the pages of a volume with end marks between them."""
    pages = volume_pages(spark, d).groupBy("vol").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))  # a volume has at most a thousand
    return pages.select("vol", F.array_join("pages.text", "\n<pb>\n").alias("value"))


PAGED_SQL = "WITH " + SEQ_LINES + " SELECT vol, seq AS page, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines JOIN seqs USING (vol, page) GROUP BY vol, seq"


def sized(lines):
    return lines.groupBy("vol", "page").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("s1_page_feature_files", "WITH " + FEATURES + " SELECT vol, page, count(*) AS features, CAST(sum(count) AS BIGINT) AS n FROM features GROUP BY vol, page")
def s1(spark, d):
    rows = features_of(spark, d).select("vol", F.concat_ws("\t", F.col("page").cast("string"), "feature", F.col("count").cast("string")).alias("value"))
    good, _ = files.page_features(spark, in_folders(spark, rows, "feature-files"), suffix="vol=")
    return good.groupBy("vol", "page").agg(F.count("*").alias("features"), F.sum("count").alias("n"))


@query("s2_paged_text_files", PAGED_SQL)
def s2_files(spark, d):
    return sized(files.paged_text(spark, in_folders(spark, paged_texts(spark, d), "paged-text"), suffix="vol="))


@query("s3_packed_text_files", PAGED_SQL.replace(" GROUP BY vol, seq", " WHERE seq < (SELECT max(seq) FROM seqs s WHERE s.vol = seqs.vol) GROUP BY vol, seq"))
def s3_files(spark, d):
    path = in_folders(spark, paged_texts(spark, d), "packed-text", compression="bzip2")
    return sized(files.paged_text(spark, path, keep_last=False, suffix="vol="))


@query("s4_zipped_volumes", "WITH " + SEQ_LINES + " SELECT vol, seq AS page, count(*) AS lines, 'success' AS status FROM lines JOIN seqs USING (vol, page) WHERE NOT (line > 0 AND text = '') GROUP BY vol, seq")
def s4(spark, d):
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vol, pages in zip(batch["vol"], batch["pages"], strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    for p in reversed(pages):
                        z.writestr(f"{vol}/x_{p['page']:08d}.txt", p["text"] or "\n")
                    z.writestr(f"{vol}/_notes.txt", "no page")
                out.append((f"{vol}.zip", raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    pages = volume_pages(spark, d).groupBy("vol").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    archives = written(pages.mapInPandas(packed, "path string, content binary"), "zip-archives")
    read = files.unzipped(archives).where("NOT (line > 0 AND text = '')")
    return read.groupBy("vol", "page", "status").agg(F.count("*").alias("lines")).select("vol", "page", "lines", "status")


@query("s5_extracted_features", "WITH " + VOL_PAGES + " SELECT vol, CAST(row_number() OVER (PARTITION BY vol ORDER BY page) - 1 AS INTEGER) AS page, 'success' AS status, CAST(length(text) AS BIGINT) AS tokens FROM vol_pages")
def s5(spark, d):
    page = F.struct("page", F.col("page").cast("string").alias("seq"), F.length("text").cast("long").alias("tokenCount"))
    vols = volume_pages(spark, d).groupBy("vol").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    value = F.to_json(F.struct(F.col("vol").alias("id"), F.struct("pages").alias("features")))
    return files.extracted_features(spark, in_folders(spark, vols.select("vol", value.alias("value")), "extracted", compression="bzip2")).select("vol", "page", "status", "tokens")


@query("s6_category_map_files", "WITH " + EVENT_PAGES + " SELECT vol, page, category FROM event_pages")
def s6_files(spark, d):
    rows = event_pages(spark, d).select("vol", F.concat_ws("\t", F.col("page").cast("string"), "category").alias("value"))
    return files.category_maps(spark, in_folders(spark, rows, "category-maps"), suffix="vol=").select(F.col("vol").cast("long").alias("vol"), "page", "category")


def predicted(spark, d):
    return event_predictions(spark, d).withColumns({"raw": F.col("category"), "smooth": F.col("truth")})


@query("s7_k5_prediction_files", "WITH " + PREDICTIONS + " SELECT vol, page, category AS raw, truth AS smooth, round_even(p_click, 4) AS click, round_even(p_view, 4) AS view FROM predictions")
def s7(spark, d):
    path = new_path(spark, "prediction-files")
    sinks.prediction_lines(predicted(spark, d), CATEGORIES).write.text(path)
    p = lambda g: F.try_element_at("probs", F.lit(g)).alias(g)
    return files.prediction_tsv(spark, path).select(F.col("vol").cast("long").alias("vol"), "page", "raw", "smooth", p("click"), p("view"))


@query("s8_k5_prediction_objects", "WITH " + PREDICTIONS + " SELECT vol, page, category AS raw, truth AS smooth FROM predictions")
def s8(spark, d):
    path = new_path(spark, "prediction-objects")
    rows = predicted(spark, d)
    lines = sinks.prediction_json_lines(rows, CATEGORIES).unionByName(sinks.prediction_json_lines(rows.where("vol % 5 = 0"), CATEGORIES, model="other"))
    lines.select("value").write.text(path)
    return files.prediction_json(spark, path).select(F.col("vol").cast("long").alias("vol"), "page", "raw", "smooth")


@query("s9_archived_objects", "WITH " + VOL_PAGES + " SELECT vol, count(*) AS members, CAST(sum(length(text)) AS BIGINT) AS chars FROM vol_pages GROUP BY vol")
def s9(spark, d):
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vol, pages in zip(batch["vol"], batch["pages"], strict=True):
                raw = io.BytesIO()
                with tarfile.open(fileobj=raw, mode="w:gz") as t:
                    for p in pages:
                        content = p["text"].encode()
                        info = tarfile.TarInfo(f"{vol}/{p['page']}.json")
                        info.size = len(content)
                        t.addfile(info, io.BytesIO(content))
                out.append((vol, raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    pages = volume_pages(spark, d).groupBy("vol").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    archives = written(pages.mapInPandas(packed, "path string, content binary"), "tar-archives")
    return files.untarred(archives).groupBy(F.col("archive").alias("vol")).agg(F.count("*").alias("members"), F.sum(F.length("value")).alias("chars"))


@query("s10_k9_metadata_tsv", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CAST(o_orderdate AS VARCHAR)[1:4] AS year FROM orders")
def s10(spark, d):
    path = new_path(spark, "metadata-tsv")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy").alias("year"))
    sinks.metadata_tsv(rows, path)
    return files.appended_metadata(spark, path)


@query("k9_appended_metadata", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_orderpriority AS note FROM orders")
def k9(spark, d):
    """Two appends to one table, read back under one header."""
    path = new_path(spark, "metadata-tsv")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"))
    for rest in (0, 1):
        sinks.metadata_tsv(rows.where(F.col("id").cast("long") % 2 == rest), path)
    return files.appended_metadata(spark, path)


@query("s11_latin1_metadata", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'É ' || c_name || ' ñ' AS name FROM customer")
def s11(spark, d):
    path = new_path(spark, "metadata-csv")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("É "), "c_name", F.lit(" ñ")).alias("name"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.metadata_csv(spark, path)


RECORD_TAG = "CASE o_orderkey % 3 WHEN 0 THEN 'Fiction' WHEN 1 THEN 'Poetry' ELSE 'lower case' END"


@query(
    "s12_b1_catalogue_records",
    "SELECT 'ab.' || o_orderkey AS htid, 'r' || o_custkey AS recordid, CAST(o_orderkey AS VARCHAR) AS oclc, 'PR' || o_custkey AS locnum, 'Clerk ' || o_custkey AS author, 'London;Smith;' || year(o_orderdate) AS imprint, 's' AS datetype, CAST(year(o_orderdate) AS VARCHAR) AS startdate, '    ' AS enddate, "
    "CAST(year(o_orderdate) AS VARCHAR) AS textdate, 'enk' AS place, CASE WHEN o_orderkey % 2 = 0 THEN 'v.' || o_orderkey % 7 ELSE '<blank>' END AS enumcron, 'monograph' AS materialtype, 'History;IsBiographical;London' AS subjects, "
    f"array_to_string(list_sort(list_distinct([x FOR x IN [CASE WHEN o_orderkey % 3 < 2 THEN {RECORD_TAG} END, 'NotBiographical', 'NotFiction'] IF x IS NOT NULL])), ';') AS categories, 'Works of ' || o_orderstatus AS title FROM orders WHERE o_orderkey % 5 <> 0",
)
def s12(spark, d):
    o = table(spark, d, "orders")
    text = lambda c: F.col(c).cast("string")
    year = F.date_format("o_orderdate", "yyyy")
    sub = lambda value, code: F.struct(value.alias("_VALUE"), F.lit(code).alias("_code"))
    field = lambda tag, *subs: F.struct(F.lit(tag).alias("_tag"), F.array(*subs).alias("subfield"))
    fixed = F.concat(F.lit("850101s"), year, F.lit("    enk" + " " * 15 + "0#" + " " * 5))
    control = lambda tag, value: F.struct(value.alias("_VALUE"), F.lit(tag).alias("_tag"))
    item = F.when(F.col("o_orderkey") % 2 == 0, F.array(sub(F.concat(F.lit("ab."), text("o_orderkey")), "a"), sub(F.concat(F.lit("v."), (F.col("o_orderkey") % 7).cast("string")), "c")))
    item = item.otherwise(F.array(sub(F.concat(F.lit("ab."), text("o_orderkey")), "a")))
    item = F.when(F.col("o_orderkey") % 5 == 0, F.array(sub(F.lit("v.1"), "c"))).otherwise(item)
    records = o.select(
        F.lit("00000cama22000004a 4500").alias("leader"),
        F.array(control("001", F.concat(F.lit("r"), text("o_custkey"))), control("008", fixed)).alias("controlfield"),
        F.array(
            field("035", sub(F.concat(F.lit("(OCoLC)ocm"), text("o_orderkey")), "a")), field("050", sub(F.lit("[PR"), "a"), sub(F.concat(text("o_custkey"), F.lit("]")), "b")), field("100", sub(F.concat(F.lit("Clerk "), text("o_custkey")), "a")),
            field("245", sub(F.concat(F.lit("Works of "), "o_orderstatus", F.lit(" /")), "a"), sub(F.lit("by him."), "c")), field("260", sub(F.lit("London :"), "a"), sub(F.lit("Smith,"), "b"), sub(F.concat(year, F.lit("]")), "c")),
            field("650", sub(F.lit("History."), "a"), sub(F.lit("London,"), "z")), field("655", sub(F.expr(RECORD_TAG), "a")), field("970", sub(F.lit("Biography"), "a")),
            F.struct(F.lit("974").alias("_tag"), item.alias("subfield")),
        ).alias("datafield"),
    )
    path = new_path(spark, "catalogue-records")
    records.write.format("xml").option("rowTag", "record").option("rootTag", "collection").save(path)
    return C.flatten_marc(files.marc_records(spark, path))


@query("s13_word_count_tsv", "WITH " + EVENT_PAGES + " SELECT CAST(vol AS VARCHAR) AS vol, page, CAST(floor(words) AS INTEGER) AS count FROM event_pages")
def s13(spark, d):
    path = new_path(spark, "word-count-tsv")
    event_pages(spark, d).select("vol", "page", F.floor("words").cast("int").alias("count")).write.option("sep", "\t").option("header", True).csv(path)
    return files.word_counts_tsv(spark, path)


@query("s15_work_lists", "SELECT CAST(o_custkey AS VARCHAR) AS work, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS seq, CAST(o_orderkey AS VARCHAR) AS vol FROM orders")
def s15(spark, d):
    works = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("vols"))  # the volumes of one work
    path = new_path(spark, "work-lists")
    lists = works.groupBy(F.expr("o_custkey div 100").alias("list")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("o_custkey").cast("string"), "vols")))).alias("value"))  # a hundred works a file
    lists.repartition("list").write.partitionBy("list").text(path)
    return files.work_list(spark, path)


@query("s16_k13_vocabulary_file", "WITH " + LINES + ", w AS (SELECT unnest(string_split(lower(text), ' ')) AS word FROM lines), c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word) SELECT CAST(row_number() OVER (ORDER BY n DESC, encode(word)) - 1 AS INTEGER) AS idx, word, FALSE AS duplicate FROM c ORDER BY n DESC, encode(word) LIMIT 5000")
def s16_file(spark, d):
    words = volume_lines(spark, d).select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    path = new_path(spark, "vocabulary")
    sinks.vocabulary_lines(words.orderBy(F.desc("n"), "word").limit(5000), path)
    return files.vocabulary(spark, path)


HYPHENS = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'tiger-' || c_custkey WHEN 1 THEN 'to-' || c_custkey ELSE 'well' || c_custkey END AS source, CASE c_custkey % 4 WHEN 0 THEN 'tiger ' || c_custkey WHEN 1 THEN 'to' || c_custkey || 'x' ELSE 'well ' || c_custkey END AS target FROM customer"


@query("s17_rule_tables", f"""WITH r AS ({HYPHENS}), d AS (SELECT source, target, 0 AS rank FROM r UNION ALL SELECT replace(source, '-', ''), target, 1 FROM r WHERE contains(target, ' ') UNION ALL SELECT replace(source, '-', ''), target, 2 FROM r WHERE contains(source, '-') AND replace(source, '-', '') <> replace(replace(target, ' ', ''), '-', ''))
SELECT source, min_by(target, rank) AS target, 'hyphen' AS kind FROM d GROUP BY source UNION ALL SELECT DISTINCT target, '', 'word' FROM r WHERE NOT contains(target, ' ') UNION ALL SELECT split_part(target, ' ', 1) || '+' || split_part(target, ' ', 2), source, 'fusing' FROM r WHERE contains(target, ' ')""")
def s17(spark, d):
    source = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('tiger-', c_custkey) WHEN 1 THEN concat('to-', c_custkey) ELSE concat('well', c_custkey) END")
    target = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('tiger ', c_custkey) WHEN 1 THEN concat('to', c_custkey, 'x') ELSE concat('well ', c_custkey) END")
    rules, fusing = new_path(spark, "hyphen-rules"), new_path(spark, "fusing-rules")
    c = table(spark, d, "customer").select(source.alias("source"), target.alias("target"))
    c.select(F.concat_ws("\t", "source", F.concat("target", F.lit(" ")))).write.option("lineSep", "\r\n").text(rules)
    c.where(F.col("target").contains(" ")).select(F.concat_ws("\t", "target", "source")).write.text(fusing)
    hyphens, more = files.hyphen_rules(files.rule_table(spark, rules, ["source", "target"]))
    fused = files.fusing_rules(files.rule_table(spark, fusing, ["source", "target"]))
    out = hyphens.select("source", "target", F.lit("hyphen").alias("kind"))
    out = out.unionByName(more.select(F.col("word").alias("source"), F.lit("").alias("target"), F.lit("word").alias("kind")))
    return out.unionByName(fused.select(F.concat_ws("+", "first", "second").alias("source"), F.col("fused").alias("target"), F.lit("fusing").alias("kind")))


@query("s18_range_labels", "WITH " + EVENT_PAGES + ", r AS (SELECT vol, count(*) AS n FROM event_pages GROUP BY vol) SELECT CAST(vol AS VARCHAR) AS vol, CAST(u.p AS INTEGER) AS page, CAST(vol % 100 AS DOUBLE) / 100 AS probability FROM r, unnest(range(n // 3, n)) AS u(p)")
def s18(spark, d):
    n = event_pages(spark, d).groupBy("vol").agg(F.count("*").alias("n"))
    row = F.concat(F.lit("'"), F.col("vol").cast("string"), F.lit("',"), F.expr("n div 3").cast("string"), F.lit(","), (F.col("n") - 1).cast("string"), F.lit(",a,b,"), (F.col("vol") % 100 / 100.0).cast("string"))
    path = new_path(spark, "range-labels")
    head = spark.createDataFrame([("% pages",), ("@relation pages",), ("@attribute htid string",), ("",), ("@data",)], "value string")
    head.unionByName(n.select(row.alias("value"))).write.text(path)
    return files.range_labels(spark, path)


@query("k2_corrected_text", "WITH " + TOKENS + ", l AS (SELECT vol, page, line, string_agg(token, ' ' ORDER BY pos) AS text FROM tokens GROUP BY vol, page, line) SELECT vol, page, replace(string_agg(text, chr(10) ORDER BY line), '“ ', '“') AS text FROM l GROUP BY vol, page")
def k2(spark, d):
    return sinks.corrected_text(tokens_of(spark, d))


MATCHED = "WITH " + TOKENS + ", w AS (SELECT vol, lower(token) AS word FROM tokens WHERE regexp_matches(token, '^\\p{L}+$')), k AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 20), m AS (SELECT vol, count(*) AS n, avg(CASE WHEN word IN (SELECT word FROM k) THEN 1.0::DOUBLE ELSE 0.0 END) AS a, avg(CASE WHEN word IN (SELECT word FROM k) OR length(word) < 9 THEN 1.0::DOUBLE ELSE 0.0 END) AS b FROM w GROUP BY vol)"


def matched_of(spark, d):
    w = written(tokens_of(spark, d).where(F.col("token").rlike(r"^\p{L}+$")).select("vol", F.lower("token").alias("word")).groupBy("vol", "word").agg(F.count("*").alias("n")), "volume-words")
    known = w.groupBy("word").agg(F.sum("n").alias("all")).where("all >= 20").select("word", F.lit(True).alias("known"))
    return w.join(known, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def rate_of(w, hit):
    return w.groupBy("vol").agg(F.sum("n").alias("tokens"), (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("matched"))


@query("k3_volume_statistics", MATCHED + " SELECT vol AS volID, n AS totalwords, round(a, 6) AS prematched, a >= 0.6 AS preenglish, round(b, 6) AS postmatched, b >= 0.6 AS postenglish FROM m")
def k3(spark, d):
    w = matched_of(spark, d)
    path = new_path(spark, "volume-statistics")
    sinks.metadata_tsv(sinks.volume_statistics(rate_of(w, F.col("known")), rate_of(w, F.col("known") | (F.length("word") < 9))), path)
    read = files.appended_metadata(spark, path)
    kinds = {"totalwords": "long", "prematched": "double", "preenglish": "boolean", "postmatched": "double", "postenglish": "boolean"}
    return read.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}).withColumns({c: F.round(c, 6) for c in ("prematched", "postmatched")})


@query("k4_statuses", MATCHED + ", s AS (SELECT vol, 'not english' AS status FROM m WHERE a < 0.6 UNION ALL SELECT vol, 'short' FROM m WHERE n < 5000 UNION ALL SELECT vol, 'paginationerror' FROM vol_pages GROUP BY vol HAVING min(page) <> 0 OR max(page) <> count(DISTINCT page) - 1 UNION ALL SELECT vol || '?', 'missing data' FROM m) SELECT DISTINCT vol, status FROM s")
def k4(spark, d):
    rates = written(rate_of(matched_of(spark, d), F.col("known")), "match-rates")
    flags = rates.select("vol", F.when(F.col("matched") < 0.6, "not english").otherwise("good").alias("status")).unionByName(rates.select("vol", F.when(F.col("tokens") < 5000, "short").alias("status")))
    pages = volume_pages(spark, d).select("vol", "page")
    wanted = rates.select("vol").unionByName(rates.select(F.concat("vol", F.lit("?")).alias("vol")))
    path = new_path(spark, "statuses")
    sinks.statuses(flags, sinks.pagination_errors(pages), C.align(wanted, pages, pages.withColumn("category", F.lit("x")))).write.parquet(path)
    return spark.read.parquet(path)


@query("k6_prediction_metadata", "WITH " + PREDICTIONS + """, s AS (SELECT vol, page, idx, p, p - coalesce(max(p) OVER (PARTITION BY vol, page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM probabilities),
m AS (SELECT vol, page, max(p) AS maxprob, max_by(step, idx) AS gap FROM s WHERE step > 0 GROUP BY vol, page), v AS (SELECT vol, avg(maxprob) AS maxprob, avg(gap) AS gap FROM m GROUP BY vol)
SELECT c_custkey AS vol, round(maxprob, 6) AS maxprob, round(gap, 6) AS gap, v.vol IS NULL AS missing FROM customer LEFT JOIN v ON v.vol = c_custkey""")
def k6(spark, d):
    path = new_path(spark, "prediction-metadata")
    sinks.prediction_metadata(table(spark, d, "customer").select(F.col("c_custkey").alias("vol")), S.max_and_gap(event_probabilities(spark, d))).write.text(path)
    read = spark.read.schema("vol long, maxprob string, gap string").option("sep", "\t").csv(path)
    number = lambda c: F.round(F.expr(f"try_cast({c} AS double)"), 6).alias(c)
    return read.select("vol", number("maxprob"), number("gap"), (F.col("maxprob") == "NA").alias("missing"))


@query("k7_volume_documents", "WITH " + EVENT_PAGES + """, n AS (SELECT vol, category, count(*) AS n FROM event_pages GROUP BY vol, category), t AS (SELECT vol, CAST(sum(n) AS INTEGER) AS totalpages, max_by(category, (n, category)) AS maxcategory FROM n GROUP BY vol)
SELECT t.vol, totalpages, maxcategory, n.n AS view_pages, round(n.n / totalpages, 2) AS view_pct, CASE WHEN n.n IS NOT NULL THEN CAST(t.vol % 100 AS DOUBLE) / 100 END AS view_prob, CAST(t.vol % 10 AS DOUBLE) / 10 AS precision, c_name AS title FROM t LEFT JOIN n ON n.vol = t.vol AND n.category = 'view' LEFT JOIN customer ON c_custkey = t.vol""")
def k7(spark, d):
    pages = written(event_pages(spark, d), "event-pages")
    vols = pages.select("vol").distinct()
    overall = vols.select("vol", (F.col("vol") % 10 / 10.0).alias("precision"), F.lit(0.5).alias("prob"), F.lit(0.25).alias("recall"))
    per = vols.select("vol", F.lit("view").alias("category"), F.lit(1.0).alias("precision"), (F.col("vol") % 100 / 100.0).alias("prob"), F.lit(0.5).alias("recall"))
    metadata = table(spark, d, "customer").select(F.col("c_custkey").alias("vol"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"))
    documents = sinks.volume_json(pages, metadata, overall, per).withColumn("value", F.concat(F.lit('{"vol": '), F.col("vol").cast("string"), F.lit(", "), F.substring("value", 2, 1 << 30)))
    path = new_path(spark, "volume-documents")
    sinks.volume_folders(documents.withColumn("vol", F.concat((F.col("vol") % 7).cast("string"), F.lit("."), F.col("vol").cast("string"))), path)
    schema = "vol long, added_metadata struct<totalpages: int, maxcategory: string>, category_accuracy map<string, struct<pages: long, pct: double, prob: double>>, volume_accuracy struct<precision: double>, volume_metadata struct<title: string>"
    v = spark.read.text(path).select(F.from_json("value", schema).alias("v")).select("v.*").withColumn("view", F.try_element_at("category_accuracy", F.lit("view")))
    return v.select("vol", "added_metadata.totalpages", "added_metadata.maxcategory", F.col("view.pages").alias("view_pages"), F.col("view.pct").alias("view_pct"), F.col("view.prob").alias("view_prob"), "volume_accuracy.precision", "volume_metadata.title")


@query("k8_collection_folders", "WITH " + VOLUMES + ", p AS (SELECT vol, maxcategory AS category, CASE WHEN year < 1850 THEN 'early' ELSE 'late' END AS period FROM volumes) SELECT * FROM p UNION ALL SELECT DISTINCT vol, 'all', period FROM p")
def k8(spark, d):
    path = new_path(spark, "collection")
    sinks.partitioned(volumes_of(spark, d).select("vol", F.col("maxcategory").alias("category"), F.when(F.col("year") < 1850, "early").otherwise("late").alias("period")), path)
    return spark.read.parquet(path)


@query("k10_chunk_lines", "WITH " + VOL_PAGES + " SELECT vol || '|' || page || chr(9) || 'null' || chr(9) || replace(text, chr(10), ' ') AS value FROM vol_pages")
def k10(spark, d):
    path = new_path(spark, "chunk-lines")
    sinks.chunk_lines(volume_pages(spark, d).select(F.col("vol").alias("work"), F.col("page").alias("chunk"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))).write.text(path)
    return spark.read.text(path)
