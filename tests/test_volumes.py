"""What is read volume by volume: neighbours of tokens, counted words, files of volumes."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import lines as L
from leafmill.operators import vectors as V
from leafmill.plans import page_queries, repair_queries, store_queries

LINES = "vol string, page int, line int, text string"
ODD = ["", "a, b,c", "<pb>", "x,,y: z", "f", "g—h  i_j", "  ", "k\tl ,m", "n -- o", "1,2,3", "”p;q", "r,", ",s ,,,t"]


def odd_lines(spark):
    rng = random.Random(4)
    return spark.createDataFrame([("vw"[p % 2], p, i, rng.choice(ODD) + rng.choice([" ", ""]) + rng.choice(ODD)) for p in range(30) for i in range(rng.randrange(1, 6))], LINES)


def test_neighbours_are_found_by_a_window_over_lines(spark):
    got = L.neighboured_tokens(odd_lines(spark))
    w = Window.partitionBy("vol").orderBy("page", "line", "pos")
    want = L.tokens(odd_lines(spark)).withColumn("before", F.lag("token").over(w)).withColumn("after", F.lead("token").over(w))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")


def test_tokens_counted_by_words_between_spaces_are_those_of_the_lines(spark):
    want = L.tokens(odd_lines(spark)).groupBy("token").agg(F.count("*").alias("n"))
    assert sorted(map(str, L.token_counts(odd_lines(spark)).collect())) == sorted(map(str, want.collect()))


def test_shares_of_words_shuffle_texts_only(spark):
    shares = V.relative_frequencies(page_queries.word_features_of(spark, "/root/testdata/sf0.001")).groupBy("vol", "feature").agg(F.sum("share"))
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(vol" in plan


def test_files_of_small_volumes_are_written_by_many_tasks(spark):
    rows = spark.range(400).select(F.col("id").alias("vol"), F.lit("a").alias("value"))
    path = store_queries.in_folders(spark, rows, "many-volumes")
    names = [r.f for r in spark.read.text(path).select(F.col("_metadata.file_name").alias("f")).collect()]
    assert len(names) == 400 and len({n.split("-")[1] for n in names}) > spark.sparkContext.defaultParallelism


def test_words_are_broken_once_each(spark):
    plan = repair_queries.l25_segments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5") < plan.index("Aggregate [w#")  # the distinct words are below


def odd_pages(spark):
    rng = random.Random(5)
    odd = [*ODD, "McX DON'T", "<pb n=1>", " <a> ", "<a> b", "ÀB Ǆ ǅ x\u2028Y\rZ", "#lines"]
    rows = [("vwx"[p % 3], p % 17, "abc"[p % 3], "\n".join(rng.choice(odd) + rng.choice([" ", ""]) + rng.choice(odd) for _ in range(rng.randrange(1, 9)))) for p in range(60)]
    rows += [("y", 0, "a", "one two"), ("y", 1, "b", " <a>\n<b> "), ("y", 2, None, "x X")]
    return spark.createDataFrame(rows, "vol string, page int, category string, text string")


def test_words_counted_where_pages_are_read_are_those_of_the_lines(spark):
    pages = odd_pages(spark)
    lines = pages.select("vol", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    tokens = L.word_counts(L.tokens(lines), with_caps=True)
    want = tokens.select("vol", "page", "word", "n").unionByName(tokens.groupBy("vol", "page").agg(F.lit("# caps").alias("word"), F.sum("caps").alias("n")))
    keys = L.page_keys(pages)
    got = L.counted_words(L.whole_pages(pages, keys, "category"), caps_as="# caps").drop("rows")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    lined = lines.where("NOT (startswith(trim(text), '<') AND endswith(trim(text), '>'))").select("vol", "page").distinct()
    assert sorted(keys.where("lined").select("vol", "page").collect()) == sorted(lined.collect())


def test_vocabulary_of_pages_is_that_of_their_features(spark):
    pages = odd_pages(spark)
    lines = pages.select("vol", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    words = L.word_counts(L.tokens(lines)).select("vol", "page", F.col("word").alias("feature"), F.col("n").alias("count"))
    features = words.unionByName(L.structure_counts(lines).select("vol", "page", F.lit("#textlines").alias("feature"), F.col("textlines").alias("count")))
    want = V.select_vocabulary(features, pages.select("vol", "page", "category"), per_category=9, total=12, cap=2)
    got = V.select_page_vocabulary(pages, per_category=9, total=12, cap=2)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_selected_vocabulary_shuffles_no_counts_of_pages(spark):
    got = page_queries.v14(spark, "/root/testdata/sf0.001")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(vol" not in plan.split("Initial Plan")[0] and "hashpartitioning(word" in plan


def test_folded_words_are_those_of_all_features_together(spark):
    words = L.counted_words(L.whole_pages(odd_pages(spark), L.page_keys(odd_pages(spark))), caps_as="#allcapswords")
    structural = spark.createDataFrame([("v", 0, "#lines", 3), ("v", 1, "#lines", 2), ("y", 0, "#commas", 1)], "vol string, page int, feature string, count long")
    known = words.where("NOT startswith(word, '#')").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 12").select("word")
    want = V.fold_vocabulary(V.word_features(words).unionByName(structural), known)
    got = V.fold_page_words(words, structural, known)
    columns = ["vol", "page", "feature", "count"]
    assert known.count() > 0 and sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_known_words_are_not_shuffled_to_be_folded(spark):
    got = page_queries.v2(spark, "/root/testdata/sf0.001")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(feature" not in plan
