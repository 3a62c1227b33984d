"""Frames of the engine's data model made from the given tables.

Documents are pages: a volume is a source's documents of one thousand ids, so volumes stay small
however many rows a source has, and no window is needed to number pages. Events are page sequences:
one volume for each user, pages in the order of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The categories of the event sequences, in order of their index.
CATEGORIES = ["click", "error", "signup", "purchase", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows that come in fewer partitions than there are cores, dealt over all of them; others as they are.

    A small file of one row group is one task whatever the cores; work on long texts is worth the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def volume_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vol, page, doc_id, lang, text``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).where(F.col("source").isNotNull() & F.col("text").isNotNull())
    return docs.select(
        F.concat_ws(".", "source", F.expr("doc_id div 1000")).alias("vol"), (F.col("doc_id") % 1000).cast("int").alias("page"), "doc_id", "lang", "text"
    )


def volume_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vol, page, line, text``: the lines of every page, numbered from 0."""
    pages = volume_pages(spark, sf_dir)
    return pages.select("vol", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vol, page, category, words, event_id``: a user's events in the order of time."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("vol"), (F.row_number().over(w) - 1).alias("page"), F.col("event_type").alias("category"), F.col("value").alias("words"), "event_id"
    )


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_pages`` with ``truth`` (the next page's category where event_id % 7 = 0) and a probability for each category.

    The probabilities come from md5 of id and category, and sum to 1.
    """
    w = Window.partitionBy("vol").orderBy("page")
    pages = event_pages(spark, sf_dir).withColumn(
        "truth", F.when(F.col("event_id") % 7 == 0, F.coalesce(F.lead("category").over(w), F.col("category"))).otherwise(F.col("category"))
    )
    hashed = lambda g: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.lit(g))), 1, 7), 16, 10).cast("long")
    weight = lambda g: (hashed(g) % 1000 + 1 + F.when(F.col("category") == g, 1000).otherwise(0)).cast("double")
    total = sum(weight(g) for g in CATEGORIES)
    return pages.select("*", *[(weight(g) / total).alias(f"p_{g}") for g in CATEGORIES])


def event_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions in long form: ``vol, page, idx, category, p``."""
    wide = event_predictions(spark, sf_dir)
    items = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(g).alias("category"), F.col(f"p_{g}").alias("p")) for i, g in enumerate(CATEGORIES)])
    return wide.select("vol", "page", F.inline(items))
