"""File sinks of the data model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def features_table(features: DataFrame, path: str) -> None:
    """Page features as Parquet, one folder for each leading part of the volume ids. Structural counts of 0 go, but for ``#textlines``."""
    kept = features.where((F.col("count") > 0) | (F.col("feature") == "#textlines"))
    kept.withColumn("prefix", F.substring_index("vol", ".", 1)).write.mode("append").partitionBy("prefix").parquet(path)


def corrected_text(tokens: DataFrame) -> DataFrame:
    """``vol, page, text``: tokens of a page joined by spaces, lines by newlines; no space after an opening quote."""
    lines = tokens.groupBy("vol", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("text"))
    pages = lines.groupBy("vol", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return pages.withColumn("text", F.replace(F.col("text"), F.lit("“ "), F.lit("“")))


def probability_text(p: Column) -> Column:
    """A probability to four places, half to even, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", F.bround(p, 4)), r"(\.\d+?)0+$", "$1")


def prediction_lines(pages: DataFrame, categories: list[str]) -> DataFrame:
    """``value``: label, raw, smooth and ``category::p``, separated by tabs."""
    probs = [F.concat(F.lit(g + "::"), probability_text(F.col(f"p_{g}"))) for g in categories]
    return pages.select(F.concat_ws("\t", F.concat_ws(",", F.col("vol").cast("string"), F.col("page").cast("string")), "raw", "smooth", F.lit("begin::0.0"), F.lit("end::0.0"), *probs).alias("value"))


def prediction_json_lines(pages: DataFrame, categories: list[str], model: str = "ensemble") -> DataFrame:
    """``vol, value``: one JSON object a volume from ``pages(vol, page, raw, smooth, p_..)``: both predictions, probabilities to four places, mean largest probability and gap."""
    probs = F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"p_{g}").alias("p")) for g in categories])
    best = F.array_max(F.transform(probs, lambda x: x["p"]))
    second = F.element_at(F.array_sort(F.transform(probs, lambda x: x["p"])), -2)
    named = F.map_from_entries(F.transform(probs, lambda x: F.struct(x["g"], probability_text(x["p"]))))
    rows = pages.select("vol", F.struct("page", "raw", "smooth", named.alias("probs")).alias("row"), best.alias("best"), (best - second).alias("gap"))
    vols = rows.groupBy("vol").agg(F.array_sort(F.collect_list("row"), lambda x, y: x["page"] - y["page"]).alias("rows"), F.avg("best").alias("best"), F.avg("gap").alias("gap"))  # the pages of one volume
    return vols.select(
        "vol",
        F.to_json(
            F.struct(
                F.col("vol").cast("string").alias("volID"), F.lit(model).alias("model"), F.col("rows.probs").alias("smoothedProbabilities"), F.col("rows.raw").alias("rawPredictions"), F.col("rows.smooth").alias("smoothedPredictions"),
                F.col("best").alias("avgMaxProb"), F.col("gap").alias("avgGap"),
            )
        ).alias("value"),
    )


def prediction_metadata(wanted: DataFrame, metadata: DataFrame) -> DataFrame:
    """``value``: volume, mean largest probability and gap, separated by tabs; ``NA`` for wanted volumes without pages."""
    said = wanted.select("vol").join(metadata.select("vol", "maxprob", "gap"), "vol", "left")
    return said.select(F.concat_ws("\t", F.col("vol").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("maxprob", "gap")]).alias("value"))


def volume_statistics(before: DataFrame, after: DataFrame, english: float = 0.6) -> DataFrame:
    """``volID, totalwords, prematched, preenglish, postmatched, postenglish`` from the match rates ``(vol, tokens, matched)`` before and after correction."""
    flag = lambda c: (F.col(c) >= english).alias
    both = before.select("vol", "tokens", F.col("matched").alias("prematched")).join(after.select("vol", F.col("matched").alias("postmatched")), "vol", "left")
    return both.select(F.col("vol").alias("volID"), F.col("tokens").alias("totalwords"), "prematched", flag("prematched")("preenglish"), "postmatched", flag("postmatched")("postenglish"))


def statuses(*frames: DataFrame) -> DataFrame:
    """``vol, status``: the errors that stages have found, each once; volumes without one are not there."""
    every = reduce(DataFrame.unionByName, [f.select("vol", "status") for f in frames])
    return every.where(F.col("status").isNotNull() & ~F.col("status").isin("success", "good")).distinct()


def pagination_errors(pages: DataFrame) -> DataFrame:
    """``vol, status``: ``paginationerror`` for volumes whose page numbers are not those from 0 on."""
    own = pages.groupBy("vol").agg(F.count_distinct("page").alias("n"), F.max("page").alias("last"), F.min("page").alias("first"))
    return own.where((F.col("first") != 0) | (F.col("last") != F.col("n") - 1)).select("vol", F.lit("paginationerror").alias("status"))


def volume_json(pages: DataFrame, metadata: DataFrame | None = None, overall: DataFrame | None = None, by_category: DataFrame | None = None) -> DataFrame:
    """``vol, value``: one JSON document a volume with its page categories and counts.

    ``metadata(vol, ..)``: other columns as ``volume_metadata``. ``overall(vol, prob, precision,
    recall)``: the volume's accuracy. ``by_category(vol, category, prob, precision, recall)``: that of
    a category, with its pages and their share, under the category's name, where the volume has such pages.
    """
    counted = pages.groupBy("vol", "category").agg(F.count("*").alias("n"))
    counts = counted.groupBy("vol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("category_counts"), F.max_by("category", F.struct("n", "category")).alias("maxcategory"), F.sum("n").alias("totalpages"))
    by_page = pages.groupBy("vol").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("page", "category"))), lambda x: F.struct(x["page"].cast("string"), x["category"]))).alias("page_categories"))
    joined = by_page.join(counts, "vol")
    parts = [F.struct("category_counts", "maxcategory", "totalpages").alias("added_metadata")]
    if by_category is not None:
        own = by_category.join(counted, ["vol", "category"]).join(counts.select("vol", "totalpages"), "vol")
        accuracy = F.struct(F.round(F.col("n") / F.col("totalpages"), 2).alias("pct"), F.col("n").alias("pages"), "precision", "prob", "recall")
        joined = joined.join(own.groupBy("vol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", accuracy)))).alias("category_accuracy")), "vol", "left")
        parts.append(F.col("category_accuracy"))
    parts.append(F.col("page_categories"))
    if overall is not None:
        joined = joined.join(overall.select("vol", F.struct("precision", "prob", "recall").alias("volume_accuracy")), "vol", "left")
        parts.append(F.col("volume_accuracy"))
    if metadata is not None:
        joined = joined.join(metadata.select("vol", F.struct(*sorted(c for c in metadata.columns if c != "vol")).alias("volume_metadata")), "vol", "left")
        parts.append(F.col("volume_metadata"))
    return joined.select("vol", F.to_json(F.struct(*parts)).alias("value"))  # keys in the order of the alphabet


def volume_folders(documents: DataFrame, path: str) -> None:
    """Volume documents (``vol, value``) as lines, in folders by the part of the id before the first dot."""
    documents.select(F.substring_index(F.col("vol").cast("string"), ".", 1).alias("prefix"), "value").write.mode("append").partitionBy("prefix").text(path)


def vocabulary_lines(words: DataFrame, path: str) -> None:
    """The words of ``words(word, n)``, commonest first, equal ones by name, one a line. A vocabulary fits one file."""
    words.orderBy(F.desc("n"), "word").select("word").coalesce(1).write.text(path)


def partitioned(members: DataFrame, path: str) -> None:
    """Collection members (``vol, category, period``) in folders by category and period; every one also in ``all``."""
    both = members.unionByName(members.withColumn("category", F.lit("all")).distinct())
    both.write.mode("append").partitionBy("category", "period").parquet(path)


def metadata_tsv(rows: DataFrame, path: str) -> None:
    """Rows appended to a table of tab-separated lines: one header for the whole table, in a folder beside the lines.

    The first append writes the header; later ones must have the same columns in the same order. Tabs and
    line ends inside values become spaces; nulls are empty.
    """
    header = "\t".join(rows.columns)
    spark = rows.sparkSession
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("ignore").text(f"{path}/header")
    there = [r.value for r in spark.read.text(f"{path}/header").collect()]
    if there != [header]:
        raise ValueError(f"the table has the columns {there}, not {header!r}")
    flat = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in rows.columns]
    rows.select(F.concat_ws("\t", *flat).alias("value")).write.mode("append").text(f"{path}/lines")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """``value``: work and chunk, ``null``, text, separated by tabs."""
    return chunks.select(F.concat_ws("\t", F.concat_ws("|", "work", F.col("chunk").cast("string")), F.lit("null"), "text").alias("value"))
