"""File sources of the data model. Every reader takes paths and gives a DataFrame with a fixed schema."""

from __future__ import annotations

import io

import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _volume(suffix: str) -> Column:
    """The volume of a file: its name without ``suffix``; or, where ``suffix`` is a column's name and ``=``, the value of its folder."""
    if suffix.endswith("="):
        return F.regexp_extract(F.col("_metadata.file_path"), f"/{suffix}([^/]*)/[^/]*$", 1)
    return F.regexp_replace(F.col("_metadata.file_name"), suffix.replace(".", r"\.") + "$", "")


def page_features(spark: SparkSession, path: str, suffix: str = ".pg.tsv") -> tuple[DataFrame, DataFrame]:
    """``features(vol, page, feature, count)`` from tab-separated files named after volumes, and the rows of another width."""
    raw = spark.read.text(path).select(_volume(suffix).alias("vol"), F.split("value", "\t").alias("f"), "value")
    good = (F.size("f") == 3) & F.get("f", F.lit(0)).rlike(r"^-?\d+$") & F.get("f", F.lit(2)).rlike(r"^\d+$")
    rows = raw.where(good).select("vol", F.get("f", F.lit(0)).cast("int").alias("page"), F.get("f", F.lit(1)).alias("feature"), F.get("f", F.lit(2)).cast("int").alias("count"))
    return rows, raw.where(~good).select("vol", "value")


def paged_text(spark: SparkSession, path: str, keep_last: bool = True, suffix: str = ".txt", drop_divs: bool = False) -> DataFrame:
    """``vol, page, line, text``: pages end at lines that begin with ``<pb>``; bz2 files are read as they are.

    ``keep_last`` says whether a last page without end mark counts; ``drop_divs`` leaves out division
    markup and trims lines. Files that are not in UTF-8 are left out; ``unreadable_text`` names them.
    """
    whole = spark.read.text(path, wholetext=True).where(~_broken(F.col("value"))).select(_volume(suffix).alias("vol"), F.split("value", r"(?m)^<pb>.*(?:\r?\n|$)").alias("pages"))
    pages = whole.withColumn("pages", F.when(F.lit(keep_last), F.col("pages")).otherwise(F.slice("pages", 1, F.size("pages") - 1)))
    lines = pages.select("vol", F.posexplode("pages").alias("page", "body")).select("vol", "page", F.posexplode(F.split(F.regexp_replace("body", r"\r?\n$", ""), r"\r?\n")).alias("line", "text"))
    if drop_divs:
        lines = lines.where(~F.trim("text").startswith("<div") & ~F.trim("text").startswith("</div")).withColumn("text", F.trim("text"))
    return lines


def _broken(text: Column) -> Column:
    return ~F.is_valid_utf8(text)


def unreadable_text(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """``vol, status`` of the text files that are not in UTF-8: ``unicode error``."""
    return spark.read.text(path, wholetext=True).where(_broken(F.col("value"))).select(_volume(suffix).alias("vol"), F.lit("unicode error").alias("status"))


def zipped_volumes(spark: SparkSession, path: str) -> DataFrame:
    """``vol, page, line, text, status`` of zip files with one member a page, named ``.._<code>.txt``; pages in order of code."""
    return unzipped(spark.read.format("binaryFile").load(path).select("path", "content"))


def unzipped(archives: DataFrame) -> DataFrame:
    """The same from ``archives(path, content)``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                vol, rows = name.rsplit("/", 1)[-1].removesuffix(".zip"), []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = []
                        for m in z.namelist():
                            leaf = m.rsplit("/", 1)[-1]
                            code = leaf.removesuffix(".txt").rsplit("_", 1)[-1]
                            if leaf and "_Store" not in m and not leaf.startswith("_") and code.isdigit():
                                members.append((int(code), m))
                        for page, (_, m) in enumerate(sorted(members)):
                            rows += [(vol, page, i, t, "success") for i, t in enumerate(z.read(m).decode().splitlines())]
                except UnicodeDecodeError:
                    rows = [(vol, None, None, None, "unicode error")]
                except zipfile.BadZipFile:
                    rows = [(vol, None, None, None, "missing")]
                yield pd.DataFrame(rows, columns=["vol", "page", "line", "text", "status"])

    return archives.mapInPandas(read, "vol string, page int, line int, text string, status string")


def archived_json(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, value`` for every regular file of tar.gz archives; one task an archive."""
    return untarred(spark.read.format("binaryFile").load(path).select("path", "content"))


def untarred(archives: DataFrame) -> DataFrame:
    """The same from ``archives(path, content)``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
                    yield pd.DataFrame([(name, m.name, t.extractfile(m).read().decode(errors="replace")) for m in t if m.isfile()], columns=["archive", "member", "value"])

    return archives.mapInPandas(read, "archive string, member string, value string")


def extracted_features(spark: SparkSession, path: str) -> DataFrame:
    """``vol, page, status, tokens`` from one JSON (or JSON.bz2) object a volume with ``features.pages[]``."""
    schema = "id string, features struct<pages: array<struct<seq: string, tokenCount: long>>>, _corrupt_record string"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    status = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.col("features.pages").isNull(), "no pages").otherwise("success")
    return raw.select("id", status.alias("status"), F.posexplode_outer("features.pages").alias("page", "p")).select(F.col("id").alias("vol"), "page", "status", F.col("p.tokenCount").alias("tokens"))


def category_maps(spark: SparkSession, path: str, suffix: str = ".map") -> DataFrame:
    """``vol, page, category``; rows of another width are left out."""
    raw = spark.read.text(path).select(_volume(suffix).alias("vol"), F.split("value", "\t").alias("f")).where((F.size("f") == 2) & F.get("f", F.lit(0)).rlike(r"^\d+$"))
    return raw.select("vol", F.get("f", F.lit(0)).cast("int").alias("page"), F.get("f", F.lit(1)).alias("category"))


def prediction_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``vol, page, raw, smooth, probs``: the label, two categories, and ``category::p`` from the fifth column on, after the sentinels."""
    f = F.split("value", "\t")
    label = F.get(f, F.lit(0))
    probs = F.map_from_entries(F.transform(F.slice(f, 6, 1000), lambda x: F.struct(F.substring_index(x, "::", 1), F.substring_index(x, "::", -1).cast("double"))))
    return spark.read.text(path).select(F.regexp_replace(label, ",[^,]*$", "").alias("vol"), F.substring_index(label, ",", -1).cast("int").alias("page"), F.get(f, F.lit(1)).alias("raw"), F.get(f, F.lit(2)).alias("smooth"), probs.alias("probs"))


def prediction_json(spark: SparkSession, path: str, model: str = "ensemble") -> DataFrame:
    """``vol, page, raw, smooth``: one JSON line a model."""
    schema = "volID string, model string, rawPredictions array<string>, smoothedPredictions array<string>, avgMaxProb double, avgGap double"
    rows = spark.read.schema(schema).json(path).where(F.col("model") == model)
    both = F.arrays_zip("rawPredictions", "smoothedPredictions")
    return rows.select(F.col("volID").alias("vol"), F.posexplode(both).alias("page", "b")).select("vol", "page", F.col("b.rawPredictions").alias("raw"), F.col("b.smoothedPredictions").alias("smooth"))


def _named(fields: DataFrame, header: list[str]) -> DataFrame:
    """Columns of ``fields(f)`` by the header; the narrowest row sets the width."""
    least = fields.agg(F.min(F.size("f"))).first()[0]
    width = len(header) if least is None else min(least, len(header))
    return fields.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(header[i]) for i in range(width)])


def tolerant_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All-string columns by the header; the narrowest line sets the width, missing fields are empty."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    header = lines.first()["f"]
    return _named(lines.where(F.array_join("f", "\t") != "\t".join(header)), header)


def appended_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``sinks.metadata_tsv`` appended to: all lines of all appends under its one header."""
    header = spark.read.text(f"{path}/header").first().value.split("\t")
    return _named(spark.read.text(f"{path}/lines").select(F.split("value", "\t").alias("f")), header)


def metadata_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def marc_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` elements with all-string fields, so that tags keep their zeros."""
    schema = "leader string, controlfield array<struct<_VALUE: string, _tag: string>>, datafield array<struct<_tag: string, subfield: array<struct<_VALUE: string, _code: string>>>>"
    return spark.read.format("xml").option("rowTag", "record").schema(schema).load(path)


def work_list(spark: SparkSession, path: str) -> DataFrame:
    """``work, seq, vol`` of a JSON object ``{work: [vol, ..]}`` or a list of volumes, each then its own work."""
    raw = spark.read.text(path, wholetext=True)
    as_map = raw.where(F.trim("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("work", "vols")).select("work", F.posexplode("vols").alias("seq", "vol"))
    as_list = raw.where(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", "array<string>")).alias("vol")).select(F.col("vol").alias("work"), F.lit(0).alias("seq"), "vol")
    return as_map.unionByName(as_list)


def range_labels(spark: SparkSession, path: str) -> DataFrame:
    """``vol, page, probability``: page ranges under a header of ``%`` and ``@`` lines, expanded to pages."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(%|@|$)")).select(F.from_csv("value", "htid string, startpg int, endpg int, startpart string, endpart string, probability double").alias("r"))
    return rows.select(F.regexp_replace("r.htid", "^['\"]|['\"]$", "").alias("vol"), F.explode(F.sequence("r.startpg", "r.endpg")).alias("page"), F.col("r.probability").alias("probability"))


def word_counts_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vol string, page int, count int").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def vocabulary(spark: SparkSession, path: str, first: int = 5000) -> DataFrame:
    """``idx, word, duplicate`` of the first lines of a vocabulary file, which fits one task."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.slice(F.split(F.trim("value"), r"\r?\n"), 1, first)).alias("idx", "word"))
    from pyspark.sql import Window

    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy("word").orderBy("idx")) > 1)


def rule_table(spark: SparkSession, path: str, columns: list[str], lower: bool = False) -> DataFrame:
    """A small table of rules from a tab-separated file without header; mixed line ends."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r\n|\r|\n")).alias("value")).where("value <> ''").select(F.split("value", "\t").alias("f"))
    field = lambda i: F.lower(F.get("f", F.lit(i))) if lower else F.get("f", F.lit(i))
    return rows.select(*[field(i).alias(c) for i, c in enumerate(columns)])


def hyphen_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``rules(source, target)``: all hyphen rules, and the words that they add to the lexicon.

    A target without space is a word. One with a space also holds for the source without its hyphens,
    and so does any target for a hyphenated source whose letters differ from its own, unless that form
    has a rule already.
    """
    r = rules.select(F.rtrim("source").alias("source"), F.rtrim("target").alias("target"))
    bare, spaced = F.replace("source", F.lit("-"), F.lit("")), F.col("target").contains(" ")
    letters = F.translate("target", " -", "")
    derived = r.where(spaced).select(bare.alias("source"), "target", F.lit(1).alias("rank"))
    doubtful = r.where(F.col("source").contains("-") & (bare != letters)).select(bare.alias("source"), "target", F.lit(2).alias("rank"))
    every = r.withColumn("rank", F.lit(0)).unionByName(derived).unionByName(doubtful)
    return every.groupBy("source").agg(F.min(F.struct("rank", "target")).alias("t")).select("source", "t.target"), r.where(~spaced).select(F.col("target").alias("word")).distinct()


def fusing_rules(rules: DataFrame) -> DataFrame:
    """``first, second, fused`` of rules whose source is two words."""
    words = F.split(F.rtrim("source"), " ")
    return rules.where(F.size(words) == 2).select(F.get(words, F.lit(0)).alias("first"), F.get(words, F.lit(1)).alias("second"), F.rtrim("target").alias("fused"))


def volume_documents(spark: SparkSession, values: DataFrame) -> DataFrame:
    """Parsed volume documents of JSON strings in ``value``."""
    return values.select(F.from_json("value", "page_categories map<string,string>, added_metadata struct<totalpages: int, maxcategory: string>").alias("d")).select("d.*")
