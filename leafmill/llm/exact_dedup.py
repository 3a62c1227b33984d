"""Exact dedup through an extendible-hash index on shared files. DataFrame functions only.

Keys are 64-bit hashes of the normalised text. A bucket is named by a number of leading bits, its local
depth. The directory starts from as many buckets as the keys need at least and doubles while a bucket
holds more than ``bucket_capacity`` keys, which splits that bucket only. All of this runs on the table of
keys; the driver holds no more than the list of local depths.

Every row is routed by the directory to its bucket. A bucket, that is a range of keys, has one owner task,
which goes through the bucket's texts in the order of their keys: where the key is that of the text before,
both are compared by their bytes, and a different text becomes the next entry of the key's chain. The
entries are written as index files sorted by bucket and key, so that one file is one key range. A row is
looked up by bucket and key and takes the entry of its chain whose 256-bit digest of the text is its own.

Hot groups: the rows that one map task has of a text are combined before they are sent, so a group of any
size reaches its owner as one row for each map task; the look-up joins files, so adaptive execution may
split a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import new_path, written

WHITE = r"[\x20\x09-\x0D]+"
BROADCAST_BUCKETS = 1_000_000  # of 20 bytes each


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def prefix(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """``depth, bits, keys``: the buckets of the distinct ``key`` values, each with at most ``capacity`` of them.

    Buckets that hold no key have no row. No keys: no buckets.
    """
    depth, rows = max(0, (keys.count() // capacity).bit_length() - 1), []
    open_ = keys
    while True:
        counts = written(open_.groupBy(prefix(F.col("key"), depth).alias("bits")).agg(F.count("*").alias("keys")), "dedup-buckets")
        fits = F.col("keys") <= capacity if depth < 64 else F.lit(True)
        rows.append(counts.where(fits).select(F.lit(depth).alias("depth"), "bits", "keys"))
        full = counts.where(~fits).select("bits")
        if full.isEmpty():
            return written(reduce(DataFrame.unionByName, rows), "dedup-directory")
        open_ = open_.join(full.withColumnRenamed("bits", "bits_"), prefix(F.col("key"), depth) == F.col("bits_"), "left_semi")
        depth += 1


def routed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` with ``bucket`` ("depth:bits") of their ``key`` added.

    The slots of the directory are the prefixes of the smallest depth; a slot lists the buckets below it,
    one or a few, as keys are hashes. So a row is joined once, whatever the depths.
    """
    small = buckets.count() <= BROADCAST_BUCKETS
    base = buckets.agg(F.min("depth")).first()[0]
    if not base:  # no bucket, or one with all keys, or keys of which most share their first bits
        base = 0
    under = buckets.groupBy(F.expr(f"shiftrightunsigned(bits, depth - {base})").alias("slot")).agg(F.collect_list(F.struct("depth", "bits")).alias("under"))
    rows = rows.join(F.broadcast(under) if small else under, prefix(F.col("key"), base) == F.col("slot"), "left")
    own = F.filter("under", lambda b: (b["depth"] == 0) | (F.call_function("shiftrightunsigned", F.col("key"), 64 - b["depth"]) == b["bits"]))
    return rows.withColumn("bucket", F.get(F.transform(own, lambda b: F.concat_ws(":", b["depth"].cast("string"), b["bits"].cast("string"))), F.lit(0))).drop("slot", "under")


def build_index(docs: DataFrame, buckets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The entries ``bucket, key, sha, keep_id, group_size, owner``, read from index files sorted by bucket and key.

    ``owner`` is the task that decided; the map tasks only combine what they have themselves.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.spark_partition_id().alias("task")).withColumn("key", F.xxhash64("norm"))
    combined = routed(rows, buckets).groupBy("task", "bucket", "key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    chain, entry = Window.partitionBy("bucket").orderBy("key", "norm"), Window.partitionBy("bucket", "entry")
    same = (F.lag("key").over(chain) == F.col("key")) & (F.lag("norm").over(chain) == F.col("norm"))
    numbered = combined.select("*", F.coalesce(~same, F.lit(True)).alias("opens")).withColumn("entry", F.sum(F.col("opens").cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    decided = numbered.withColumns({"keep": F.min("keep_id").over(entry), "size": F.sum("group_size").over(entry), "owner": F.spark_partition_id()}).where("opens")
    entries = written(decided.select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "owner"), "dedup-entries")
    path = new_path(docs.sparkSession, "dedup-index")
    entries.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.parquet(path)
    return docs.sparkSession.read.schema(entries.schema).parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 512) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, bucket``.

    Rows are equal when their normalised texts are identical. ``keep_id`` is the smallest id of the
    group. Null texts count as empty and so form one group with empty ones. Texts of any length are
    compared whole. Rows that repeat an id with an equal text share its decision; a null id is never
    the one that stays unless the whole group has null ids. Other columns of ``docs`` are ignored,
    whatever their names. An empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    staged = written(keyed.select("doc_id", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-rows")
    buckets = directory(written(staged.select("key").distinct(), "dedup-keys"), bucket_capacity)
    return look_up(routed(staged, buckets), build_index(docs, buckets, id_col, text_col))


def look_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows ``doc_id, bucket, key, sha`` with the decision of their entry in the chain of ``bucket`` and ``key``."""
    return rows.join(index, ["bucket", "key", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket"
    )
