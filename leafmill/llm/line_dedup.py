"""Line dedup by a log-template tree. DataFrame functions only.

A line goes down a tree of fixed depth: the first level is its token count, the next levels are its
leading tokens, in which a token that holds a digit is a variable field (``<*>``). In a leaf it is
counted how many different lines have a token at its place. The tokens that every line of a template has
are more frequent there than the values of its fields, however often these recur, so a line is generalised
by its rarest tokens: as it is, without the rarest one, the two rarest, and so on, as long as its constant tokens are
at least ``min_constants`` and ``similarity`` percent of all. Each step is a candidate template, and one
that a different line has too is a template. More lines of a template make its constants more frequent
still, so they never hide it. A line with too few constants is its own template, all tokens kept. A
template that recurs across documents is dropped from all of them but the one with the smallest id, so
that each passage stays in the corpus once.

Lines of a leaf are never paired: tokens are counted at their places, and a candidate is named by the
hashes of the tokens left, from which the rarest are taken one after the other. Only leaves with two
different lines are looked at, all others need no more than 128-bit digests of their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import written

BLANKS = r"[ \t\r\f\x0B]+"
FIELD = "<*>"
BROADCAST_LEAVES, BROADCAST_LINES, BROADCAST_TOKENS = 1_000_000, 250_000, 1_000_000  # tokens: of 16 bytes


def flattened(text: Column) -> Column:
    """Each run of blanks inside a line as one space; texts that have only single spaces pass untouched."""
    odd = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\f") | text.contains("\x0b")
    return F.when(odd, F.regexp_replace(text, BLANKS, " ")).otherwise(text)


def _masked(flat: Column) -> Column:
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(flat)


def _size(flat: Column) -> Column:
    return F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit(""))) + 1


def _checked(small: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if it has at most ``most`` rows (of under 100 bytes each)."""
    return F.broadcast(small) if small.count() <= most else small


def _digest(template: Column) -> Column:
    return F.unhex(F.md5(template))


def _marks(positions: str) -> Column:
    """A byte for each place up to the last of a sorted array column: ``1`` at those of the array, so that looking one up takes no search."""
    before = F.concat(F.array(F.lit(-1)), F.slice(positions, 1, F.size(positions) - 1))
    return F.array_join(F.zip_with(positions, before, lambda p, q: F.concat(F.repeat(F.lit("0"), p - q - 1), F.lit("1"))), "").cast("binary")


def _marked(marks: str, at: Column) -> Column:
    return F.substring(F.col(marks), at + 1, 1) == F.lit(b"1")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_constants: int = 5, similarity: int = 80, min_docs: int = 2, lines_col: str = "n_lines", dropped_col: str = "n_dropped"
) -> DataFrame:
    """``docs`` with recurring lines removed from ``text_col``, and ``lines_col``, ``dropped_col`` (long) added.

    Lines are what newlines separate. A template recurs when at least ``min_docs`` distinct ids have
    it; a line goes when one of its templates recurs and an earlier document has that. Blank lines have no template and always stay; short lines have one like any other. Texts of
    rows with a null id stay as they are and count for no template; rows that repeat an id count once,
    and each of them keeps or loses its lines. A line that one text repeats stays or goes everywhere in
    it. A null text stays null with 0 lines. Texts of any length are taken whole, in time linear in
    their lines. An empty table gives an empty result. Columns of ``docs`` named like the added ones
    are replaced; pass other names to keep them.
    """
    docs = docs.drop(lines_col, dropped_col)
    doc, text = F.col(id_col).alias("_doc"), F.col(text_col)
    ided = docs.where(F.col(id_col).isNotNull() & text.isNotNull())
    lines = ided.select(doc, F.xxhash64(text).alias("_row"), F.posexplode(F.split(flattened(text), "\n")).alias("_at", "_line")).select("_doc", "_row", "_at", F.trim("_line").alias("_flat")).where(F.col("_flat") != "")
    parsed = lines.select("_doc", "_row", "_at", "_flat", _masked(F.col("_flat")).alias("_masked"), _size(F.col("_flat")).alias("_n"))
    fields = F.when(F.col("_masked").contains(FIELD), F.size(F.filter(F.split("_masked", " "), lambda t: t == FIELD))).otherwise(0)
    enough = lambda c: (c >= min_constants) & (100 * c >= similarity * F.col("_n"))
    leaf = F.concat_ws(" ", F.col("_n").cast("string"), F.substring_index("_masked", " ", depth))
    parsed = parsed.select("_doc", "_row", "_at", "_flat", "_masked", "_n", F.when(enough(F.col("_n") - fields), leaf).alias("_leaf"))
    line = F.when(F.col("_leaf").isNotNull(), F.col("_masked")).otherwise(F.concat(F.lit("\n"), F.col("_flat")))
    postings = written(parsed.select("_doc", "_row", "_at", F.xxhash64("_leaf").alias("_branch"), F.col("_leaf").isNotNull().alias("_in_leaf"), F.xxhash64("_masked").alias("_hash"), _digest(line).alias("_own")), "line-postings")

    # Leaves in which different lines meet, and their lines, once each.
    shared = postings.where("_in_leaf").groupBy("_branch").agg(F.min("_hash").alias("_a"), F.max("_hash").alias("_b")).where(F.col("_a") != F.col("_b")).select("_branch")
    shared = written(shared, "line-leaves")
    met = parsed.where(F.col("_leaf").isNotNull()).withColumn("_branch", F.xxhash64("_leaf")).join(_checked(shared, BROADCAST_LEAVES), "_branch", "left_semi")
    least = F.greatest(F.lit(min_constants), F.ceil(F.lit(similarity) * F.col("_n") / 100).cast("int"))
    met = met.groupBy("_branch", "_masked", "_n").agg(F.lit(1).alias("_one")).withColumn("_spare", (F.col("_n") - fields - least).cast("int")).drop("_one")
    met = written(met.withColumn("_line", F.monotonically_increasing_id()), "line-variants")
    # How many lines of the leaf have a token at its place; the leaf's leading tokens are those of all.
    def places(of: DataFrame, *more: str) -> DataFrame:
        each = of.select("_line", "_branch", *more, F.posexplode(F.split("_masked", " ")).alias("_pos", "_token")).where((F.col("_pos") >= depth) & (F.col("_token") != FIELD))
        return each.select("_line", "_pos", *more, F.xxhash64("_branch", "_pos", "_token").alias("_x"))

    # Tokens that all lines of the leaf have are never the rarest; of those that some lack, one that is alone names its line.
    leaves = written(met.groupBy("_branch").agg(F.count("*").cast("int").alias("_m")), "line-leaf-sizes")
    sized = met.join(_checked(leaves, BROADCAST_LEAVES), "_branch")
    support = places(sized, "_m").groupBy("_x").agg(F.count("*").cast("int").alias("_c"), F.min("_line").alias("_line"), F.max("_m").alias("_m")).where("_c < _m")
    support = written(support.select("_x", "_c", F.when(F.col("_c") == 1, F.col("_line")).alias("_line")), "line-support")
    # What is left of a line must be met elsewhere, so no token that is alone may stay.
    alone = support.where("_c = 1").groupBy("_line").agg(F.count("*").cast("int").alias("_alone"))
    open_ = met.join(alone, "_line", "left").withColumn("_alone", F.coalesce("_alone", F.lit(0))).where("_alone <= _spare")
    open_ = written(open_.select("_line", "_branch", "_masked", "_spare", "_alone"), "line-candidates")
    some = written(support.where("_c > 1").select("_x", "_c"), "line-shared-tokens")
    each = places(open_).join(_checked(some, BROADCAST_TOKENS), "_x").select("_line", "_c", "_pos", "_x")
    each = each.unionByName(support.where("_c = 1").join(open_.select("_line"), "_line", "left_semi").select("_line", "_c", F.lit(-1).alias("_pos"), "_x"))
    by_line = each.groupBy("_line").agg(F.sort_array(F.collect_list(F.struct(F.col("_c").alias("c"), F.col("_pos").alias("pos"), F.col("_x").alias("x")))).alias("_all"))  # at most the tokens of one line
    # The line as it is and without its one, two, ... rarest tokens. A set of tokens is named by two hashes, each the exclusive or of theirs.
    both = lambda acc, t: F.struct(acc["x"].bitwiseXOR(t["x"]).alias("x"), acc["y"].bitwiseXOR(F.xxhash64(t["x"])).alias("y"))
    tokens = F.filter(F.transform(F.split("_masked", " "), lambda t, i: F.when((i >= depth) & (t != FIELD), F.struct(F.xxhash64("_branch", i, t).alias("x")))), lambda t: t.isNotNull())
    whole = F.aggregate(tokens, F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")), both)
    keys = F.aggregate(F.slice("_all", 1, F.col("_spare")), F.array(whole), lambda acc, t: F.concat(acc, F.array(both(F.element_at(acc, -1), t))))
    listed = open_.join(by_line, "_line", "left").withColumn("_all", F.coalesce("_all", F.expr("CAST(array() AS array<struct<c:int,pos:int,x:bigint>>)")))
    general = listed.select("_line", "_branch", "_alone", F.posexplode(keys).alias("_j", "_key")).where("_j >= _alone")
    general = written(general.select("_line", F.unhex(F.md5(F.concat_ws(":", "_branch", "_key.x", "_key.y"))).alias("_general")), "line-steps")
    met_twice = general.groupBy("_general").agg(F.count("*").alias("_c")).where("_c > 1").select("_general")
    general = general.join(met_twice, "_general").join(open_.select("_line", _digest(F.col("_masked")).alias("_own")), "_line").select("_own", "_general")
    general = written(general, "line-general")
    steps = postings.where("_in_leaf").join(_checked(general, BROADCAST_LINES), "_own").select("_doc", "_row", "_at", F.col("_general").alias("_template"))
    placed = postings.select("_doc", "_row", "_at", F.col("_own").alias("_template")).unionByName(written(steps, "line-placed"))

    by_doc = placed.groupBy("_template", "_doc").agg(F.lit(1).alias("_one"))
    recurring = by_doc.groupBy("_template").agg(F.count("*").alias("_n"), F.min("_doc").alias("_home")).where(F.col("_n") >= min_docs)
    recurring = written(recurring.select("_template", "_home"), "line-templates")

    # Both sides are read from files, so the join may split a template that very many documents share.
    hits = placed.join(_checked(recurring, BROADCAST_LINES), "_template").where(F.col("_doc") != F.col("_home"))
    dropped = hits.groupBy("_doc", "_row").agg(F.sort_array(F.collect_set("_at")).alias("_dropped"))  # at most the lines of one text
    dropped = dropped.select("_doc", "_row", F.size("_dropped").alias("_n"), _marks("_dropped").alias("_gone"))

    kept = docs.join(dropped, (F.col(id_col) == F.col("_doc")) & (F.xxhash64(text) == F.col("_row")), "left")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~_marked("_gone", i)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return kept.select(
        *[F.when(F.col("_gone").isNull(), text).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        n_lines.cast("long").alias(lines_col),
        F.coalesce("_n", F.lit(0)).cast("long").alias(dropped_col),
    )
