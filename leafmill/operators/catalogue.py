"""Bibliographic metadata and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags by the letters of the contents, form and biography bytes of a fixed field.
CONTENT_TAGS = {
    "b": "Bibliographies", "c": "Catalog", "d": "Dictionary", "e": "Encyclopedia", "f": "Handbooks", "g": "Legal articles", "i": "Indexes",
    "l": "Legislation", "r": "Directories", "s": "Statistics", "v": "Legal cases", "5": "Calendars",
}
FORM_TAGS = {
    "0": "NotFiction", "1": "Fiction", "d": "Drama", "e": "Essays", "f": "Novel", "h": "Humor", "i": "Letters", "j": "Short stories", "m": "Mixed",
    "p": "Poetry", "s": "Speeches",
}
BIOGRAPHY_TAGS = {"b": "Biography", "c": "Biography", "a": "Autobiography", "#": "NotBiographical", "d": "ContainsBiogMaterial"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


def fixed_field(field: Column) -> Column:
    """A struct of date type, both dates, place and tags of a 40-byte fixed field."""
    at = lambda i, n=1: F.substring(field, i + 1, n)
    contents = at(24, 4)
    tags = F.array(
        F.when(at(22).isin("b", "c", "d", "j"), "Juvenile audience"),
        *[F.when(contents.contains(k), t) for k, t in CONTENT_TAGS.items()],
        F.coalesce(_lookup(FORM_TAGS, at(33)), F.lit("UnknownCategory")),
        _lookup(BIOGRAPHY_TAGS, at(34)),
    )
    return F.struct(at(6).alias("datetype"), at(7, 4).alias("date1"), at(11, 4).alias("date2"), at(15, 3).alias("place"), F.array_sort(F.array_compact(tags)).alias("tags"))


def material_type(leader: Column) -> Column:
    kind, part = F.substring(leader, 8, 1), F.substring(leader, 20, 1)
    return (
        F.when(kind.isin("a", "c", "d"), "monograph part(s)").when(kind == "b", "serial part").when(kind == "i", "serial integration")
        .when((kind == "m") & (part == "a"), "monograph set").when((kind == "m") & part.isin("b", "c"), "monograph part").when(kind == "m", "monograph")
        .when(kind == "s", "serial").otherwise("<blank>")
    )


def inferred_year(datetype: Column, first: Column, second: Column, text: Column) -> Column:
    """The earliest attested year, 0 if there is no telling."""
    number = lambda x: F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x).cast("int"))
    decade = F.when(first.rlike(r"^\d{3}u$"), F.substring(first, 1, 3).cast("int") * 10)
    year = F.coalesce(number(first), F.when(first.endswith("uu"), 0).otherwise(decade), F.lit(0))
    last = F.coalesce(number(second), F.lit(0))
    year = F.when(last - year > 25, 0).otherwise(year)
    year = F.when((datetype == "t") & (last > 0) & (last < year), last).otherwise(year)
    return F.when(text.contains("--") & text.contains("estimate"), 0).otherwise(year)


def tag_frequency(volumes: DataFrame, tags: str = "tags", least: int = 3) -> DataFrame:
    return volumes.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def align(wanted: DataFrame, pages: DataFrame, categories: DataFrame) -> DataFrame:
    """``vol, status`` of each wanted volume: success, missing data, category prediction not found, mismatched lengths."""
    have = pages.groupBy("vol").agg(F.count("*").alias("pages"))
    said = categories.groupBy("vol").agg(F.count("*").alias("categories"))
    joined = wanted.join(have, "vol", "left").join(said, "vol", "left")
    return joined.select(
        "vol",
        F.when(F.col("pages").isNull(), "missing data").when(F.col("categories").isNull(), "category prediction not found").when(F.col("pages") != F.col("categories"), "mismatched lengths").otherwise("success").alias("status"),
    )


def assemble(works: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of a work's volumes in order: ``work, pos, seq, page``. Works are small."""
    from pyspark.sql import Window

    own = works.join(pages, "vol")
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("work").orderBy("seq", "page")) - 1)


def chunks(assembled: DataFrame, n: int = 10, more_than: int = 20) -> DataFrame:
    """Works of over ``more_than`` pages cut into ``n`` chunks of equal size, the first ones longer by one."""
    from pyspark.sql import Window

    w = Window.partitionBy("work")
    sized = assembled.withColumn("pages", F.count("*").over(w)).where(F.col("pages") > more_than)
    return sized.withColumn("chunk", F.ntile(n).over(w.orderBy("pos")))


# Fixed value: what a library puts before its record numbers.
RECORD_PREFIX = "MIU01-"


def flatten_marc(records: DataFrame) -> DataFrame:
    """The sixteen columns of a catalogue from MARC records (see ``marc_records``), a row for each item.

    ``htid, recordid, oclc, locnum, author, imprint, datetype, startdate, enddate, textdate, place,
    enumcron, materialtype, subjects, categories, title``. Lists are sorted and joined by semicolons;
    items without an id are left out; missing text is ``<blank>``.
    """
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "<blank>").otherwise(c)
    control = lambda tag: F.get(F.filter("controlfield", lambda x: x["_tag"] == tag), F.lit(0))["_VALUE"]
    fields = lambda pattern: F.filter("datafield", lambda x: x["_tag"].rlike(f"^({pattern})$"))
    texts = lambda pattern: F.flatten(F.transform(fields(pattern), lambda x: F.transform(x["subfield"], lambda s: s["_VALUE"])))
    first = lambda pattern: F.get(texts(pattern), F.lit(0))
    part = lambda item, code: F.get(F.filter(item["subfield"], lambda s: s["_code"] == code), F.lit(0))["_VALUE"]
    numbers = F.filter(F.transform(fields("035"), lambda x: F.get(x["subfield"], F.lit(0))["_VALUE"]), lambda v: v.contains("(OCoLC)"))
    terms = F.transform(F.filter(texts("655|155"), lambda t: t.rlike(r"^\p{Lu}")), lambda t: F.regexp_replace(t, r"[.,;]+$", ""))
    subjects = F.transform(texts("(?!655)6[0-9][0-9]"), lambda t: F.regexp_replace(t, r"[.,]+$", ""))
    subjects = F.when(F.array_contains(texts("970"), "Biography"), F.array_append(subjects, F.lit("IsBiographical"))).otherwise(subjects)
    published = F.filter(F.transform(texts("260"), lambda t: F.regexp_replace(t, r"^[ :,\[\];]+|[ :,\[\];]+$", "")), lambda t: t != "")
    listed = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ";")
    fixed, kind = fixed_field(control("008")), material_type(F.col("leader"))
    items = records.select("*", F.explode(fields("974")).alias("item"))
    flat = items.select(
        part(F.col("item"), "a").alias("htid"), blank(F.replace(control("001"), F.lit(RECORD_PREFIX), F.lit(""))).alias("recordid"),
        blank(F.regexp_replace(F.try_element_at(numbers, F.lit(-1)), r"\(OCoLC\)|ocn|ocm", "")).alias("oclc"), blank(F.regexp_replace(F.array_join(texts("050"), ""), r"^[\[\]]+|[\[\]]+$", "")).alias("locnum"),
        blank(first("100")).alias("author"), blank(F.array_join(published, ";")).alias("imprint"), *[blank(fixed[c]).alias(n) for c, n in (("datetype", "datetype"), ("date1", "startdate"), ("date2", "enddate"), ("place", "place"))],
        text_date(F.array_join(texts("260"), " ")).alias("date"), blank(part(F.col("item"), "c")).alias("enumcron"), kind.alias("materialtype"), blank(listed(subjects)).alias("subjects"),
        blank(listed(F.array_union(F.coalesce(fixed["tags"], F.array().cast("array<string>")), terms))).alias("categories"), blank(F.regexp_replace(first("245"), "[ /:.,]+$", "")).alias("title"),
    )
    dated = flat.where(F.col("htid") != "").withColumn("textdate", serial_date(F.col("materialtype"), F.col("date"), F.col("enumcron")))
    return dated.select("htid", "recordid", "oclc", "locnum", "author", "imprint", "datetype", "startdate", "enddate", "textdate", "place", "enumcron", "materialtype", "subjects", "categories", "title")


def text_date(text: Column) -> Column:
    """The first four-digit year of a century from 15 to 20 in an imprint, with misread digits repaired; ``<estimate=..>`` for an uncertain one, else ``<blank>``."""
    fixed = F.regexp_replace(F.regexp_replace(text, r"\bl(?=[5-9])", "1"), r"(?<=\d)l|l(?=\d)", "1")
    fixed = F.regexp_replace(fixed, r"(?<=\d)[\[\]() ](?=\d)", "")
    year = F.regexp_extract(fixed, r"(1[5-9]\d\d|20\d\d)", 1)
    guess = F.regexp_extract(fixed, r"(1[5-9]\d?[-?_]+\??)", 1)
    return F.when(year != "", year).when(guess != "", F.concat(F.lit('<estimate="'), guess, F.lit('">'))).otherwise("<blank>")


def date_range(text: Column) -> Column:
    """``start, end`` years of a range whose end may be short (``1871-4`` ends in 1874); null where there is none."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\s*[-–—]+\s*", "-"), r"[^\d-]+$", "")
    start, end = F.regexp_extract(flat, r"(1[5-9]\d\d|20\d\d)-(\d{1,4})(?!\d)", 1), F.regexp_extract(flat, r"(1[5-9]\d\d|20\d\d)-(\d{1,4})(?!\d)", 2)
    full = F.when(end != "", F.concat(F.substring(start, 1, 4 - F.length(end)), end).cast("int"))
    first = F.when(start != "", start.cast("int"))
    return F.struct(first.alias("start"), F.when(full >= first, full).alias("end"))


def narrower_date(volume: Column, date: Column) -> Column:
    """A year in the volume's own designation if it lies in the record's range or nothing is known, else the record's date."""
    own, range_ = text_date(volume), date_range(date)
    inside = own.rlike("^[0-9]{4}$") & (range_["start"].isNull() | own.cast("int").between(range_["start"], F.coalesce(range_["end"], range_["start"])))
    return F.when(inside, own).otherwise(date)


def serial_date(kind: Column, date: Column, volume: Column) -> Column:
    """For a serial without date: the last word of its volume number if that begins with a year."""
    last = F.element_at(F.split(F.trim(volume), r"\s+"), -1)
    return F.when(kind.startswith("serial") & (date == "<blank>") & last.rlike("^(1[5-9]|20)[0-9]{2}"), F.substring(last, 1, 4)).otherwise(date)


def metadata_evidence(volumes: DataFrame) -> DataFrame:
    """Six 0/1 flags of ``volumes(vol, maxcategory, tags, non, bio, poe, dra, fic)``: what tags and a volume model (any column null: none) say of the pages' main category.

    Biography counts as nonfiction in the model's answer.
    """
    has = lambda *t: F.arrays_overlap("tags", F.array(*map(F.lit, t)))
    strong = {
        "fic": has("Fiction", "Novel"), "poe": has("Poetry", "Poems"), "dra": has("Drama", "Tragedies", "Comedies"),
        "non": has("Biography", "Autobiography", "Catalog", "Dictionary", "Bibliographies"),
    }
    g = F.col("maxcategory")
    confirm, deny = F.lit(False), F.lit(False)
    for k, flag in strong.items():
        confirm, deny = confirm | (flag & (g == k)), deny | (flag & (g != k))
    weak = has("Not fiction")
    names = ["non", "bio", "poe", "dra", "fic"]
    known = F.col("non").isNotNull()
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("p"), F.lit(c).alias("g")) for c in names]))["g"]
    model = F.when(best == "bio", "non").otherwise(best)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return volumes.select(
        "vol", flag(weak & (g == "non")).alias("weak_confirmation"), flag(weak & (g == "fic")).alias("weak_denial"), flag(confirm).alias("strong_confirmation"), flag(deny).alias("strong_denial"),
        flag(known & (model == g)).alias("model_agrees"), flag(known & (model != g)).alias("model_disagrees"),
    )
