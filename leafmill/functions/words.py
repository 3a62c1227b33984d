"""Line and token functions: columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that is stripped from tokens, and the same without marks of two characters.
PUNCTUATION = r"""[.,?!;"“”:—)('`\[\]{}]"""
MARKS = ".,?!;\"“”:—)('`[]{}"  # the same marks as a list
# Marks that are erased from fragments of words, hyphens among them.
ERASED = ".,():-—;\"!?•$%@“”#<>+=/[]*^'{}_■~\\|«»©&~`£·"
# Honorifics.
HONORIFICS = ["sir", "mr", "m", "miss", "mrs", "lord", "lady", "prince", "king", "queen"]
# Words that a long s is often misread in, and what they should be.
LONG_S_ERRORS = ["fee", "fea", "fay", "fays", "fame", "fell", "funk", "fold", "haft", "fat", "fix", "chafe", "loft"]
LONG_S_TRUTHS = ["see", "sea", "say", "says", "same", "sell", "sunk", "sold", "hast", "sat", "six", "chase", "lost"]
# Words that mean something in a running header.
HEADER_WORDS = [
    "index", "introduction", "introductory", "preface", "contents", "glossary", "notes", "poems", "ode", "stanzas", "catalog", "books",
    "volumes", "tale", "chapter", "canto", "advertisement", "argument", "book", "scene", "act", "comedy", "tragedy", "plays",
]
# Lines that ``is_markup`` takes for markup, in a text of many lines.
MARKUP_LINE = "(?md)^ *<.*> *$"


def is_markup(line: Column) -> Column:
    s = F.trim(line)
    return s.startswith("<") & s.endswith(">")


def padded(line: Column) -> Column:
    """A line with spaces put around marks that must not stick to words."""
    for old, new in (("”", "” "), (":", ": "), (";", "; "), (",,", ", , ")):
        line = F.replace(line, F.lit(old), F.lit(new))
    line = F.regexp_replace(line, r",(\D)", ", $1")
    for old, new in (("—", " — "), ("--", " -- "), ("_", " ")):
        line = F.replace(line, F.lit(old), F.lit(new))
    return line


def tokens_of(line: Column) -> Column:
    return F.filter(F.split(padded(line), r"\s+"), lambda x: x != "")


def stripped(token: Column) -> Column:
    """A token without punctuation at its ends; one character is always left."""
    bare = F.btrim(token, F.lit(MARKS))
    return F.when(bare == "", F.left(token, F.lit(1))).otherwise(bare)


def stripped_by_pattern(token: Column) -> Column:
    """The same for a token that is itself costly to make: it is named, and so worked out, only once."""
    return F.regexp_replace(F.regexp_replace(token, f"(?<=.){PUNCTUATION}+$", ""), f"^{PUNCTUATION}+(?=.)", "")


def without_punctuation(token: Column) -> Column:
    """A token without any of the marks that are erased from fragments."""
    return F.translate(token, ERASED, "")


def case_of(token: Column) -> Column:
    """``lower``, ``upper``, ``title`` or ``heterogenous``; apostrophes are no matter."""
    plain = F.replace(token, F.lit("'"), F.lit(""))
    return (
        F.when(token.rlike(r"\p{Ll}") & ~token.rlike(r"[\p{Lu}\p{Lt}]"), "lower")
        .when(plain.rlike(r"\p{Lu}") & ~plain.rlike(r"[\p{Ll}\p{Lt}]"), "upper")
        .when(plain.rlike(r"\p{Lu}") & ~plain.rlike(r"\p{L}\p{Lu}") & ~plain.rlike(r"(^|\P{L})\p{Ll}"), "title")
        .otherwise("heterogenous")
    )


def is_upper(token: Column) -> Column:
    """Whether ``case_of`` says ``upper``, by one pattern."""
    return token.rlike(r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$")


def normal_case(token: Column) -> Column:
    return F.when(case_of(token) == "heterogenous", token).otherwise(F.lower(token))


def digits(token: Column) -> Column:
    return F.length(token) - F.length(F.regexp_replace(token, r"\p{Nd}", ""))


def mostly_numeric(token: Column) -> Column:
    return (F.length(token) > 0) & (digits(token) > 0.35 * F.length(token))


def number_class(token: Column) -> Column:
    """The class of an arabic number or price; null for other tokens."""
    n = digits(token)
    price = token.rlike("[$£¢]") | token.endswith("s") | token.endswith("d")
    return F.when((F.length(token) > 0) & (n * 10 >= F.length(token) * 4), F.when(price, "arabicprice").when(n < 5, F.concat(F.lit("arabic"), F.greatest(n, F.lit(1)).cast("string"), F.lit("digit"))).otherwise("arabic5+digit"))


def no_alphanumeric(token: Column) -> Column:
    return ~token.rlike(r"[\p{L}\p{Nd}]")


def without_possessive(token: Column) -> Column:
    return F.when(F.length(token) > 2, F.regexp_replace(token, "'[sS]$", "")).otherwise(token)
