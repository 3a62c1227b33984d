"""Identifier functions: columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _head_and_tail(x: Column) -> tuple[Column, Column]:
    head = F.substring_index(x, ".", 1)
    return head, F.substring(x, F.length(head) + 2, F.length(x))


def clean_id(x: Column) -> Column:
    """After the first dot ``:`` becomes ``+`` and ``/`` becomes ``=``, if a colon is there."""
    head, tail = _head_and_tail(x)
    return F.when(x.contains(".") & tail.contains(":"), F.concat(head, F.lit("."), F.translate(tail, ":/", "+="))).otherwise(x)


def dirty_id(x: Column) -> Column:
    """The reverse of ``clean_id``, if an equals sign is there."""
    head, tail = _head_and_tail(x)
    return F.when(x.contains(".") & tail.contains("="), F.concat(head, F.lit("."), F.translate(tail, "+=", ":/"))).otherwise(x)


def file_id(x: Column) -> Column:
    """A name that is safe for files: the whole id is translated."""
    return F.translate(x, ":/", "+=")


def label_id(x: Column) -> Column:
    return F.translate(x, "+=", ":/")


def pairtree_path(x: Column) -> Column:
    """Prefix, root folder, the rest cut into pairs of characters, and the rest itself as the last folder."""
    head, tail = _head_and_tail(x)
    safe = F.translate(tail, ":/.", "+=,")
    return F.concat(head, F.lit("/pairtree_root/"), F.regexp_replace(safe, "(.{1,2})", "$1/"), safe)


def variants(x: Column) -> Column:
    """The forms under which an id may be filed."""
    return F.array_distinct(F.array(x, F.replace(x, F.lit(","), F.lit(".")), dirty_id(x)))
