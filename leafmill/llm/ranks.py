"""Places of rows in their groups, counted without a window over a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import written

BROADCAST_RUNS = 500_000  # of under 200 bytes each


def numbered(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with ``place`` (long, from 0 in each group) and ``total`` (rows of the group), written.

    Rows are dealt into ranges of ``(group, order)``, so a group of any size is spread over many tasks,
    and numbered inside their range. Only the counts of (range, group) are summed over the ranges: there
    are at most as many as ranges and groups together. Nulls come first, as keys of groups too. Rows
    equal in all of ``order`` may stand either way round.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    local = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("range_"), F.monotonically_increasing_id().alias("at_"))
    local = written(local, f"{label}-ranges")
    runs = local.groupBy("range_", *group).agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before, whole = Window.partitionBy(*group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    runs = written(runs.select("range_", *[F.col(c).alias(f"{c}_of_run") for c in group], "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"), F.sum("n_").over(whole).alias("total")), f"{label}-runs")
    same = reduce(lambda a, b: a & b, [local[c].eqNullSafe(runs[f"{c}_of_run"]) for c in group], local["range_"] == runs["range_"])
    small = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    return local.join(small, same).select(*[local[c] for c in rows.columns], (F.col("at_") - F.col("first_") + F.col("before_")).alias("place"), "total")
