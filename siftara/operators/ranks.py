"""Ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of an order that cut a group into ranges: 4,096 of them.
DIGITS = 3


def running_sum(df: DataFrame, groups: Sequence[str], order: str, weight: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over the rows of its group before it in the order of ``order``. Null groups are groups.

    ``order`` holds lower-case hex digests, unique within a group. A group is cut into ranges of equally many digests;
    the sums of the ranges are added up over at most 4,096 rows a group, and only a range is sorted as one.
    """
    groups = list(groups)
    cut = df.withColumn("_range", F.substring(order, 1, DIGITS))
    sums = cut.groupBy(*groups, "_range").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_range").eqNullSafe(F.col("_at")))
    return (
        cut.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, same)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset", "_at", *[f"_g{i}" for i in range(len(groups))])
    )


def dense_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Each distinct value with its dense rank from 0: values are sorted by range partitions, whose sizes are added up (one row a partition)."""
    ordered = df.select(value).distinct().repartitionByRange(value).sortWithinPartitions(value).withColumn("_part", F.spark_partition_id())
    from siftara.storage import materialize

    ordered = materialize(ordered, "ranks")
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(value)) - 1
    return ordered.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").select(value, (F.col("_offset") + F.col("_inside")).alias(name))  # one row a partition
