"""Seeded choices of rows: caps, strata, cases, budgets and orders. All are functions of digests, never of row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftara.functions.hashing import digest
from siftara.operators.ranks import running_sum


def cap_per_group(df: DataFrame, groups: Sequence[str], turn: Column, cap: Column | int) -> DataFrame:
    """The ``cap`` rows of each group that come first by ``turn`` (unique within a group). A null cap keeps all.

    The limit is pushed below the shuffle: each task sends at most ``cap`` rows of a group.
    """
    limit = F.lit(cap) if isinstance(cap, int) else cap
    w = Window.partitionBy(*groups).orderBy("_turn")
    ranked = df.withColumn("_turn", turn).withColumn("_at", F.row_number().over(w))
    return ranked.where((F.col("_at") <= limit) | limit.isNull()).drop("_turn", "_at")


def holdout(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """``df`` with ``held``: exactly round(share * n) rows (half to even), those with the smallest digests.

    The border digest is found from counts of digest prefixes, so no task sorts all rows.
    """
    turned = df.withColumn("_turn", digest(seed, F.col(key)))
    want = round(share * turned.count())
    counts = turned.groupBy(F.substring("_turn", 1, 3).alias("p")).count().orderBy("p").collect()  # at most 4,096 rows
    seen, border = 0, None
    for r in counts:
        if seen + r["count"] > want:
            border = r["p"]
            break
        seen += r["count"]
    if border is None:
        return turned.withColumn("held", F.lit(True)).drop("_turn")
    first = turned.where(F.col("_turn").startswith(border)).orderBy("_turn").limit(want - seen + 1).select("_turn").collect()
    return turned.withColumn("held", F.col("_turn") < first[-1]["_turn"]).drop("_turn")


def stratified_groups(df: DataFrame, stratum: str, group: str, per_stratum: int, seed: str) -> DataFrame:
    """All rows of the first ``per_stratum`` groups of each stratum by digest; a larger sample contains a smaller one."""
    groups = df.select(stratum, group).distinct()
    chosen = cap_per_group(groups, [stratum], digest(seed, F.col(stratum), F.col(group)), per_stratum)
    return df.join(chosen, [stratum, group], "left_semi")


def one_per_case(df: DataFrame, case: Sequence[str], key: str, seed: str) -> DataFrame:
    """One row of each case: the one with the smallest digest."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(c).alias(f"_case_{i}") for i, c in enumerate(case)]).agg(F.min_by(row, digest(seed, F.col(key))).alias("row")).select("row.*")


def interleave(df: DataFrame, group: str, turn: Column, name: str = "round") -> DataFrame:
    """``df`` with ``name``, its place in its group; ordered by it and the group, rows come out in turn from all groups. ``turn`` is a hex digest; places are counted by its ranges, so a hot group is not sorted as one."""
    placed = running_sum(df.withColumn("_turn", turn).withColumn("_one", F.lit(1)), [group], "_turn", "_one", "_before")
    return placed.withColumn(name, (F.col("_before") + 1).cast("int")).select(*df.columns, name)


def fit_budget(sizes: DataFrame, group: str, turn: Column, size: str, budget: int) -> DataFrame:
    """Rows of each group while the running sum of ``size``, in the order of ``turn`` (a hex digest), stays within ``budget``; sums are added up by ranges of the digest."""
    summed = running_sum(sizes.withColumn("_turn", turn), [group], "_turn", size, "_before").withColumn("running", F.col("_before") + F.col(size))
    return summed.where(F.col("running") <= budget).select(*sizes.columns, "running")
