"""Intervals, rank correlation and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftara.functions.hashing import digest, number


def wilson(successes: Column, n: Column, z: float = 1.959963984540054, *, pinned: bool = True) -> tuple[Column, Column]:
    """Wilson score interval. Null for n <= 0. ``pinned``: exactly 0 below for no success and 1 above for all."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), centre - spread), F.least(F.lit(1.0), centre + spread)
    if pinned:
        low, high = F.when(successes == 0, 0.0).otherwise(low), F.when(successes == n, 1.0).otherwise(high)
    return F.when(n > 0, low), F.when(n > 0, high)


def tied_rank(df: DataFrame, value: str, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with the average rank (from 1) of ``value`` within its group.

    Ranks come from the counts of the distinct values, so that one window over distinct values, not over rows, is
    sorted; ties share the mean of their places. Nulls have no rank.
    """
    groups = list(groups)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(name, F.coalesce(F.sum("_n").over(below), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*groups, value], "left")


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rank correlation per group; null where either series is constant. Rows with a null in either column are left out first."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = tied_rank(tied_rank(both, x, "_rx", groups), y, "_ry", groups)
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), rho.alias("rho"))


def rank_percentile(values: Column, share: float, *, upper: bool) -> Column:
    """An element of a collected array by rank: floor rank for a lower bound, ceiling rank for an upper one."""
    n = F.size(values)
    k = F.ceil(n * share) if upper else F.floor(n * share) + 1
    return F.element_at(F.sort_array(values), F.least(F.greatest(k, F.lit(1)), n).cast("int"))


def bootstrap_means(df: DataFrame, value: str, strata: str, key: str, *, replicates: int, seed: str = "bootstrap") -> DataFrame:
    """replicate and macro: the mean over the strata of the resampled stratum mean.

    Poisson resampling: every row's weight in a replicate is drawn from its own key, so no row is ever sent anywhere
    but into the partial sums of its replicate and stratum. Strata that a replicate leaves empty are not averaged.
    """
    u = number(digest(F.lit(seed).cast("string"), F.col("replicate"), F.col(key)), 13).cast("double") / float(16**13)
    weight, cumulative = F.lit(0), 0.0
    for k in range(8):  # inverse distribution function of a Poisson variable with mean 1
        cumulative += math.exp(-1) / math.factorial(k)
        weight = F.when(u >= cumulative, k + 1).otherwise(weight)
    drawn = df.select(key, strata, value).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", weight).where("_w > 0")
    per = drawn.groupBy("replicate", strata).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("_mean"))
    return per.groupBy("replicate").agg(F.avg("_mean").alias("macro"))


def paired_bootstrap(df: DataFrame, first: str, second: str, strata: str, *, replicates: int = 10_000, seed: str = "bootstrap") -> DataFrame:
    """replicate, first and second: the means over the strata of two 0/1 outcomes on the same resampled rows.

    A stratum of n rows is resampled by exactly n draws with replacement. Only how often each of the four pairs of outcomes is
    drawn matters, so the rows are counted once and the counts are drawn: a multinomial variable per stratum, seeded by its key.
    Rows with a null outcome or stratum are left out.
    """
    a, b = F.col(first) == 1, F.col(second) == 1
    rows = df.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(strata).isNotNull())
    counts = rows.groupBy(F.col(strata).cast("string").alias("stratum")).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))

    def draw(frames):
        import hashlib

        import numpy as np
        import pandas as pd

        for frame in frames:
            for stratum, *cells in frame.itertuples(index=False, name=None):
                n = sum(cells)
                rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{stratum}".encode()).digest()[:8], "big"))
                m = rng.multinomial(n, np.array(cells) / n, size=replicates)
                yield pd.DataFrame({"replicate": range(replicates), "first": (m[:, 0] + m[:, 1]) / n, "second": (m[:, 0] + m[:, 2]) / n})

    per = counts.mapInPandas(draw, "replicate int, first double, second double")
    return per.groupBy("replicate").agg(F.avg("first").alias("first"), F.avg("second").alias("second"))


def cluster_bootstrap(df: DataFrame, group: str, agree: str, total: str, *, replicates: int = 10_000, seed: str = "bootstrap") -> DataFrame:
    """replicate and share: the agreement over as many groups as there are, drawn with replacement, each with all of its rows.

    Only how often each pair of group sums is drawn matters, so groups with the same sums are counted together and the counts are drawn.
    """
    sums = df.groupBy(group).agg(F.sum(agree).cast("double").alias("a"), F.sum(total).cast("double").alias("t"))
    cells = sums.groupBy("a", "t").agg(F.count("*").alias("n")).where("t > 0")

    def draw(frame):
        import hashlib

        import numpy as np
        import pandas as pd

        frame = frame.sort_values(["a", "t"])
        n = frame["n"].to_numpy()
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big"))
        drawn = rng.multinomial(n.sum(), n / n.sum(), size=replicates)
        return pd.DataFrame({"replicate": range(replicates), "share": (drawn @ frame["a"].to_numpy()) / (drawn @ frame["t"].to_numpy())})

    # one row for each different pair of sums, far fewer than groups
    return cells.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(draw, "replicate int, share double")


def skill_bootstrap(df: DataFrame, source: str, first: str, second: str, chance: str, *, replicates: int = 1_000, seed: str = "bootstrap") -> DataFrame:
    """replicate, first, second and difference: the means over the sources of two systems' skill over chance on the same resampled questions of each source.

    A source of n questions is resampled by n draws; questions alike in both credits and chance are counted together. A source whose questions leave nothing to chance has skill 0.
    """
    cells = df.groupBy(F.col(source).cast("string").alias("source"), F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b"), F.col(chance).cast("double").alias("c")).agg(F.count("*").alias("n"))

    def draw(frame):
        import hashlib

        import numpy as np
        import pandas as pd

        name = frame["source"].iloc[0]
        frame = frame.sort_values(["a", "b", "c"])
        n = frame["n"].to_numpy()
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big"))
        drawn = rng.multinomial(n.sum(), n / n.sum(), size=replicates) / n.sum()
        a, b, c = (drawn @ frame[x].to_numpy() for x in "abc")
        skill = lambda x: np.where(c < 1, (x - c) / np.where(c < 1, 1 - c, 1), 0.0)
        return pd.DataFrame({"replicate": range(replicates), "first": skill(a), "second": skill(b)})

    # a source has as many rows here as different credits and chances
    per = cells.groupBy("source").applyInPandas(draw, "replicate int, first double, second double")
    return per.groupBy("replicate").agg(F.avg("first").alias("first"), F.avg("second").alias("second")).withColumn("difference", F.col("first") - F.col("second"))


def interval(replicates: DataFrame, value: str = "macro", level: float = 0.95) -> DataFrame:
    """low and high by rank: the replicates outside them are no more than the level leaves over on each side."""
    tail = (1 - level) / 2
    values = F.collect_list(value)  # one number for each replicate
    return replicates.agg(rank_percentile(values, tail, upper=False).alias("low"), rank_percentile(values, 1 - tail, upper=True).alias("high"), F.count("*").alias("replicates"))


def permutation_p(pairs: Sequence[tuple[float, float]], *, draws: int = 20_000, seed: int = 7) -> float:
    """One-sided p of the rank correlation of a short paired list: exact up to 8 pairs, else by draws with one added to both counts."""
    import itertools

    import numpy as np

    def ranks(v: np.ndarray) -> np.ndarray:
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    x, y = (ranks(np.array(v, dtype=float)) for v in zip(*pairs))
    x, y = x - x.mean(), y - y.mean()
    seen = float(x @ y) - 1e-12
    if len(x) <= 8:
        all_ = [float(x @ y[list(p)]) for p in itertools.permutations(range(len(y)))]
        return sum(v >= seen for v in all_) / len(all_)
    rng = np.random.default_rng(seed)
    return (1 + sum(float(x @ rng.permutation(y)) >= seen for _ in range(draws))) / (draws + 1)
