"""Scores against chance, agreement of systems, pairs, weights and routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftara.functions import distributions as D


def skill(accuracy: Column, chance: Column, *, clip: bool = True) -> Column:
    """Accuracy between chance (0) and certainty (1); clipped to that range on request."""
    s = (accuracy - chance) / (1 - chance)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) if clip else s


def macro(df: DataFrame, group: str, value: Column, outer: Sequence[str] = ()) -> DataFrame:
    """Mean over the groups of the group mean."""
    per = df.groupBy(*outer, group).agg(F.avg(value).alias("_mean"), F.count("*").alias("_n"))
    return per.groupBy(*outer).agg(F.count("*").alias("groups"), F.sum("_n").alias("rows"), F.avg("_mean").alias("macro"))


def agreement(df: DataFrame, a: str, b: str, *, near_tie: float = 0.05) -> DataFrame:
    """How far two distributions of the same question agree; rows where either is null are left out."""
    p, q = F.col(a), F.col(b)
    same = D.first_maximum(p) == D.first_maximum(q)
    near = F.least(D.margin(p), D.margin(q)) < near_tie
    gaps = F.zip_with(p, q, lambda x, y: F.abs(x - y))
    rows = df.where(p.isNotNull() & q.isNotNull())
    return rows.agg(
        F.count("*").alias("n"), F.avg(same.cast("double")).alias("agreement"), F.count_if(~same & near).alias("near_ties"), F.count_if(~same & ~near).alias("clear_differences"),
        F.avg(D.total(gaps) / F.size(p)).alias("mean_gap"), F.max(F.array_max(gaps)).alias("max_gap"), F.avg(D.variation(p, q)).alias("mean_variation"),
    )


def discordance(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """The two-by-two table of two systems' hits."""
    return df.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def f1_against_prevalence(df: DataFrame, truth: Column, said: Column, groups: Sequence[str] = ()) -> DataFrame:
    """F1 and the F1 of always saying yes, which is the chance level of a rare class."""
    counts = df.groupBy(*groups).agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count("*").alias("n"))
    share = (F.col("tp") + F.col("fn")) / F.col("n")
    return counts.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))).withColumn("chance", 2 * share / (1 + share))


def pair_gains(hits: DataFrame, item: str, systems: Mapping[str, Column], probs: Mapping[str, Column], gold: Column) -> DataFrame:
    """For every pair of systems: accuracy of the equal mean of their distributions, and its gain over the better one. One pass over the rows."""
    names = list(systems)
    sums = [F.avg(systems[s].cast("double")).alias(f"own_{s}") for s in names]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    mixed = [F.avg((D.first_maximum(D.mean_of([probs[a], probs[b]])) == gold).cast("double")).alias(f"pair_{a}_{b}") for a, b in pairs]
    one = hits.agg(*sums, *mixed)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"pair_{a}_{b}").alias("accuracy"), (F.col(f"pair_{a}_{b}") - F.greatest(f"own_{a}", f"own_{b}")).alias("gain")) for a, b in pairs]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def weight_grid(df: DataFrame, a: Column, b: Column, gold: Column, half: Column, steps: int = 11) -> DataFrame:
    """weight of ``a`` that is best on half 0 (the smallest at a tie), with its accuracy there and on half 1."""
    grid = F.array(*[F.lit(i / (steps - 1)) for i in range(steps)])
    rows = df.select(a.alias("_a"), b.alias("_b"), gold.alias("_g"), half.alias("_h"), F.explode(grid).alias("weight"))
    mixed = F.zip_with(F.col("_a"), F.col("_b"), lambda x, y: F.col("weight") * x + (1 - F.col("weight")) * y)
    per = rows.select("weight", "_h", (D.first_maximum(mixed) == F.col("_g")).cast("double").alias("hit")).groupBy("weight").agg(F.avg(F.when(F.col("_h") == 0, F.col("hit"))).alias("fitted"), F.avg(F.when(F.col("_h") == 1, F.col("hit"))).alias("held_out"))
    return per.agg(F.max_by(F.struct("weight", "fitted", "held_out"), F.struct(F.round("fitted", 12), -F.col("weight"))).alias("r")).select("r.*")


def gate_curve(df: DataFrame, confidence: Column, first: Column, second: Column, group: str, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: macro accuracy when rows under it go to the second system, and the share that goes."""
    rows = df.select(group, confidence.alias("_c"), first.cast("double").alias("_f"), second.cast("double").alias("_s"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    sent = F.col("_c") < F.col("threshold")
    per = rows.groupBy("threshold", group).agg(F.avg(F.when(sent, F.col("_s")).otherwise(F.col("_f"))).alias("_acc"), F.count_if(sent).alias("_sent"), F.count("*").alias("_n"))
    return per.groupBy("threshold").agg(F.avg("_acc").alias("macro"), (F.sum("_sent") / F.sum("_n")).alias("sent"))


def weighted_index(df: DataFrame, area: str, value: Column, weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean of the area means; weights of areas without rows are shared out among the others."""
    per = df.groupBy(area).agg(F.avg(value).alias("_mean"))
    w = F.lit(None).cast("double")
    for name, x in weights.items():
        w = F.when(F.col(area) == name, float(x)).otherwise(w)
    return per.withColumn("_w", w).where("_w is not null").agg(F.count("*").alias("areas"), (F.sum(F.col("_w") * F.col("_mean")) / F.sum("_w")).alias("index"))


def usable_in_all(df: DataFrame, item: str, system: str, wanted: int) -> DataFrame:
    """Items that every one of ``wanted`` systems answered."""
    return df.groupBy(item).agg(F.countDistinct(system).alias("systems")).where(F.col("systems") == wanted).select(item)
