"""Proper scores, calibration error and temperature fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftara.functions import distributions as D
from siftara.skew import broadcast_checked


def scores(df: DataFrame, probs: str, gold: str, groups: Sequence[str] = ()) -> DataFrame:
    """n, nll, brier and accuracy per group, over rows with a gold place."""
    p, g = F.col(probs), F.col(gold)
    each = df.where(g.isNotNull()).select(*groups, D.negative_log(p, g).alias("nll"), D.brier(p, g).alias("brier"), (D.first_maximum(p) == g).cast("double").alias("hit"))
    return each.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg("hit").alias("accuracy"))


def calibration_error(df: DataFrame, probs: str, gold: str, bins: int) -> DataFrame:
    """n and ece: mean distance of confidence and accuracy over equal bins of confidence, weighted by rows."""
    p = F.col(probs)
    each = df.where(F.col(gold).isNotNull()).select(F.array_max(p).alias("c"), (D.first_maximum(p) == F.col(gold)).cast("double").alias("h"))
    per = each.groupBy(D.confidence_bin(F.col("c"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("h").alias("h"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"))


def scan_temperatures(df: DataFrame, logits: str, gold: str, grid: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """nll of every temperature of the grid per group. The grid is a literal array, so the rows are read and multiplied in one stage."""
    each = df.where(F.col(gold).isNotNull()).select(*groups, logits, gold, F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("temperature"))
    nll = D.negative_log(D.softmax(F.col(logits), F.col("temperature")), F.col(gold))
    return each.groupBy(*groups, "temperature").agg(F.count("*").alias("n"), F.avg(nll).alias("nll"))


def fit_temperature(df: DataFrame, logits: str, gold: str, groups: Sequence[str] = (), *, low: float = 0.5, high: float = 4.0, points: int = 33, rounds: int = 3) -> DataFrame:
    """temperature and nll per group: a geometric grid, then ``rounds`` finer grids around the best point of each group, never outside ``low`` to ``high``."""
    best = _best(scan_temperatures(df, logits, gold, D.geometric_grid(low, high, points), groups), groups)
    ratio = (high / low) ** (1 / (points - 1))
    for _ in range(rounds):
        ratio, steps = ratio ** (1 / 4), range(-4, 5)
        around = F.array_distinct(F.array(*[F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col("best") * (ratio**k))) for k in steps]))
        rows = df.where(F.col(gold).isNotNull()).select(*groups, logits, gold)
        near = best.withColumnRenamed("temperature", "best").select(*groups, "best")
        joined = rows.join(broadcast_checked(near), list(groups)) if groups else rows.crossJoin(F.broadcast(near))  # without groups ``near`` is one row
        each = joined.withColumn("temperature", F.explode(around))
        nll = D.negative_log(D.softmax(F.col(logits), F.col("temperature")), F.col(gold))
        best = _best(each.groupBy(*groups, "temperature").agg(F.count("*").alias("n"), F.avg(nll).alias("nll")), groups)
    return best


def _best(scan: DataFrame, groups: Sequence[str]) -> DataFrame:
    row = F.struct("temperature", "nll", "n")
    return scan.groupBy(*groups).agg(F.min_by(row, F.struct(F.round("nll", 12), "temperature")).alias("row")).select(*groups, "row.*")


def with_fallback(fits: DataFrame, whole: DataFrame, least: int) -> DataFrame:
    """Temperatures of groups with at least ``least`` rows, and of the whole table for the others; ``own`` says which."""
    overall = whole.select(F.col("temperature").alias("_all"))
    return fits.crossJoin(F.broadcast(overall)).withColumn("own", F.col("n") >= least).withColumn("temperature", F.when(F.col("own"), F.col("temperature")).otherwise(F.col("_all"))).drop("_all", "nll")  # one row broadcast
