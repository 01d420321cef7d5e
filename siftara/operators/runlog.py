"""Append-only result logs: the last record of a key wins, errors are retried, and liveness is read from gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_record(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (unique together); earlier ones are dropped before the shuffle."""
    row, by = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[F.col(f"`{c}`") for c in order])
    return df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, by).alias("row")).select("row.*")


def trailing_streak(df: DataFrame, key: str, order: Column, failed: Column, *, counts: Column | None = None) -> DataFrame:
    """key, attempts, streak: failures since the last success. Rows where ``counts`` is false (an outage round) are left out of both."""
    rows = df.select(key, order.alias("_at"), failed.alias("_failed"), (counts if counts is not None else F.lit(True)).alias("_counts")).where("_counts")
    # two aggregations with partial sums instead of a window over each key's whole history
    last_ok = rows.groupBy(key).agg(F.max(F.when(~F.col("_failed"), F.col("_at"))).alias("_ok"), F.count("*").alias("attempts"))
    after = rows.join(last_ok, key).where("_failed and (_ok is null or _at > _ok)").groupBy(key).agg(F.count("*").alias("streak"))
    return last_ok.join(after, key, "left").select(key, "attempts", F.coalesce("streak", F.lit(0)).alias("streak"))


def lease_gaps(df: DataFrame, key: str, time: str, tie: str, ttl_seconds: int) -> DataFrame:
    """Where a key's next beat came later than its time to live: key, lost_at (the last beat before), back_at, seconds."""
    w = Window.partitionBy(key).orderBy(time, tie)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("lost_at").cast("timestamp"))
    beats = df.select(key, time, tie).withColumn("lost_at", F.lag(time).over(w)).withColumn("micros", gap)
    return beats.where(F.col("micros") > ttl_seconds * 1_000_000).select(key, "lost_at", F.col(time).alias("back_at"), (F.col("micros") / 1e6).alias("seconds"))


def fold_stream(df: DataFrame, key: str, order: Sequence[str], *, final: Column, mark: Column, bad: Column) -> DataFrame:
    """One row for each stream: events, last final value, whether the end mark came, and bad events."""
    by = F.struct(*order)
    return df.groupBy(key).agg(F.count("*").alias("events"), F.max_by(final, F.when(final.isNotNull(), by)).alias("final"), F.coalesce(F.bool_or(mark), F.lit(False)).alias("done"), F.count_if(bad).alias("bad"))


def work_list(requests: DataFrame, last: DataFrame, key: str, *, terminal: Sequence[str], max_attempts: int) -> DataFrame:
    """Requests without a terminal last status that have attempts left: key, status (null: never tried), attempts."""
    joined = requests.select(key).join(last.select(key, "status", "attempts"), key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return joined.where((F.col("status").isNull() | ~F.col("status").isin(*terminal)) & (F.col("attempts") < max_attempts))


def merge_states(left: DataFrame, right: DataFrame, key: str, *, rank: Column, order: str, columns: Sequence[str]) -> DataFrame:
    """Union of two keyed states: for each key the row with the higher rank, then the later ``order``; the left one at a tie."""
    both = left.select(key, order, *columns, F.lit(1).alias("_side")).unionByName(right.select(key, order, *columns, F.lit(0).alias("_side")))
    row = F.struct(F.col(order), *columns)
    return both.groupBy(key).agg(F.max_by(row, F.struct(rank, F.col(order), F.col("_side"))).alias("row")).select(key, "row.*")
