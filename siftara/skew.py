"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this share of all rows are heavy; there can be at most 1 / HEAVY_SHARE of them, which bounds the broadcast.
HEAVY_SHARE = 0.001


def heavy_keys(counted: DataFrame, on: Sequence[str], count: str) -> DataFrame:
    """The keys of ``counted`` (one row per key with its row count) that hold over HEAVY_SHARE of all rows; at most 1,000 rows.

    They are looked up at once and come back as a local table, so that the plans that use them stay small.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    keys = counted.where(F.col(count) > total * HEAVY_SHARE).select(*on)
    return counted.sparkSession.createDataFrame(keys.toArrow(), keys.schema)


def split_join(rows: DataFrame, keys: DataFrame, heavy: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` join ``keys`` with the heavy keys broadcast and the others shuffled.

    ``keys`` must hold each key once, so that the broadcast part has at most as many rows as ``heavy`` (1,000, see
    ``heavy_keys``). ``how`` is inner, left, left_semi or left_anti. Rows with a null key match nothing.
    """
    on = list(on)
    hot = F.broadcast(heavy)
    return (
        rows.join(hot, on, "left_semi")
        .join(F.broadcast(keys.join(hot, on, "left_semi")), on, how)
        .unionByName(rows.join(hot, on, "left_anti").join(keys.join(hot, on, "left_anti"), on, how))
    )


#: Parts that the rows of a heavy key are cut into.
SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, heavy: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join where both sides may hold a heavy key often: its left rows are spread over SALTS parts, its right rows repeated once for each."""
    on = list(on)
    hot = F.broadcast(heavy.select(*on).distinct().withColumn("_hot", F.lit(True)))
    spread = left.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in left.columns if c not in on]), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, on, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return spread.join(repeated, [*on, "_salt"]).drop("_salt")


#: Rows and bytes up to which a checked side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes, its rows counted as JSON texts. At most ``rows`` + 1 rows are looked at, none leaves the executors."""
    n, taken = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= rows and taken <= size


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES, *, held: bool = False) -> DataFrame:
    """``df`` marked for broadcast when it fits (``fits``), else as it is, to be shuffled. Unless ``held`` says that it is a written table, it is written first, so that its plan runs once."""
    if not held:
        from siftara.storage import materialize

        df = materialize(df, "side")
    return F.broadcast(df) if fits(df, rows, size) else df
