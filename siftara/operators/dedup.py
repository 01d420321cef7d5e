"""Exact duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftara.functions.text import jaccard
from siftara.skew import heavy_keys, salted_join, split_join
from siftara.storage import materialize


def first_of_each(df: DataFrame, groups: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The row of each group that comes first by ``order`` (unique together). Copies are combined before the shuffle; null groups are groups."""
    row, by = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[F.col(f"`{c}`") for c in order])
    keys = [g.alias(f"_g{i}") for i, g in enumerate(groups)]
    return df.groupBy(*keys).agg(F.min_by(row, by).alias("row")).select("row.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, or an error that names a key that is there twice."""
    twice = duplicate_keys(df, keys).limit(1).collect()
    if twice:
        raise ValueError(f"not unique: {twice[0].asDict()}")
    return df


def similar_pairs(df: DataFrame, key: str, group: str, words: str) -> DataFrame:
    """a, b and overlap (Jaccard) of the pairs of rows of the same group whose word sets share more than half of their words.

    Only pairs that meet in a rare word are compared: of n words such a pair shares more than n / 2, so it shares one of
    the first half, in one order of all words from the rarest on. A word that very many rows of a group have in that half is spread over several tasks. Null groups and empty sets are in no pair.
    """
    rows = materialize(df.where(F.col(group).isNotNull() & (F.size(words) > 0)).select(F.col(key).alias("k"), F.col(group).alias("g"), F.array_distinct(words).alias("w")), "word-sets")
    each = rows.select("k", "g", F.explode("w").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    ranked = split_join(each, often, heavy_keys(often, ["word"], "often"), ["word"]).groupBy("k", "g").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("w"))  # one row's words
    rare = ranked.select("k", "g", F.explode(F.slice("w", F.lit(1), F.ceil(F.size("w") / 2).cast("int"))).alias("x")).select("k", "g", F.col("x.word").alias("word"))
    rare = materialize(rare, "rare-words")
    heavy = heavy_keys(rare.groupBy("g", "word").agg(F.count("*").alias("n")), ["g", "word"], "n")
    met = salted_join(rare.withColumnRenamed("k", "a"), rare.withColumnRenamed("k", "b"), heavy, ["g", "word"]).where("a < b").select("a", "b").distinct()
    side = lambda n: rows.groupBy("k").agg(F.first("w").alias(f"w{n}")).withColumnRenamed("k", n)
    shared = met.join(side("a"), "a").join(side("b"), "b").withColumn("overlap", jaccard(F.col("wa"), F.col("wb")))
    return shared.where("overlap > 0.5").select("a", "b", "overlap")
