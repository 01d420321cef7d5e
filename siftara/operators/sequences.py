"""Ordered folds inside documents, edit blocks, and small sequential plans."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftara.functions.hashing import digest
from siftara.functions.text import let

#: Rows that one task batches greedily.
BATCH_SHARD = 50_000


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, place (from 1) and stripped line of every non-empty line."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r\n?|\n")).alias("place", "line"))
    return rows.select(key, (F.col("place") + 1).alias("place"), F.regexp_replace("line", r"^[\s﻿]+|\s+$", "").alias("line")).where("line <> ''")


def carried(df: DataFrame, key: str, place: str, value: Column, name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` at or before each row of its key. A key is one document, so a window over it is bounded by a text."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(place)))


def trace_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, phase, label, number and whether the number is not above the one before: the bracketed headings of a loop trace under their tags."""
    lines = numbered_lines(df, key, text)
    opened = F.when(F.col("line").rlike(r"^<[a-z]+>$"), F.regexp_extract("line", r"^<([a-z]+)>$", 1))
    phased = carried(lines, key, "place", opened, "phase")
    points = phased.where(F.col("line").rlike(r"^\[[^\]\d]+ \d{1,9}\]$"))
    own = points.select(key, "place", "phase", F.regexp_extract("line", r"^\[(.+) \d+\]$", 1).alias("label"), F.regexp_extract("line", r"(\d+)\]$", 1).cast("int").alias("number"))
    before = F.lag("number").over(Window.partitionBy(key).orderBy("place"))
    return own.withColumn("out_of_order", F.coalesce(F.col("number") <= before, F.lit(False)))


def apply_block(source: Column, search: Column, replacement: Column) -> Column:
    """``source`` with the first occurrence of ``search`` replaced; null where it does not occur or is empty."""

    def put(at: Column) -> Column:
        return F.when((at > 0) & (F.length(search) > 0), F.concat(F.substring(source, F.lit(1), at - 1), replacement, F.substring(source, at + F.length(search), F.length(source))))

    return let(F.instr(source, search), put)


def edit_blocks(text: Column) -> Column:
    """Array of (search, replacement) of the edit blocks in a reply."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<{3,} ?SEARCH[^\n]*\n(.*?)\n?={3,}[^\n]*\n(?:.*?)\n?>{3,} ?REPLACE"), 0)

    def parts(block: Column) -> Column:
        pattern = r"(?s)^<{3,} ?SEARCH[^\n]*\n(.*?)\n?={3,}[^\n]*\n(.*?)\n?>{3,} ?REPLACE$"
        return F.struct(F.regexp_extract(block, pattern, 1).alias("search"), F.regexp_extract(block, pattern, 2).alias("replacement"))

    return F.transform(found, parts)


def spread_ranks(n: int, k: int) -> list[int]:
    """``k`` places from 0 to n - 1, evenly spaced, both ends included (half to even); all places where there are no more."""
    return list(range(n)) if k >= n else [0] * (k == 1) or sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})


def micro_batches(df: DataFrame, key: str, length: str, *, budget: int, max_rows: int, seed: str = "batch") -> DataFrame:
    """key, length and batch: rows of similar length together, longest length times rows within ``budget``.

    Rows are sharded by digest to at most about BATCH_SHARD each and batched greedily in each shard, longest first. A row
    above the budget is a batch of its own; a null length counts as 0.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(length, F.lit(0)).cast("long").alias("length"))
    shards = max(1, math.ceil(rows.count() / BATCH_SHARD))
    kind = dict(df.dtypes)[key]

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "turn"], ascending=[False, True], kind="stable")
        batch, size, longest, out = -1, 0, 0, []
        for n in group["length"]:
            if batch < 0 or size >= max_rows or longest * (size + 1) > budget:
                batch, size, longest = batch + 1, 0, n
            size += 1
            out.append(batch)
        return group.assign(batch=group["shard"].to_numpy() * BATCH_SHARD + out)[["key", "length", "batch"]]

    turned = rows.withColumn("turn", F.coalesce(digest(seed, F.col("key")), F.lit("")))
    sharded = turned.withColumn("shard", F.pmod(F.xxhash64("turn"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(cut, f"key {kind}, length long, batch long").withColumnRenamed("key", key)


def most_common(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The most frequent non-null value of each group (the smallest at a tie) and its count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    # at a tie min_by takes the smallest value, as the order puts the count first and the value second
    return n.groupBy(*groups).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("r")).select(*groups, "r.*")
