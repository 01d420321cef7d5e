"""Choices that depend on a key and not on row order: every split, sample and order is a function of SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str, sep: str = ":") -> Column:
    """Hex SHA-256 of the parts joined by ``sep``. Strings are literals; a null part makes the digest null."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    joined = columns[0]
    for c in columns[1:]:
        joined = F.concat(joined, F.lit(sep), c)
    return F.sha2(joined, 256)


def number(hex_digest: Column, digits: int = 8) -> Column:
    """The first hex digits (at most 15) as a long."""
    if not 1 <= digits <= 15:
        raise ValueError("1 to 15 hex digits fit a long")
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("long")


def bucket(hex_digest: Column, buckets: int) -> Column:
    """0 to buckets - 1 by the first 8 digits."""
    return number(hex_digest) % buckets


def fraction(hex_digest: Column) -> Column:
    """The first 13 hex digits as a number from 0 to below 1, exact as a double."""
    return number(hex_digest, 13).cast("double") / float(16**13)


def split_name(key: Column, dev_percent: float, *, prefix: str = "split") -> Column:
    """dev for about ``dev_percent`` of the keys, else train; null keys are train."""
    return F.when(bucket(digest(prefix, key), 10_000) < dev_percent * 100, "dev").otherwise("train")


def group_split(group: Column, seed: str, *, parts: int = 10) -> Column:
    """val for one group in ``parts``, else train: all rows of a group agree."""
    return F.when(bucket(digest(seed, "split", group), parts) == 0, "val").otherwise("train")


def half(key: Column, salt: str = "") -> Column:
    """0 or 1 by the last digit of the digest: two folds."""
    return number(F.right(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), F.lit(1)), 1) % 2


def sort_key(key: Column, seed: str) -> Column:
    """A digest to order by; the same order on every run and partitioning. Ties are broken by nothing: keys must be unique."""
    return digest(seed, key)


def row_seed(key: Column, seed: str, *, bits: int = 31) -> Column:
    """An integer seed below 2**bits (at most 32) for a row."""
    return number(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)) % (1 << bits)
