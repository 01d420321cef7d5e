"""Filling containers of fixed capacity by the sum-of-squares rule.

Documents come in a seeded order. Each goes to the fill level, a new container included, that leaves the smallest sum of
squared counts of partly filled containers; the counts are one array over the levels. Shards of SHARD_PIECES pieces are
packed apart from each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftara.llm.tokens import TOKENIZER, count_tokens
from siftara.storage import materialize

CAPACITY = 2048
#: Pieces that one task packs. What a shard leaves open at its end is its only loss beside the rule's own.
SHARD_PIECES = 50_000
#: Tokens that one fill level spans; containers keep their exact fill.
GRAIN = 1


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY, grain: int = GRAIN) -> np.ndarray:
    """The container of each size, numbered from 0, sizes placed in the given order; each must be 1 to ``capacity``.

    A container of level L holds more than (L - 1) * grain and at most L * grain tokens. One that has less than ``grain``
    tokens left is closed and no longer counted.
    """
    closed = capacity // grain
    count = np.zeros(closed + 1, dtype=np.int64)
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(closed + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        step = -(-size // grain)
        fitting = (capacity - size) // grain  # levels up to this one have room for sure
        # change of the sum of squares: one container leaves level L and one comes to level L + step, if that is open
        change = 1 - 2 * count[1 : fitting + 1] + np.where(np.arange(1, fitting + 1) + step < closed, 2 * count[1 + step : fitting + 1 + step] + 1, 0)
        change[count[1 : fitting + 1] == 0] = np.iinfo(np.int64).max
        fresh = 2 * count[step] + 1 if step < closed else 0
        level = int(np.argmin(change)) + 1 if fitting >= 1 else 0
        if fitting >= 1 and change[level - 1] <= fresh:
            box, held = open_at[level].pop()
            count[level] -= 1
        else:
            box, held = made, 0
            made += 1
        out[i] = box
        level = -(-(held + size) // grain)
        if level < closed:
            open_at[level].append((box, held + size))
            count[level] += 1
    return out


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, seed: str = "pack", grain: int = GRAIN) -> DataFrame:
    """One row for each piece of a document: ``key``, piece, container, first_token, tokens, document_tokens.

    A document larger than ``capacity`` is cut into full containers and a rest; any other is one piece. Documents
    without tokens (null or empty text) take no room: one row with a null container. Repeated rows are packed each for
    itself; a null ``key`` is a value like any other. Columns besides the two are ignored.
    """
    sizes = materialize(count_tokens(documents, key, text, tokenizer), "pack-sizes")
    size = F.col("tokens")
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / capacity).cast("int") - 1))).alias("piece")
    pieces = sizes.select(F.col(f"`{key}`").alias("doc"), size.alias("document_tokens"), piece)
    pieces = pieces.withColumn("first_token", F.col("piece").cast("long") * capacity).withColumn("tokens", F.least(F.lit(capacity), F.col("document_tokens") - F.col("first_token")).cast("int"))
    some = pieces.where("tokens > 0").withColumn("turn", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc").cast("string"), "piece")))
    shards = max(1, -(-some.count() // SHARD_PIECES))
    kind = dict(documents.dtypes)[key]

    def pack_shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "document_tokens"], kind="stable")
        boxes = pack_sizes(group["tokens"].to_numpy(), capacity, grain)
        return group.assign(container=group["shard"].to_numpy() * (1 << 32) + boxes)[["doc", "piece", "container", "first_token", "tokens", "document_tokens"]]

    packed = some.withColumn("shard", F.pmod(F.xxhash64("turn"), F.lit(shards))).groupBy("shard").applyInPandas(pack_shard, f"doc {kind}, piece int, container long, first_token long, tokens int, document_tokens long")
    none = pieces.where("tokens = 0").select("doc", "piece", F.lit(None).cast("long").alias("container"), "first_token", "tokens", "document_tokens")
    return packed.unionByName(none).withColumnRenamed("doc", key)


def oversize(packed: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The documents that had to be split, each once."""
    return packed.where((F.col("piece") == 0) & (F.col("document_tokens") > capacity)).select(key)
