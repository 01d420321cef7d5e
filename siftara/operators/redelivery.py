"""Messages delivered more than once: keep exactly one copy of each identifier.

Messages are stored by time bucket. Each bucket has Bloom filters of its identifiers, cut into shards by identifier hash
and saved beside it. An identifier that no filter knows is new for certain and is compared with nothing. The
others are possible repeats: they are verified exactly, against the storage of the buckets whose filters know them and of
no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.skew import broadcast_checked, heavy_keys, split_join
from siftara.storage import child, file_system, materialize, new_path

BUCKET_DAYS = 7
BITS_PER_ID = 12
PROBES = 6
#: Messages in one shard of the filters; bounds what a task holds at once.
SHARD_IDS = 1_000_000
#: Bucket of rows without a time; they count as the latest.
NO_TIME = 2**31 - 1
#: Identifier hashes, of 12 bytes with their bucket, up to which the possible repeats are broadcast.
BROADCAST_IDS = 1_000_000


def message_key(identifier: Column) -> Column:
    """Identifier without letter case and the blanks, tabs and line ends around it; null where nothing is left."""
    return F.nullif(F.btrim(F.lower(identifier), F.lit(" \t\r\n")), F.lit(""))


def _slots(ids: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bit positions of each identifier hash, one probe at a time (double hashing; ``size`` is a power of two)."""
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64)
        step = ((x >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        at = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        for _ in range(PROBES):
            yield (at >> np.uint64(20)) & np.uint64(size - 1)
            at = at + step


def build_filter(ids: np.ndarray) -> bytes:
    """Bloom filter of the hashes, as packed bits; the length is a power of two with at least BITS_PER_ID bits each."""
    size = 1 << max(6, int(len(ids) * BITS_PER_ID - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    for slot in _slots(ids, size):
        bits[slot] = True
    return np.packbits(bits).tobytes()


def probe_filter(packed: bytes, ids: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; never False for one that is."""
    words = np.frombuffer(packed, dtype=np.uint8)
    hit = np.ones(len(ids), dtype=bool)
    at = np.arange(len(ids))
    for slot in _slots(ids, len(words) * 8):
        s = slot[at]
        ok = (words[(s >> np.uint64(3)).astype(np.int64)] >> (7 - (s & np.uint64(7)).astype(np.uint8))) & 1
        hit[at[ok == 0]] = False
        at = at[ok == 1]
    return hit


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each identifier hash and bucket once for each batch of rows, with whether it came again; so that a hot identifier is small before the shuffle."""
    for batch in batches:
        frame = batch.to_pandas()
        n = frame.groupby(["id_hash", "bucket"]).size().reset_index(name="n")
        yield pa.RecordBatch.from_arrays([pa.array(n["id_hash"], pa.int64()), pa.array(n["bucket"], pa.int32()), pa.array(n["n"] > 1, pa.bool_())], ["id_hash", "bucket", "again"])


def add_and_probe(key: tuple, own: pd.DataFrame, saved: pd.DataFrame) -> pd.DataFrame:
    """One shard of an arriving batch: filters of its buckets, made as its identifiers come, and the possible repeats.

    ``own`` has id_hash, bucket and again, ``saved`` the bits of earlier filters with their bucket. Buckets are taken
    in order of time: identifiers that a saved filter or that of an earlier bucket of the batch knows, or that come again
    in their own bucket, are possible repeats, with every bucket that may hold them. The last rows are the new filters.
    """
    # a bucket's identifiers stand together, and copies in a bucket side by side
    order = np.lexsort((own["id_hash"].to_numpy(), own["bucket"].to_numpy()))
    ids, buckets, again = own["id_hash"].to_numpy()[order], own["bucket"].to_numpy()[order], own["again"].to_numpy(dtype=bool)[order]
    twice = np.zeros(len(ids), dtype=bool)
    twice[1:] = (ids[1:] == ids[:-1]) & (buckets[1:] == buckets[:-1])
    found = [(ids[twice | again], buckets[twice | again])]
    ids, buckets = ids[~twice], buckets[~twice]
    filters = list(zip(saved["bucket"].tolist(), saved["bits"]))
    made: list[tuple[int, bytes]] = []
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(ids) else []
    for a, b in zip(starts, [*starts[1:], len(ids)]):
        part, bucket = ids[a:b], int(buckets[a])
        for at, packed in filters:
            hit = part[probe_filter(packed, part)]
            found += [(hit, np.full(len(hit), bucket)), (hit, np.full(len(hit), at))]
        made.append((bucket, build_filter(part)))
        filters.append(made[-1])
    possible = pd.DataFrame({"id_hash": np.concatenate([x for x, _ in found]), "bucket": np.concatenate([x for _, x in found])}).drop_duplicates()
    new = pd.DataFrame({"id_hash": np.zeros(len(made), dtype=np.int64), "bucket": [x for x, _ in made], "bits": [x for _, x in made]})
    return pd.concat([possible.assign(bits=None), new]).assign(shard=key[0])[["id_hash", "bucket", "shard", "bits"]].astype({"id_hash": "int64", "bucket": "int32", "shard": "int32"})


class MessageStore:
    """Messages by time bucket with the filters of their identifiers, in a folder that lasts.

    ``messages`` holds identifier, time and order column of every message in a folder for each batch and bucket, ``filters`` the filters of each batch. Both
    only grow. A batch counts once its marker stands in ``batches``; parts without one are left over from a batch that failed, and are not read. Batches
    come one after the other. The number of shards is that of the first opening.

    Rows whose identifier is null or blank are messages of their own and are not stored. A null time counts as the latest. Rows alike in all three
    columns count as one delivery. Other columns, whatever their names, are not read.
    """

    def __init__(self, spark: SparkSession, path: str, identifier: str, time: str, order: str, *, bucket_days: int = BUCKET_DAYS, shards: int = 1):
        self.spark, self.path, self.order = spark, path, order
        fs, p = file_system(spark, f"{path}/settings")
        known = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        if not known:
            known = [f"{shards}-{bucket_days}"]
            fs.create(child(spark, p, known[0]), True).close()
        self.shards, days = map(int, known[0].split("-"))
        width = days * 86_400_000_000
        self.key = message_key(F.col(f"`{identifier}`"))
        self.id_hash = F.xxhash64(self.key)
        self.bucket = F.coalesce(F.floor(F.unix_micros(F.col(f"`{time}`").cast("timestamp")) / width).cast("int"), F.lit(NO_TIME))
        self.rank = F.struct(F.col(f"`{time}`").isNull().alias("late"), F.col(f"`{time}`").alias("at"), F.col(f"`{order}`").isNull().alias("last"), F.col(f"`{order}`").alias("by"))

    def _names(self, folder: str) -> list[str]:
        fs, p = file_system(self.spark, folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def batches(self) -> list[int]:
        return sorted(map(int, self._names(f"{self.path}/batches")))

    def add(self, messages: DataFrame) -> DataFrame:
        """Store a batch; returns id_hash and bucket of its possible repeats: where they came in and wherever they may stand."""
        before = self.batches()
        number = max(before, default=-1) + 1
        slim = messages.select(self.key.alias("key"), self.id_hash.alias("id_hash"), self.rank.alias("rank"), self.bucket.alias("bucket")).where("key is not null")
        place = f"{self.path}/messages/batch={number}"
        slim.repartition("bucket", F.pmod("id_hash", F.lit(self.shards))).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(place)
        own = self.spark.read.schema(slim.select("id_hash", "bucket").schema).parquet(place).mapInArrow(combine, "id_hash long, bucket int, again boolean")
        kind = "bucket int, shard int, bits binary"
        saved = self.spark.read.schema(kind).parquet(*[f"{self.path}/filters/batch={n}" for n in before]) if before else self.spark.createDataFrame([], kind)
        sharded = own.withColumn("shard", F.pmod("id_hash", F.lit(self.shards)).cast("int"))
        screened = sharded.groupBy("shard").cogroup(saved.groupBy("shard")).applyInPandas(add_and_probe, "id_hash long, bucket int, shard int, bits binary")
        screened = materialize(screened, "repeat-screen")
        screened.where("bits is not null").select("bucket", "shard", "bits").write.mode("overwrite").parquet(f"{self.path}/filters/batch={number}")
        fs, p = file_system(self.spark, f"{self.path}/batches/{number}")
        fs.create(p, True).close()
        self._schema = slim.drop("bucket").schema
        return screened.where("bits is null").select("id_hash", "bucket")

    def stored(self, buckets: set[int]) -> DataFrame | None:
        """key, id_hash, rank and bucket of the stored messages of some buckets; only their files are listed and read. None where there are none."""
        places = [f"{self.path}/messages/batch={n}/{name}" for n in self.batches() for name in self._names(f"{self.path}/messages/batch={n}") if name.startswith("bucket=") and int(name[7:]) in buckets]
        if not places:
            return None
        rows = self.spark.read.schema(self._schema).option("basePath", f"{self.path}/messages").parquet(*places)
        return rows.select("key", "id_hash", "rank", F.col("bucket").cast("int").alias("bucket"))

    def matching(self, possible: DataFrame) -> DataFrame | None:
        """key and rank of the stored messages that may be repeats; only buckets that a filter pointed at are read. None where there are none."""
        rows = self.stored({r[0] for r in possible.select("bucket").distinct().collect()})  # one row a bucket of time
        if rows is None:
            return None
        narrow = broadcast_checked(possible, BROADCAST_IDS, held=True)
        if narrow is not possible:
            return rows.join(narrow, ["id_hash", "bucket"], "left_semi").select("key", "rank")
        heavy = heavy_keys(rows.groupBy("id_hash", "bucket").agg(F.count("*").alias("n")), ["id_hash", "bucket"], "n")
        return split_join(rows, possible, heavy, ["id_hash", "bucket"], "left_semi").select("key", "rank")

    def surplus(self, possible: DataFrame) -> DataFrame:
        """One column, the order column: every copy but the earliest (smallest order value at a tie) of the messages that ``possible`` points at. A copy
        that came in an earlier batch is in it when an earlier one came later."""
        rows = self.matching(possible)
        if rows is None:
            return self.spark.createDataFrame([], self._schema).select(F.col("rank.by").alias(self.order))
        kept = rows.groupBy("key").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
        often = heavy_keys(kept, ["key"], "n")
        return split_join(rows, kept.drop("n"), often, ["key"]).where("rank <> first").select(F.col("rank.by").alias(self.order)).distinct()


def _stored(messages: DataFrame, identifier: str, time: str, order: str, bucket_days: int) -> tuple[MessageStore, DataFrame]:
    """A store of the session that holds ``messages`` as its only batch, and the possible repeats."""
    shards = max(1, -(-messages.count() // SHARD_IDS))
    store = MessageStore(messages.sparkSession, new_path(messages.sparkSession, "messages"), identifier, time, order, bucket_days=bucket_days, shards=shards)
    return store, store.add(messages)


def surplus_copies(messages: DataFrame, identifier: str = "run_id", time: str = "received_at", order: str = "delivery_id", *, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """One column, the order column: every copy but the earliest (smallest order value at a tie) of each message.

    The order column is unique but for repeated rows. Rows without identifier are messages of their own.
    """
    store, possible = _stored(messages, identifier, time, order, bucket_days)
    return store.surplus(possible)


def keep_first(messages: DataFrame, identifier: str = "run_id", time: str = "received_at", order: str = "delivery_id", *, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``messages`` with exactly one row for each identifier and every row without identifier. Rows that no filter knows pass as they are; only the possible repeats are shuffled with all their columns."""
    store, possible = _stored(messages, identifier, time, order, bucket_days)
    names = messages.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    marked = messages.select(store.key.alias("key"), store.id_hash.alias("id_hash"), store.bucket.alias("bucket"), store.rank.alias("rank"), row)
    known = marked.where("key is not null")
    narrow = broadcast_checked(possible, BROADCAST_IDS, held=True)
    if narrow is possible:
        heavy = heavy_keys(known.groupBy("id_hash", "bucket").agg(F.count("*").alias("n")), ["id_hash", "bucket"], "n")
        repeats, new = (split_join(known, narrow, heavy, ["id_hash", "bucket"], how) for how in ("left_semi", "left_anti"))
    else:
        repeats, new = (known.join(narrow, ["id_hash", "bucket"], how) for how in ("left_semi", "left_anti"))
    first = repeats.groupBy("key").agg(F.min_by("row", "rank").alias("row"))
    return reduce(DataFrame.unionByName, [x.select("row.*") for x in (first, new, marked.where("key is null"))])
