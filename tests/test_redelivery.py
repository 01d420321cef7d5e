import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftara.operators.redelivery import MessageStore, build_filter, keep_first, probe_filter, surplus_copies

SCHEMA = "delivery_id long, run_id string, received_at timestamp, bucket int, rank string"


def brute(rows):
    best, seen = {}, {}
    for d, run, at, *_ in rows:
        key = run.lower().strip(" \t\r\n") if run else ""
        if key:
            seen.setdefault(key, set()).add(d)
            order = (at is None, at or datetime.min, d)
            best[key] = min(best.get(key, (order, d)), (order, d))
    return {d for k, ds in seen.items() for d in ds if d != best[k][1]}


def messages(n, ids, seed, hot=0.0):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    out = []
    for i in range(n):
        run = "HOT" if rng.random() < hot else f"r{rng.randrange(ids)}"
        run = rng.choice([run, run.upper(), f" {run}\t", f"{run}\n", None if rng.random() < 0.1 else run])
        at = None if rng.random() < 0.05 else start + timedelta(hours=rng.randrange(24 * 90))
        out.append((i, run, at, 1, "x"))
    return out


def test_filter_never_misses():
    ids = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    packed = build_filter(ids)
    assert probe_filter(packed, ids).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63, 5000)
    assert probe_filter(packed, others).mean() < 0.02


@pytest.mark.parametrize(("n", "ids", "hot"), [(400, 150, 0), (600, 500, 0.4), (50, 1000, 0)])
def test_surplus_is_brute_force(spark, n, ids, hot):
    rows = messages(n, ids, n, hot)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0] for r in surplus_copies(df).collect()} == brute(rows)
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert {r["delivery_id"] for r in kept.collect()} == {r[0] for r in rows} - brute(rows)


def test_shards_do_not_matter(spark, monkeypatch):
    rows = messages(500, 200, 9)
    monkeypatch.setattr("siftara.operators.redelivery.SHARD_IDS", 40)
    assert {r[0] for r in surplus_copies(spark.createDataFrame(rows, SCHEMA), bucket_days=1).collect()} == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert surplus_copies(empty).collect() == [] and keep_first(empty).collect() == []
    nulls = spark.createDataFrame([(1, None, None, None, None), (2, None, None, None, None), (3, " \t", None, None, None)], SCHEMA)
    assert surplus_copies(nulls).collect() == [] and keep_first(nulls).count() == 3
    at = datetime(2026, 1, 1)
    tie = spark.createDataFrame([(5, "a", at, 1, ""), (4, "A ", at, 1, ""), (4, "A ", at, 1, "")], SCHEMA)
    assert [r[0] for r in surplus_copies(tie).collect()] == [5] and [r["delivery_id"] for r in keep_first(tie).collect()] == [4]


def test_most_messages_are_not_compared(spark, tmp_path):
    rows = [(i, f"r{i}", datetime(2026, 1, 1) + timedelta(hours=i), 1, "") for i in range(2000)]
    store = MessageStore(spark, str(tmp_path / "s"), "run_id", "received_at", "delivery_id")
    assert store.add(spark.createDataFrame(rows, SCHEMA)).count() < 100


def test_batches_meet_saved_filters_and_read_only_matching_buckets(spark, tmp_path):
    """The second batch is opened anew: it is screened by the saved filters, and of 30 stored weeks only those of its repeats are read."""
    start = datetime(2026, 1, 1)
    old = [(i, f"r{i}", start + timedelta(days=i // 10), 1, "x") for i in range(2000)]
    new = [(5000, " R7", start + timedelta(days=195), 1, ""), (5001, "r1500\t", start - timedelta(days=400), 1, ""), (5002, "fresh", start + timedelta(days=196), 1, "")]
    open_ = lambda: MessageStore(spark, str(tmp_path / "s"), "run_id", "received_at", "delivery_id", shards=3)
    first = open_()
    assert {r[0] for r in first.surplus(first.add(spark.createDataFrame(old, SCHEMA))).collect()} == set()
    store = open_()
    possible = store.add(spark.createDataFrame(new, SCHEMA))
    assert {r[0] for r in store.surplus(possible).collect()} == {5000, 1500}  # the stored copy of r1500 came later than the new one
    read, held = len(store.matching(possible).inputFiles()), sum(f.endswith(".parquet") for _, _, fs in os.walk(tmp_path / "s/messages") for f in fs)
    assert held > 29 and read < held / 3
    assert store.batches() == [0, 1]


def test_batches_are_as_one(spark, tmp_path):
    rows = messages(400, 120, 5, 0.2)
    store = MessageStore(spark, str(tmp_path / "s"), "run_id", "received_at", "delivery_id", shards=2)
    said = set()
    for part in (rows[:150], rows[150:300], rows[300:], []):
        said |= {r[0] for r in store.surplus(store.add(spark.createDataFrame(part, SCHEMA))).collect()}
    assert said == brute(rows)
