import os

from siftara.skew import broadcast_checked, fits, heavy_keys, salted_join, split_join
from siftara.storage import discard, materialize


def test_split_and_salted_joins_are_plain_joins(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k long, x long")
    keys = spark.createDataFrame([(k, k * 2) for k in range(0, 300, 2)] + [(1, 7)], "k long, y long")
    heavy = heavy_keys(rows.groupBy("k").count(), ["k"], "count").where("k is not null")
    assert 1 in [r[0] for r in heavy.collect()]
    for how in ("inner", "left_semi", "left_anti"):
        plain = sorted(map(tuple, rows.where("k is not null").join(keys, "k", how).collect()))
        assert sorted(map(tuple, split_join(rows.where("k is not null"), keys, heavy, ["k"], how).collect())) == plain
    outer = lambda d: sorted(map(tuple, d.select("k", "x", "y").collect()), key=repr)
    assert outer(split_join(rows, keys, heavy, ["k"], "left")) == outer(rows.join(keys, "k", "left"))
    twice = keys.unionByName(keys)
    assert sorted(map(tuple, salted_join(rows, twice, heavy, ["k"]).collect())) == sorted(map(tuple, rows.join(twice, "k").collect()))


def test_broadcast_only_when_small(spark):
    plan = lambda d: spark.range(10).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(broadcast_checked(spark.range(5), 5)) and "broadcast" not in plan(broadcast_checked(spark.range(6), 5))


def test_a_side_is_broadcast_by_rows_and_bytes(spark):
    wide = spark.range(3).selectExpr("repeat('x', 1000) as t", "cast('y' as binary) as b", "array(1, 2) as c")
    assert fits(wide, 3, 10_000) and not fits(wide, 3, 2_000) and not fits(wide, 2) and fits(wide.limit(0), 0)


def test_tables_are_discarded(spark):
    held = materialize(spark.range(5), "x")
    assert held.count() == 5 and held.inputFiles()
    other = held.inputFiles()[0].removeprefix("file://")
    discard(held)
    assert not os.path.exists(other)
