import random

import pytest

from siftara.llm.grouped_splits import GroupedSplits

SCHEMA = "case_id long, case_group string, stem string, label string, node string"


def plain(stem):
    s = (stem or "").strip().lower().replace("\\", "/").rsplit("/", 1)[-1].strip()
    s = s[:-3] if s.endswith(".py") else s
    return (s[5:] if s.startswith("test_") else s) or None


def roots(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, g, s, *_ in rows:
        nodes = [n for n in (("g", g), ("s", plain(s))) if n[1] is not None]
        for n in nodes:
            parent[find(n)] = find(nodes[0])
    best = {}
    for n in list(parent):
        if n[0] == "g":
            best[find(n)] = min(best.get(find(n), n[1]), n[1])
    return {r[0]: best.get(find(("g", r[1]) if r[1] is not None else ("s", plain(r[2])))) if r[1] is not None or plain(r[2]) else None for r in rows}


def records(n, groups, stems, seed, hot=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = f"stem{rng.randrange(stems)}"
        s = rng.choice([s, f"src/{s}.py", f" TEST_{s} ", f"./a\\b/test_{s}.PY", None, ""])
        g = "hot" if rng.random() < hot else rng.choice([f"g{rng.randrange(groups)}"] * 5 + [None])
        out.append((i, g, s, "x", "y"))
    return out


@pytest.mark.parametrize(("n", "groups", "stems", "hot"), [(300, 200, 250, 0), (400, 100, 900, 0.4), (200, 10, 10, 0)])
def test_roots_are_brute_force(spark, n, groups, stems, hot):
    rows = records(n, groups, stems, n, hot)
    want = {k: r for k, r in roots(rows).items() if r is not None}
    found = {r["case_id"]: r["root_group"] for r in GroupedSplits(spark.createDataFrame(rows, SCHEMA)).moved().collect()}
    assert found == {k: want[k] for k, g, *_ in rows if k in want and g != want[k]}


def test_long_chain_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr("siftara.llm.grouped_splits.SMALL_EDGES", 5)
    rows = [(2 * i + k, f"g{i:03}", f"s{i + k}", "", "") for i in range(60) for k in (0, 1)]
    got = GroupedSplits(spark.createDataFrame(rows, SCHEMA)).moved().collect()
    assert {r["root_group"] for r in got} == {"g000"} and len(got) == 118


def test_splits(spark):
    rows = records(3000, 900, 1500, 8, 0.1)
    df = spark.createDataFrame(rows, SCHEMA)
    splits = GroupedSplits(df)
    got = {r["case_id"]: (r["root_group"], r["split"]) for r in splits.assign({"train": 0.8, "val": 0.1, "test": 0.1}).collect()}
    assert len(got) == 3000
    parts = {}
    for root, split in got.values():
        if root is not None:
            assert parts.setdefault(root, split) == split
    share = {s: sum(x[1] == s for x in got.values()) / 3000 for s in ("train", "val", "test")}
    assert share["train"] == pytest.approx(0.8, abs=0.04) and share["val"] == pytest.approx(0.1, abs=0.04)
    again = {r["case_id"]: (r["root_group"], r["split"]) for r in GroupedSplits(df.repartition(5)).assign({"train": 0.8, "val": 0.1, "test": 0.1}).collect()}
    assert again == got


def test_edges(spark):
    empty = GroupedSplits(spark.createDataFrame([], SCHEMA))
    assert empty.moved().collect() == [] and empty.assign().collect() == []
    rows = [(1, None, None, None, None), (2, None, "", None, None), (None, "b", "t.py", None, None), (4, None, "T", None, None), (4, None, "T", None, None), (5, "a" * 100_000, None, None, None)]
    splits = GroupedSplits(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in splits.moved().collect()] == [(4, "b"), (4, "b")] and splits.assign().count() == 6
