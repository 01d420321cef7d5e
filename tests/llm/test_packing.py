import random
from collections import defaultdict

import numpy as np
import pytest

from siftara.llm.packing import oversize, pack, pack_sizes
from siftara.llm.tokens import count_one


@pytest.mark.parametrize("grain", [1, 4, 32])
def test_no_container_overflows_and_little_room_is_left(grain):
    rng = np.random.default_rng(grain)
    sizes = np.minimum(2048, rng.lognormal(5.7, 0.8, 8000).astype(int) + 1)
    boxes = pack_sizes(sizes, 2048, grain)
    fill = np.bincount(boxes, sizes)
    assert fill.max() <= 2048 and boxes.max() + 1 == len(fill) and (fill > 0).all()
    assert sizes.sum() / (2048 * len(fill)) > (0.97 if grain > 4 else 0.99)


@pytest.mark.parametrize("sizes", [[], [2048], [1], [2048, 1, 2047, 1024, 1024], [700] * 9])
def test_small_cases(sizes):
    boxes = pack_sizes(np.array(sizes, dtype=np.int64))
    fill = defaultdict(int)
    for b, s in zip(boxes, sizes):
        fill[b] += s
    assert all(f <= 2048 for f in fill.values()) and len(boxes) == len(sizes)


def test_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["one", "container", "12", "más"]) for _ in range(rng.choice([3, 50, 400, 3000])))) for i in range(120)] + [(900, None), (901, ""), (None, "no id"), (902, "x" * 30_000), (5, "again")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, tokens int, container int")
    got = pack(df).collect()
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        if r["container"] is not None:
            fill[r["container"]] += r["tokens"]
        pieces[r["doc_id"], r["document_tokens"]].append((r["first_token"], r["tokens"]))
    assert max(fill.values()) <= 2048
    assert sorted((k, t) for (k, t) in pieces if k is not None) == sorted({(k, count_one(t)) for k, t in rows if k is not None})
    for (_, total), own in pieces.items():
        own.sort()
        assert sum(t for _, t in own) == total and all(t == 2048 for _, t in own[:-1]) and (total <= 2048) == (len(own) == 1)
    assert {r["doc_id"] for r in oversize(pack(df)).collect()} == {k for k, t in rows if count_one(t) > 2048}
    assert pack(df.limit(0)).collect() == []
    assert sorted(map(tuple, pack(df.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
