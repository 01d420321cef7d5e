import random
from collections import Counter

import pytest

from siftara.llm.overlap import SplitOverlap, plain_lines, search_key

SCHEMA = "case_id long, case_key string, original string, search string, source string, split string, lines string"


def brute(rows):
    out = set()
    for t in (r for r in rows if r[5] == "train"):
        for e in (r for r in rows if r[5] is not None and r[5] != "train"):
            a, b = set(plain_lines(t[2])), set(plain_lines(e[2]))
            lost = [x[2] is None or not x[2].strip() for x in (t, e)]
            alike = bool(a and b) and len(a & b) >= 0.6 * len(a | b)
            keys = [search_key(x[3]) for x in (t, e)]
            if (t[1] is not None and t[1] == e[1]) or alike or (any(lost) and keys[0] is not None and keys[0] == keys[1]):
                out.add((t[0], e[0]))
    return out


def found(spark, rows):
    return {tuple(r) for r in SplitOverlap(spark.createDataFrame(rows, SCHEMA)).pairs().collect()}


def records(n, seed, copies=0.0):
    rng = random.Random(seed)
    helpers = [f"def helper_{i}(): return {i}" for i in range(6)]
    base = [[f"x_{k}_{i} = {rng.randrange(99)}" for i in range(rng.randrange(1, 12))] for k in range(max(1, n // 4))]
    out = []
    for i in range(n):
        own = list(base[0] if rng.random() < copies else rng.choice(base)) + rng.sample(helpers, rng.randrange(4))
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"y = {rng.randrange(10**6)}"
        text = "\n".join(rng.choice([line, line.upper(), "  " + line, line + "  # note"]) for line in own)
        block = rng.choice(["a\nb\nc", "A \n b\n\n c", "a\nb", "d\ne\nf", None])
        out.append((i, rng.choice([f"k{rng.randrange(n)}", None]), rng.choice([text] * 9 + [None, " "]), block, "s", rng.choice(["train", "train", "val", "test", None]), "extra"))
    return out


@pytest.mark.parametrize(("n", "seed", "copies"), [(80, 1, 0), (120, 2, 0.5)])
def test_pairs_are_brute_force(spark, n, seed, copies):
    rows = records(n, seed, copies)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize(("shards", "common"), [(1000, 2), (0, 100), (1000, 0)])
def test_shards_and_common_lines_do_not_matter(spark, monkeypatch, shards, common):
    rows = records(60, 4, 0.3)
    monkeypatch.setattr("siftara.llm.overlap.SHARD_CHARS", 700)
    monkeypatch.setattr("siftara.llm.overlap.MOST_SHARDS", shards)
    monkeypatch.setattr("siftara.llm.overlap.COMMON", common)
    monkeypatch.setattr("siftara.llm.overlap.BROADCAST_CLASSES", 0)
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    assert found(spark, []) == set()
    same = "a = 1\nb = 2\nc = 3"
    rows = [
        (1, None, same, None, None, "train", None), (1, None, same, None, None, "train", None), (2, None, same, None, None, "val", None),
        (3, None, "# only a note", None, None, "train", None), (4, None, "# only a note", None, None, "val", None), (5, None, None, None, None, "val", None), (6, None, "z" * 200_000, None, None, "val", None), (7, None, "z" * 200_000, None, None, "train", None),
    ]
    assert found(spark, rows) == {(1, 2), (7, 6)}


def test_plain_lines():
    code = '"""Doc\nover lines."""\nx = "#no"  # note\r\n\n  X = "#no"\n\'\'\'\nq\n\'\'\'\ny = \'a # b\' # c'
    assert plain_lines(code) == ['x="#no"', "y='a#b'"]
    assert plain_lines(None) == [] and search_key("a\n\nb") is None and search_key("a\nb\nC") == search_key(" A\n\n b\nc ")


def test_report_counts_every_evaluation_record(spark):
    rows = records(60, 5)
    pairs = Counter(e for _, e in brute(rows))
    got = SplitOverlap(spark.createDataFrame(rows, SCHEMA)).report().collect()
    assert sum(r["records"] for r in got) == sum(r[5] in ("val", "test") for r in rows)
    assert sum(r["overlapping"] for r in got) == len(pairs) and sum(r["pairs"] for r in got) == sum(pairs.values())


def with_sources(n, seed):
    rng = random.Random(seed)
    return [(*r[:4], rng.choice(["one", "two", "three", None]), *r[5:]) for r in records(n, seed)]


def test_report_names_training_sources(spark):
    rows = with_sources(80, 6)
    at = {r[0]: r for r in rows}
    pairs = brute(rows)
    wanted = {}
    for s in {at[e][4:6] for _, e in pairs}:
        for t in {at[t][4] for t, e in pairs if at[e][4:6] == s}:
            own = [e for a, e in pairs if at[e][4:6] == s and at[a][4] == t]
            wanted[s[1], s[0], t] = (len(set(own)), len(own))
    got = SplitOverlap(spark.createDataFrame(rows, SCHEMA)).report().collect()
    assert {(r["split"], r["source"], x["train_source"]): (x["overlapping"], x["pairs"]) for r in got for x in r["train_sources"]} == wanted
    assert sum(r["pairs"] for r in got) == sum(x["pairs"] for r in got for x in r["train_sources"]) == len(pairs) and sum(r["overlapping"] for r in got) == len({e for _, e in pairs})


def test_coverage_merges_all_partners(spark):
    line = [f"{c} = {c * 9}" for c in "abcdef"]
    text = lambda s: "\n".join(line["abcdef".index(c)] for c in s)
    rows = [(1, "k", text("abcd"), None, "s", "val", ""), (2, None, text("abc"), None, "s", "train", ""), (3, None, text("bcd"), None, "s", "train", ""), (4, "m", text("abcdef"), None, "s", "test", ""), (5, "m", text("af"), None, "s", "train", ""), (6, "n", None, None, "s", "test", ""), (7, "n", text("f"), None, "s", "train", "")]
    whole = SplitOverlap(spark.createDataFrame(rows, SCHEMA))
    assert {r["eval_id"]: (r["partners"], r["coverage"]) for r in whole.covered().collect()} == {1: (2, 1.0), 4: (1, pytest.approx(1 / 3)), 6: (1, None)}
    assert {r["split"]: r["mean_coverage"] for r in whole.report().collect()} == {"val": 1.0, "test": pytest.approx(1 / 3)}


@pytest.mark.parametrize("seed", [7])
def test_coverage_is_brute_force(spark, seed):
    rows = records(80, seed, 0.4)
    lines = {r[0]: plain_lines(r[2]) for r in rows}
    wanted = {}
    for t, e in brute(rows):
        wanted.setdefault(e, []).append(t)
    share = lambda e, ts: sum(len(x) for x in lines[e] if any(x in lines[t] for t in ts)) / sum(map(len, lines[e])) if lines[e] and any(lines[t] for t in ts) else None
    got = {r["eval_id"]: r["coverage"] for r in SplitOverlap(spark.createDataFrame(rows, SCHEMA)).covered().collect()}
    assert got == {e: share(e, ts) if share(e, ts) is None else pytest.approx(share(e, ts)) for e, ts in wanted.items()}
