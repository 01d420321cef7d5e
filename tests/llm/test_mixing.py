import random

import pytest

from siftara.llm.mixing import Mixture, allot, route

ITEMS, SOURCES, TARGETS = "example_id string, source string, weight string", "source_key string, hf_id string, role string, cap long", "mix_id int, source_key string, weight double, max_repeats int"


def mixture(spark, items, sources, targets):
    return Mixture(spark.createDataFrame(items, ITEMS), spark.createDataFrame(sources, SOURCES), spark.createDataFrame(targets, TARGETS))


def test_flow_repeats_only_when_nothing_is_fresh():
    got, uses = route({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 10.0, "b": 12.0}, {"a": 3, "b": 2}, {"a": 20, "b": 12})
    assert got == pytest.approx({"a": 10, "b": 12})
    assert uses.get((("a",), "a", 1)) == pytest.approx(10) and all(r == 1 for _, _, r in uses)  # b takes what both hold
    got, _ = route({("a",): 5}, {"a": 99.0}, {"a": 3}, {"a": 4})
    assert got["a"] == pytest.approx(12)  # three uses of four examples


@pytest.mark.parametrize("seed", range(2))
def test_short_sources_and_selection(spark, seed):
    rng = random.Random(seed)
    names = ["one_a", "two_b", "three_c", "four_d"]
    sources = [(n, f"Hub/{n}", "heldout" if n == "four_d" else "train", rng.choice([None, 8, 500])) for n in names]
    items = [(f"e{rng.randrange(150)}", rng.choice([rng.choice(names), rng.choice(names).upper().replace("_", " "), f"hub/{rng.choice(names)}", "else", None]), "x") for _ in range(400)] + [(None, "one_a", "x")]
    targets = [(m, n, rng.choice([None, 0.0, 0.5, 1.0, 3.0]), rng.choice([1, 2, 5])) for m in range(4) for n in names]
    mix = mixture(spark, items, sources, targets)
    plain = lambda s: s.strip().lower().replace("_", "-").replace(" ", "-")
    held = {n: {e for e, s, _ in items if e and s and plain(s) in (plain(n), plain(f"hub/{n}"))} for n in names}
    cap = {n: c for n, _, _, c in sources}
    size = {n: len(held[n]) if cap[n] is None else min(cap[n], len(held[n])) for n in names}
    short, goal = set(), {}
    for m in range(4):
        part = [(n, w, r) for k, n, w, r in targets if k == m and w and n != "four_d"]
        for n, w, r in part:
            goal[m, n] = (w / sum(x[1] for x in part) * sum(size[x[0]] for x in part), r)
            if r * size[n] < goal[m, n][0] - 1e-9:
                short.add((m, n))
    assert {tuple(r) for r in mix.short_sources().collect()} == short
    chosen: dict = {}
    for r in mix.select().collect():
        assert r["example_id"] in held[r["source_key"]] and 1 <= r["copies"] <= goal[r["mix_id"], r["source_key"]][1]
        chosen.setdefault((r["mix_id"], r["source_key"]), {})[r["example_id"]] = r["copies"]
    patterns = 2 ** len(names)
    for k, (want, repeats) in goal.items():
        got = chosen.get(k, {})
        assert abs(sum(got.values()) - min(want, repeats * size[k[1]])) <= patterns  # rounding of one a pattern and level
        assert len(got) <= size[k[1]] + patterns
    again = {(r["mix_id"], r["source_key"], r["example_id"]) for r in mixture(spark, items[::-1], sources, targets).select().collect()}
    assert again == {(*k, e) for k, v in chosen.items() for e in v}


def test_edges(spark):
    mix = mixture(spark, [], [("a", None, "train", None)], [(1, "a", 1.0, None), (None, "a", 1.0, 1)])
    assert mix.select().collect() == [] and mix.short_sources().collect() == []
    mix = mixture(spark, [("e", "a", "")], [], [])
    assert mix.shares.collect() == []


def chosen_copies(mix):
    """Copies of every example by mix and source."""
    out: dict = {}
    for r in mix.select().collect():
        out.setdefault((r["mix_id"], r["source_key"]), {})[r["example_id"]] = r["copies"]
    return out


def test_capped_source_takes_all_that_reaches_it(spark):
    items = [(f"a{i}", "s", "") for i in range(150)] + [(f"b{i}", x, "") for i in range(80) for x in "st"]
    sources = [("s", None, "train", 100), ("t", None, "train", None), ("u", None, "train", None)]
    mix = mixture(spark, items + [(f"u{i}", "u", "") for i in range(150)], sources, [(1, "s", 1.0, 3), (1, "u", 0.0001, 1)])
    reached = {r["source_key"]: r["reached"] for r in mix.shares.collect()}
    got = chosen_copies(mix)[1, "s"]
    assert sum(got.values()) == round(reached["s"]) == 250  # 250 minus 0.025 is asked for
    assert len(got) == 100 and max(got.values()) <= 3 and {e[0] for e in got} == {"a", "b"}


@pytest.mark.parametrize("seed", range(2))
def test_selected_copies_are_what_is_reached(spark, seed):
    rng = random.Random(seed)
    names = "abcd"
    items = [(f"e{i}", s, "") for i in range(120) for s in rng.sample(names, rng.randrange(1, 4))]
    sources = [(s, None, "train", rng.choice([7, 20, 33])) for s in names]
    targets = [(m, s, rng.choice([0.2, 1.0, 3.0]), rng.choice([1, 2, 3, 5])) for m in range(4) for s in names]
    mix = mixture(spark, items, sources, targets)
    got = chosen_copies(mix)
    for r in mix.shares.collect():
        own = got.get((r["mix_id"], r["source_key"]), {})
        assert abs(sum(own.values()) - r["reached"]) <= 0.5 + 1e-6
        assert len(own) <= r["size"] and max(own.values(), default=0) <= r["max_repeats"]


def test_allot_keeps_the_cap():
    patterns = {("a",): 2, ("a", "b"): 2, ("a", "c"): 2}
    got = allot(dict.fromkeys(patterns, 2.0), patterns, 3, 2)
    assert sum(c for c, _ in got.values()) == 6 and sum(d for _, d in got.values()) == 2 and all(c <= 3 * d and d <= 2 for c, d in got.values())
    rng = random.Random(3)
    for _ in range(300):
        repeats = rng.randrange(1, 5)
        patterns = {("s", str(k)): rng.randrange(1, 9) for k in range(5)}
        size = rng.randrange(1, sum(patterns.values()) + 1)
        flows, left = {}, float(repeats * size)
        for p, n in patterns.items():
            flows[p] = min(left, rng.random() * repeats * n)
            left -= flows[p]
        got = allot(flows, patterns, repeats, size)
        assert abs(sum(c for c, _ in got.values()) - sum(flows.values())) <= 0.5 + 1e-6
        assert sum(d for _, d in got.values()) <= size and all(d <= patterns[p] and d <= c <= repeats * d for p, (c, d) in got.items())


def test_mixes_are_solved_apart_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr("siftara.llm.mixing.MAX_CELLS", 5)
    names = "abc"
    registry = [(s, None, "train", None) for s in names]
    mix = mixture(spark, [("e", "a", "")], registry, [(m, s, 1.0, 1) for m in range(20) for s in names])
    assert {(r["mix_id"], r["source_key"]) for r in mix.shares.collect()} == {(m, s) for m in range(20) for s in names}
    with pytest.raises(Exception, match="sources of mixes"):
        mixture(spark, [(f"e{s}{t}", x, "") for s in names for t in names for x in (s, t)], registry, [(1, s, 1.0, 1) for s in names])
