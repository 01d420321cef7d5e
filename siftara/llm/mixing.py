"""Mixing sources to target weights by min-cost flow.

Examples are put together by membership pattern, the set of sources that hold them, so that the flow network has a node
for each pattern and not for each example. Pattern capacity flows to the quotas of the sources; the k-th use of the same
example costs k - 1, so examples are repeated only when nothing fresh is left. The flow then says how many examples of
each pattern a source takes, and a seeded order says which.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftara.llm.names import plain_name, registry_names
from siftara.operators.ranks import running_sum
from siftara.skew import broadcast_checked
from siftara.storage import materialize

#: Bound on what the flow of one mix is solved over in a task: its patterns times its sources. Patterns are at most as many as sets of sources that occur together; more are an error.
MAX_CELLS = 1_000_000
EPS = 1e-9


class Network:
    """Min-cost flow by the primal-dual method: one maximum flow over the cheapest arcs for each path cost."""

    def __init__(self) -> None:
        self.head: list[int] = []
        self.room: list[float] = []
        self.cost: list[int] = []
        self.out: defaultdict[object, list[int]] = defaultdict(list)
        self.ends: list[tuple[object, object]] = []

    def arc(self, a: object, b: object, room: float, cost: int = 0) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out[u].append(len(self.ends))
            self.ends.append((u, v))
            self.room.append(r)
            self.cost.append(c)
        return len(self.ends) - 2

    def flow(self, arc: int) -> float:
        return self.room[arc + 1]

    def _distances(self, source: object) -> dict[object, int]:
        dist, queue, queued = {source: 0}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in self.out[u]:
                v = self.ends[e][1]
                if self.room[e] > EPS and dist[u] + self.cost[e] < dist.get(v, 1 << 60):
                    dist[v] = dist[u] + self.cost[e]
                    if v not in queued:
                        queued.add(v)
                        queue.append(v)
        return dist

    def solve(self, source: object, sink: object) -> None:
        while True:
            dist = self._distances(source)
            if sink not in dist:
                return
            tight = lambda e: self.room[e] > EPS and dist.get(self.ends[e][0], 1 << 60) + self.cost[e] == dist.get(self.ends[e][1], -1)
            while True:  # blocking flows over the tight arcs
                level, queue = {source: 0}, deque([source])
                while queue:
                    u = queue.popleft()
                    for e in self.out[u]:
                        v = self.ends[e][1]
                        if v not in level and tight(e):
                            level[v] = level[u] + 1
                            queue.append(v)
                if sink not in level:
                    break
                at: defaultdict[object, int] = defaultdict(int)
                path: list[int] = []
                u = source
                while True:
                    if u == sink:
                        pushed = min(self.room[e] for e in path)
                        for e in path:
                            self.room[e] -= pushed
                            self.room[e ^ 1] += pushed
                        k = next(i for i, e in enumerate(path) if self.room[e] <= EPS)
                        u = self.ends[path[k]][0]
                        del path[k:]
                        continue
                    arcs = self.out[u]
                    while at[u] < len(arcs) and not (level.get(self.ends[arcs[at[u]]][1]) == level[u] + 1 and tight(arcs[at[u]])):
                        at[u] += 1
                    if at[u] < len(arcs):
                        path.append(arcs[at[u]])
                        u = self.ends[arcs[at[u]]][1]
                    elif path:
                        u = self.ends[path.pop()][0]
                        at[u] += 1
                    else:
                        break


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, float], repeats: dict[str, int], caps: dict[str, float]) -> tuple[dict[str, float], dict[tuple[tuple[str, ...], str, int], float]]:
    """What reaches each source, and how many examples of a pattern a source uses for the r-th time (r from 1)."""
    net = Network()
    quota = {s: net.arc(("source", s), "sink", t) for s, t in targets.items()}
    for s in targets:
        for r in range(1, repeats[s] + 1):
            net.arc(("use", s, r), ("source", s), caps[s])
    uses = {}
    for p, n in patterns.items():
        inside = [s for s in p if s in targets]
        for k in range(sum(repeats[s] for s in inside)):  # the (k + 1)-th use of the same example
            net.arc("start", ("pattern", p), n, k)
        for s in inside:
            for r in range(1, repeats[s] + 1):
                uses[p, s, r] = net.arc(("pattern", p), ("use", s, r), n, r - 1)
    net.solve("start", "sink")
    return {s: net.flow(a) for s, a in quota.items()}, {k: f for k, a in uses.items() if (f := net.flow(a)) > EPS}


def allot(flows: dict[tuple[str, ...], float], patterns: dict[tuple[str, ...], int], repeats: int, size: int) -> dict[tuple[str, ...], tuple[int, int]]:
    """Whole copies and different examples that one source takes of each pattern, from its flows over all uses.

    The copies add up to the rounded flow of the source, the different examples to at most ``size``, and no example is
    used more than ``repeats`` times. The levels of the flow are not taken as they are: the cap binds each level of the
    source as a whole, so a pattern can have its flow at the later levels only.
    """
    copies = {p: int(f + 1e-6) for p, f in flows.items()}
    fraction = sorted(flows, key=lambda p: copies[p] - flows[p])
    for p in fraction[: max(0, round(sum(flows.values())) - sum(copies.values()))]:
        copies[p] += 1
    over = {p: copies[p] % repeats for p in copies if copies[p] % repeats}
    room = size - sum(c // repeats for c in copies.values())
    if len(over) > room:  # examples that are not used up share the places that are left
        spare = sum(over.values())
        for k, p in enumerate(sorted(over, key=lambda p: -over[p])):
            kept = min(repeats, spare) if k < room else 0
            copies[p] += kept - over[p]
            spare -= kept
    copies = {p: c for p, c in copies.items() if c}
    most = lambda level: {p: min(patterns[p], -(-c // level)) for p, c in copies.items()}
    level = next(k for k in range(1, repeats + 1) if k == repeats or sum(most(k).values()) <= size)
    different, finer = most(level), most(max(1, level - 1))
    left = size - sum(different.values())
    for p in different:
        more = min(left, finer[p] - different[p])
        different[p] += more
        left -= more
    return {p: (c, different[p]) for p, c in copies.items()}


def solve_mix(key: tuple, wanted: pd.DataFrame, held: pd.DataFrame, most: int) -> pd.DataFrame:
    """The shares of one mix and the blocks of examples that its sources take, as rows of one table; ``held`` has the patterns of its sources, ``wanted`` its sources.

    Rows come in any order and are sorted, so that the flow takes the same one of several equal ways.
    """
    mix, out = key[0], []
    rows = sorted(wanted.itertuples(index=False), key=lambda r: r.source_key)
    if not rows:
        return pd.DataFrame(columns=SOLVED)
    patterns = dict(sorted((tuple(p), int(n)) for p, n in zip(held["pattern"], held["n"])))
    if len(patterns) * len(rows) > most:
        raise ValueError(f"mix {mix}: over {most} cells of patterns and sources of mixes")
    size = {r.source_key: float(r.size) for r in rows}
    total, weight = sum(size.values()), sum(r.weight for r in rows)
    goal = {r.source_key: r.weight / weight * total for r in rows}
    repeats = {r.source_key: int(r.max_repeats) for r in rows}
    got, uses = route(patterns, goal, repeats, size)
    reached = sum(got.values())
    for r in rows:
        s = r.source_key
        out.append((mix, s, r.weight / weight, goal[s], got[s], got[s] / reached if reached else 0.0, size[s], repeats[s], got[s] < goal[s] - EPS * max(1.0, goal[s]), None, None, None, None))
    flows: defaultdict[str, defaultdict[tuple[str, ...], float]] = defaultdict(lambda: defaultdict(float))
    for (p, s, _), f in sorted(uses.items()):
        flows[s][p] += f
    at: defaultdict[tuple[str, ...], int] = defaultdict(int)
    for s in sorted(flows):
        for p, (copies, different) in allot(flows[s], patterns, repeats[s], int(size[s])).items():
            # levels of one source start at the same place, so the examples used twice are among those used once
            for done in range(0, copies, different):
                out.append((mix, s, *[None] * 7, list(p), patterns[p], at[p] % patterns[p], min(different, copies - done)))
            at[p] += different
    frame = pd.DataFrame(out, columns=SOLVED)
    return frame.astype({"max_repeats": "Int32", "n": "Int64", "first": "Int64", "take": "Int64", "short": "boolean"})


#: Columns of the shares of a mix, then those of its blocks.
SHARES, BLOCKS = ["target_share", "target", "reached", "reached_share", "size", "max_repeats", "short"], ["pattern", "n", "first", "take"]
SOLVED = ["mix_id", "source_key", *SHARES, *BLOCKS]


class Mixture:
    """The mixtures of ``targets`` over ``items``.

    In a mix only rows with a weight above 0 and a source of role 'train' take part. An item belongs to a source when it
    names its key or its hf_id, spelling aside; items of no source or without example_id are in no mix. The size of a source is its number of
    different examples, at most its cap (null: none). Sizes are counted in examples. A null max_repeats means 1.

    Mixes are independent: each is solved in a task of its own, from the counts of its patterns.
    """

    def __init__(self, items: DataFrame, sources: DataFrame, targets: DataFrame, *, seed: str = "mix"):
        self.seed = seed
        names = broadcast_checked(registry_names(sources))
        members = items.where("example_id is not null").select("example_id", plain_name(F.col("source")).alias("plain")).distinct().join(names, "plain")
        held = members.groupBy("example_id").agg(F.array_sort(F.collect_set("source_key")).alias("pattern"))
        self.members = materialize(held, "mix-members")
        patterns = materialize(self.members.groupBy("pattern").agg(F.count("*").alias("n")), "mix-patterns")
        spread = patterns.select("pattern", "n", F.explode("pattern").alias("source_key"))
        asked = targets.join(sources.where("role = 'train' and source_key is not null").groupBy("source_key").agg(F.max("cap").alias("cap")), "source_key").where("weight > 0 and not isnan(weight)")
        wanted = asked.groupBy("mix_id", "source_key").agg(F.sum("weight").alias("weight"), F.greatest(F.lit(1), F.coalesce(F.max("max_repeats"), F.lit(1))).alias("max_repeats"), F.max("cap").alias("cap"))
        sizes = spread.groupBy("source_key").agg(F.sum("n").alias("held"))
        size = F.least(F.coalesce("held", F.lit(0)), F.coalesce("cap", F.coalesce("held", F.lit(0))))
        wanted = materialize(wanted.join(sizes, "source_key", "left").select("mix_id", "source_key", "weight", "max_repeats", size.alias("size")), "mix-wanted")
        of_mix = spread.join(wanted.select(F.col("mix_id").alias("mix"), "source_key"), "source_key").select("mix", "pattern", "n").distinct()
        kind = dict(targets.dtypes)["mix_id"]
        schema = f"mix_id {kind}, source_key string, target_share double, target double, reached double, reached_share double, size double, max_repeats int, short boolean, pattern array<string>, n long, first long, take long"
        most = MAX_CELLS
        solved = materialize(wanted.groupBy("mix_id").cogroup(of_mix.groupBy("mix")).applyInPandas(lambda key, own, held: solve_mix(key, own, held, most), schema), "mix-solved")
        self.shares = solved.where("pattern is null").select("mix_id", "source_key", *SHARES)
        self.blocks = solved.where("pattern is not null").select("mix_id", "source_key", *BLOCKS)

    def short_sources(self) -> DataFrame:
        """mix_id and source_key of the sources whose quota the flow could not fill."""
        return self.shares.where("short").select("mix_id", "source_key")

    def select(self) -> DataFrame:
        """mix_id, source_key, example_id, copies: the chosen examples, by a seeded order within their pattern."""
        turn = F.md5(F.concat_ws("\n", F.lit(self.seed), "example_id"))
        placed = running_sum(self.members.select("example_id", "pattern", turn.alias("turn"), F.lit(1).alias("one")), ["pattern"], "turn", "one", "place")
        inside = F.pmod(F.col("place") - F.col("first"), F.col("n")) < F.col("take")
        chosen = placed.join(broadcast_checked(self.blocks, MAX_CELLS, held=True), "pattern").where(inside)
        return chosen.groupBy("mix_id", "source_key", "example_id").agg(F.count("*").cast("int").alias("copies"))
