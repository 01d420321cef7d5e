"""Splits that keep related records together.

Records with the same group or the same stem belong together, and such links chain. Groups and stems are the nodes of a
graph, held as hash-partitioned adjacency rows. In each round many seeds grow breadth first at once; where two labels
meet, the edge between them goes to the graph of labels, which is far smaller and is the graph of the next round. What
fits one task is finished there by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftara.operators.ranks import DIGITS
from siftara.skew import heavy_keys, split_join
from siftara.storage import materialize

#: One node in SEED_RATE is a seed; fronts grow for STEPS steps a round.
SEED_RATE, STEPS = 4, 2
#: Edges between labels that one task can finish.
SMALL_EDGES = 300_000
PROPORTIONS = {"train": 0.9, "val": 0.05, "test": 0.05}
#: Components above this share of all records are placed first, at most 1 / GIANT_SHARE of them.
GIANT_SHARE = 0.002


def plain_stem(stem: Column) -> Column:
    """Stem without outer blanks, letter case, folders, a leading test_ and a final .py; null where nothing is left."""
    name = F.regexp_replace(F.lower(F.trim(stem)), r"^.*[/\\]", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(name), r"\.py$", ""), "^test_", ""), F.lit(""))


def _node(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.unhex(F.md5(F.concat(F.lit(kind), value))))


def _union_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            a, b = find(bytes(a)), find(bytes(b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "label": [find(x) for x in nodes]})


def _renamed(named: DataFrame, labels: DataFrame) -> DataFrame:
    """``named`` with its labels replaced by the labels that those got as nodes; a label that very many nodes have is joined by broadcast."""
    held = named.withColumnRenamed("label", "old")
    often = heavy_keys(held.groupBy("old").agg(F.count("*").alias("n")), ["old"], "n")
    new = labels.select(F.col("node").alias("old"), F.col("label").alias("new"))
    return split_join(held, new, often, ["old"], "left").select("node", F.coalesce("new", "old").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """node and label for each node of the edges (a, b); nodes have one label exactly when a path joins them. Nulls and loops link nothing."""
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    named: DataFrame | None = None  # original node -> its label so far
    level = 0
    while True:
        # a round of fronts over the adjacency rows, hash-partitioned by their first node
        both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "adjacency")
        degree = both.groupBy("a").agg(F.count("*").alias("n"))
        heavy = materialize(heavy_keys(degree, ["a"], "n"), "heavy-nodes")
        turn = F.pmod(F.xxhash64("a", F.lit(level)), F.lit(SEED_RATE))
        reached = front = materialize(degree.where(turn == 0).select(F.col("a").alias("node"), F.col("a").alias("label")), "front")
        for _ in range(STEPS):
            met = split_join(both, front.withColumnRenamed("node", "a"), heavy, ["a"]).groupBy("b").agg(F.min("label").alias("label")).withColumnRenamed("b", "node")
            front = materialize(met.join(reached, "node", "left_anti"), "front")
            reached = reached.unionByName(front)
        rest = degree.select(F.col("a").alias("node")).join(reached, "node", "left_anti").select("node", F.col("node").alias("label"))
        labels = materialize(reached.unionByName(rest), "labels")
        named = labels if named is None else materialize(_renamed(named, labels), "named")
        # colliding labels are the edges of the label graph
        left = split_join(edges, labels.withColumnRenamed("node", "a"), heavy, ["a"]).select("b", F.col("label").alias("la"))
        crossing = split_join(left, labels.withColumnRenamed("node", "b"), heavy.withColumnRenamed("a", "b"), ["b"]).where("la <> label")
        edges = materialize(crossing.select(F.least("la", "label").alias("a"), F.greatest("la", "label").alias("b")).distinct(), "label-edges")
        level += 1
        n = edges.count()
        if n <= SMALL_EDGES:
            break
    if n == 0:
        return named
    last = materialize(edges.repartition(1).mapInPandas(_union_small, "node binary, label binary"), "last-labels")
    return materialize(_renamed(named, last), "components")


class GroupedSplits:
    """Records by component. ``records`` needs the key, the group and the stem column; others are not read. Null keys are records too."""

    def __init__(self, records: DataFrame, key: str = "case_id", group: str = "case_group", stem: str = "stem"):
        self.key = key
        own, name = F.col(f"`{group}`"), plain_stem(F.col(f"`{stem}`"))
        rows = records.select(F.col(f"`{key}`").alias("key"), own.alias("own"), _node("group ", own).alias("g"), _node("stem ", name).alias("s"))
        pairs = materialize(rows.groupBy("own", "g", "s").agg(F.count("*").alias("n")), "group-stem")
        labels = components(pairs.select(F.col("g").alias("a"), F.col("s").alias("b")))
        # a node without any edge is a component of its own
        node = F.coalesce("g", "s")
        nodes = pairs.where("g is not null or s is not null").groupBy(node.alias("node")).agg(F.min("own").alias("own"), F.sum("n").alias("n"))
        joined = nodes.join(labels, "node", "left").select("node", "own", "n", F.coalesce("label", "node").alias("label"))
        self.nodes = materialize(joined, "nodes")
        roots = self.nodes.groupBy("label").agg(F.min("own").alias("root_group"), F.sum("n").alias("records"))
        self.roots = materialize(roots, "roots")
        self.giants = heavy_keys(self.nodes.groupBy("label").agg(F.count("*").alias("n")), ["label"], "n")
        self.heavy = heavy_keys(self.nodes, ["node"], "n")
        self.rows = rows.select("key", "own", node.alias("node"))

    def rooted(self) -> DataFrame:
        """key, own group, root_group and label of every record that has a group or a stem."""
        by_node = split_join(self.nodes.select("node", "label"), self.roots.select("label", "root_group"), self.giants, ["label"])
        return split_join(self.rows.where("node is not null"), by_node, self.heavy, ["node"]).select("key", "own", "root_group", "label")

    def moved(self) -> DataFrame:
        """Records whose own group is null or not the root group of their component: the key and root_group."""
        return self.rooted().where("root_group is not null and (own is null or own <> root_group)").select(F.col("key").alias(self.key), "root_group")

    def assign(self, proportions: dict[str, float] = PROPORTIONS, seed: str = "split") -> DataFrame:
        """The key, root_group and split of every record. Components go to the splits in the order of their seeded hash.

        Components of over GIANT_SHARE of all records, at most 1 / GIANT_SHARE, go first, each to the split that lacks
        most; then the others fill what is left of each split in hash order. A record with neither group nor stem is a
        component of its own, placed by the hash of its key.
        """
        alone = self.rows.where("node is null").select(F.md5(F.concat_ws(":", F.lit(seed), F.col("key").cast("string"))).alias("turn"), F.lit(1).cast("long").alias("records"))
        turns = self.roots.select("label", F.md5(F.concat_ws(":", F.lit(seed), F.hex("label"))).alias("turn"), "records")
        ranges = turns.select("turn", "records").unionByName(alone).groupBy(F.substring("turn", 1, DIGITS).alias("cut")).agg(F.sum("records").alias("records"))
        total = ranges.agg(F.sum("records")).first()[0] or 0
        room = {s: p / sum(proportions.values()) * total for s, p in proportions.items()}
        giants = []
        for r in sorted(turns.where(F.col("records") > total * GIANT_SHARE).collect(), key=lambda r: (-r["records"], r["turn"])):
            split = max(room, key=lambda s: room[s])
            room[split] -= r["records"]
            giants.append((r["turn"], split))
        spark = self.rows.sparkSession
        placed = F.broadcast(spark.createDataFrame(giants, "turn string, split string"))
        small = turns.select("turn", "records").unionByName(alone).join(placed, "turn", "left_anti")
        # thresholds on the hash itself: the range where a split is full, then the place in that range
        left = {s: max(0.0, r) for s, r in room.items()}
        scale = (small.agg(F.sum("records")).first()[0] or 0) / (sum(left.values()) or 1.0)
        cuts, at = [], 0.0
        for s in list(left)[:-1]:
            at += left[s] * scale
            cuts.append(at)
        sums = {r["cut"]: r["records"] for r in small.groupBy(F.substring("turn", 1, DIGITS).alias("cut")).agg(F.sum("records").alias("records")).collect()}
        bounds, seen = [], 0
        order = sorted(sums)
        for cut in cuts:
            while order and seen + sums[order[0]] <= cut:
                seen += sums[order.pop(0)]
            if not order:
                bounds.append("g")
                continue
            # share of the range that fits, as a hash: records are many and small, so the hash splits them evenly
            share = min(1.0, max(0.0, (cut - seen) / sums[order[0]]))
            bounds.append(order[0] + format(int(share * 0xFFFFFFFF), "08x"))
        choice = F.lit(list(left)[-1])
        for s, bound in reversed(list(zip(list(left)[:-1], bounds))):
            choice = F.when(F.col("turn") < bound, s).otherwise(choice)
        by_label = turns.join(placed, "turn", "left").select("label", F.coalesce("split", choice).alias("split"))
        grouped = split_join(self.nodes.select("node", "label"), self.roots.select("label", "root_group").join(by_label, "label"), self.giants, ["label"])
        linked = split_join(self.rows.where("node is not null"), grouped, self.heavy, ["node"]).select("key", "root_group", "split")
        single = self.rows.where("node is null").select("key", F.lit(None).cast("string").alias("root_group"), F.md5(F.concat_ws(":", F.lit(seed), F.col("key").cast("string"))).alias("turn")).select("key", "root_group", choice.alias("split"))
        return linked.unionByName(single).withColumnRenamed("key", self.key)
