"""Connected components: union-find within a task, then alternating large and small stars as joins over written
tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.runtime import Scratch


class UnionFind:
    """Disjoint sets of whole numbers, each named by its least member."""

    def __init__(self, members: Iterable[int] = ()):
        self.parent = {int(x): int(x) for x in members}

    def find(self, x: int) -> int:
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            parent[root] = parent[parent[root]]
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart; they are together now."""
        a, b = self.find(int(a)), self.find(int(b))
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


#: Nodes that one task joins before it lets go of them, and edges of a forest that one task takes in all.
HELD, FEW = 500_000, 200_000


def forest(edges: DataFrame, every: bool = False) -> DataFrame:
    """u, v: fewer edges (a, b) of the same components, each node's to the least that the edges of its task lead to (of HELD
    nodes at a time). With `every`, a least node's to itself as well."""

    def rows(groups: UnionFind) -> pa.RecordBatch:
        u = np.array(list(groups.parent), np.int64)
        v = np.array([groups.find(x) for x in u.tolist()], np.int64)
        own = u != v if not every else np.ones(len(u), bool)
        return pa.RecordBatch.from_arrays([pa.array(u[own]), pa.array(v[own])], ["u", "v"])

    def run(batches):
        groups = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                groups.join(a, b)
            if len(groups.parent) > HELD and not every:
                yield rows(groups)
                groups = UnionFind()
        yield rows(groups)

    return edges.select("a", "b").mapInArrow(run, "u long, v long")


def connected(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """node, comp for every node of `edges` (a, b: longs, a != b): comp is the least node reachable.

    Union-find reduces the edges of each task to a forest. A forest of FEW edges at most goes through one task. Of a larger
    one, each round points every node's greater neighbours, and its lesser ones, to its least neighbour, until nothing
    moves: a number of rounds logarithmic in the nodes. Neighbours are never gathered; a hub's are joined to its least,
    and a skewed join splits them.
    """
    now = scratch.save(forest(edges), "edges")
    if now.count() <= FEW:
        ends = now.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1)
        return scratch.save(forest(ends, every=True), "few").select(F.col("u").alias("node"), F.col("v").alias("comp"))
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        joined = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = scratch.save(joined.where("u != v").distinct(), "stars")
        at = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if at == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = at
    raise RuntimeError(f"components did not settle in {rounds} rounds")
