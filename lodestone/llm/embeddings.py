"""Near-duplicate vectors through an inverted multi-index.

Each half of a vector has a codebook of its own, so k centroids a half make a grid of k * k cells. A vector's
multi-sequence order visits cells by the summed distances of its halves to the cell's centroids; how far to go is
read off sampled vectors whose links are known by brute force. Candidates are verified by cosine in double
precision, block against block, so links become counts and components without being listed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import column
from lodestone.llm.components import connected
from lodestone.plans.runtime import Scratch

#: Vectors that codebooks are fitted on, and vectors whose links are found by brute force, at most about.
TRAIN, PROBE = 20_000, 300
#: Vectors a cell holds on average, and the bounds of centroids a half.
PER_CELL, FEWEST, MOST = 200, 2, 1024
#: Share of links that the visited cells must hold: of the probed vectors' own, each probe weighing alike, and of
#: made-up ones at the threshold itself, the farthest there are.
TARGET = 0.998
#: Made-up links, at least, and numbers that the ranking of cells holds at once.
FAR, AT_ONCE = 3000, 1 << 22
#: Indexed vectors and queries of a block, about; a cell with more is dealt over several blocks. Queries stream past
#: the indexed ones, STEP at a time.
BLOCK, ASKING, STEP = 2048, 8192, 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = (c * c).sum(1) - 2 * (x @ c.T)
        at = near.argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    half: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to its centroids."""
        out = []
        for part, c in ((x[:, : self.half], self.first), (x[:, self.half :], self.second)):
            out.append((part * part).sum(1)[:, None] + (c * c).sum(1) - 2 * (part @ c.T))
        return out[0], out[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first n cells of each vector's multi-sequence. Those lie within the n-hyperbola of both sorted
        lists, rank by rank: only pairs with (i + 1) * (j + 1) <= n can be among them."""
        a, b = self.distances(x)
        ia, ib = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        i, j = (v.ravel() for v in np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij"))
        own = (i + 1) * (j + 1) <= n
        i, j = i[own], j[own]
        out = np.empty((len(x), min(n, len(i))), np.int32)
        step = max(1, AT_ONCE // len(i))
        for k in range(0, len(x), step):
            part = slice(k, k + step)
            total = np.take_along_axis(a[part], ia[part], 1)[:, i] + np.take_along_axis(b[part], ib[part], 1)[:, j]
            order = total.argsort(1, kind="stable")[:, :n]
            out[part] = np.take_along_axis(ia[part][:, i] * len(self.second) + ib[part][:, j], order, 1)
        return out

    def rank(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of a cell in each vector's multi-sequence, from 1."""
        a, b = self.distances(x)
        own = a[np.arange(len(x)), cells // len(self.second)] + b[np.arange(len(x)), cells % len(self.second)]
        out = np.empty(len(x), np.int64)
        step = max(1, AT_ONCE // (a.shape[1] * b.shape[1]))
        for k in range(0, len(x), step):
            part = slice(k, k + step)
            out[part] = 1 + (a[part, :, None] + b[part, None, :] < own[part, None, None]).sum((1, 2))
        return out

    def meeting(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many cells the vectors x[i] and y[j] must visit until one of each pair visits the other's cell."""
        n = len(self.first) * len(self.second)

        def ranks(of: np.ndarray, at: np.ndarray, cells: np.ndarray) -> np.ndarray:
            keys, back = np.unique(at * n + cells, return_inverse=True)
            return self.rank(of[keys // n], keys % n)[back]

        return np.minimum(ranks(x, i, self.cells(y)[j]), ranks(y, j, self.cells(x)[i]))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, dims)


def _sample(classes: DataFrame, total: int, most: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and vectors of about `most` classes by a hash of the vectors (all, if fewer; one at least)."""
    draw = F.pmod(F.xxhash64(F.lit(salt), "embedding"), F.lit(1_000_000))
    rows = classes.where(draw < int(1e6 * min(1.0, most / max(total, 1)) + 1)).select("node", "embedding").toArrow()
    if not rows.num_rows:
        rows = classes.orderBy(draw, "node").limit(1).select("node", "embedding").toArrow()
    rows = rows.sort_by("node")
    x = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("node").to_numpy(), x.reshape(rows.num_rows, -1)


def visits(classes: DataFrame, index: MultiIndex, nodes: np.ndarray, probes: np.ndarray, dims: int, threshold: float, target: float) -> int:
    """Cells to visit so that `target` of the probes' links to other vectors, found among all by brute force, are
    met, and as many made-up links at the threshold, in random directions: rare pairs at the threshold are hardly
    among the probes' own."""
    q = unit(probes)
    n = len(index.first) * len(index.second)

    def run(batches):
        for batch in batches:
            x = unit(_matrix(column(batch, "embedding"), dims))
            i, j = np.nonzero((q @ x.T >= threshold) & (nodes[:, None] != column(batch, "node").to_numpy()[None, :]))
            keys, count = np.unique(i * (n + 1) + index.meeting(q, x, i, j), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // (n + 1), pa.int64()), pa.array(keys % (n + 1), pa.int64()), pa.array(count, pa.int64())], ["probe", "place", "n"])

    found = classes.select("node", "embedding").mapInArrow(run, "probe long, place long, n long").groupBy("probe", "place").agg(F.sum("n").alias("n"))
    alike = found.select("place", (F.col("n") / F.sum("n").over(Window.partitionBy("probe")) * 1e9).cast("long").alias("n"))  # whole numbers, whose sum has no order
    own = np.zeros(n + 1)
    for r in alike.groupBy("place").agg(F.sum("n").alias("n")).collect():  # a row per cell at most
        own[r["place"]] = r["n"]
    far = np.zeros(n + 1)
    rng, every = np.random.default_rng(3), np.arange(len(q))
    for _ in range(-(-FAR // len(q))):
        side = rng.normal(size=q.shape)
        side = unit(side - (side * q).sum(1, keepdims=True) * q) if dims > 1 else np.zeros_like(q)
        x = unit(threshold * q + (1 - threshold**2) ** 0.5 * side)
        far += np.bincount(index.meeting(q, x, every, every), minlength=n + 1)
    return max(1, *(min(int(np.searchsorted(np.cumsum(links) / links.sum(), target)), n) for links in (own, far) if links.any()))


class _Indexed:
    """The indexed vectors of a block."""

    def __init__(self, table: pa.Table, dims: int):
        self.node, self.weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        self.x = unit(_matrix(table.column("embedding").combine_chunks(), dims))
        visited = np.array(table.column("visited").combine_chunks().flatten(), np.int64).reshape(len(self.node), -1)
        # (vector, cell) of all that they visit, as sorted numbers
        self.top = int(visited.max()) + 1
        self.visits = np.sort((np.arange(len(self.node))[:, None] * self.top + visited).ravel())

    def visit(self, at: np.ndarray, cells: np.ndarray) -> np.ndarray:
        key = at * self.top + cells
        return (cells < self.top) & (self.visits[np.minimum(np.searchsorted(self.visits, key), len(self.visits) - 1)] == key)

    def links(self, queries: pa.RecordBatch, dims: int, threshold: float) -> pa.RecordBatch:
        """Links of some queries: a, b, n; counts (a = b) and edges that join what the links join (n = 0)."""
        node, weight, cell = (column(queries, c).to_numpy() for c in ("node", "weight", "own"))
        near = unit(_matrix(column(queries, "embedding"), dims)) @ self.x.T >= threshold
        i, j = np.nonzero(near & (node[:, None] != self.node[None, :]))
        # the other direction counts here only where the other vector does not visit the query's cell
        blind = ~self.visit(j, cell[i].astype(np.int64))
        nodes = np.concatenate([node, self.node])
        j = j + len(node)
        count = np.zeros(len(nodes), np.int64)
        np.add.at(count, i, self.weight[j - len(node)])
        np.add.at(count, j[blind], weight[i[blind]])
        label = nodes.copy()
        while True:
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            if np.array_equal(before, label):
                break
        met, moved = np.flatnonzero(count), np.flatnonzero(label != nodes)
        out = [np.concatenate([nodes[met], nodes[moved]]), np.concatenate([nodes[met], label[moved]]), np.concatenate([count[met], np.zeros(len(moved), np.int64)])]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "n"])


def _blocks(batches, dims: int, threshold: float):
    """Links of blocks that come one after another, each block's indexed vectors before its queries."""
    current, held, index = None, [], None
    for batch in batches:
        keys = np.stack([column(batch, c).to_numpy() for c in ("cell", "j", "i")], 1)
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            key = tuple(keys[lo])
            if key != current:
                current, held, index = key, [], None
            part = batch.slice(lo, hi - lo)
            n = int((~column(part, "query").to_numpy(zero_copy_only=False)).sum())
            if n:
                held.append(part.slice(0, n))
            if n < hi - lo and held:
                index = index or _Indexed(pa.Table.from_batches(held), dims)
                for k in range(n, hi - lo, STEP):
                    yield index.links(part.slice(k, min(STEP, hi - lo - k)), dims, threshold)


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = 0.95, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding).

    Pairs link at cosine >= threshold; equal vectors are one class, so copies are counted, not compared. A
    vector that is null, empty or zero, or holds a null or non-finite component, links with nothing. Vectors of each
    length are compared among themselves, by an index of their own. n_links counts other rows; component_id is the
    smallest vec_id reachable (a null vec_id is never the smallest); kept says whether a row has it; rows that share a
    vec_id count each; other columns are ignored; an empty table gives no rows.
    """
    good = "embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v != 0)"
    rows = vectors.select("vec_id", "embedding", F.expr(f"if(coalesce({good}, false), size(embedding), 0)").alias("d"))
    lengths = sorted(r["d"] for r in rows.where("d > 0").select("d").distinct().collect())  # of vectors, not how many there are
    out = rows.where("d = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for dims in lengths:
        out = out.union(_linked(rows.where(F.col("d") == dims).select("vec_id", "embedding"), dims, scratch, threshold, target))
    return out.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(rows: DataFrame, dims: int, scratch: Scratch, threshold: float, target: float) -> DataFrame:
    """vec_id, n_links, component_id of vectors of one length."""
    classes = rows.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # unique as written
    total = classes.count()
    k = int(max(FEWEST, min(MOST, (total / PER_CELL) ** 0.5)))
    train, half = unit(_sample(classes, total, TRAIN, 1)[1]), max(1, dims // 2)
    index = MultiIndex(kmeans(train[:, :half], k, 1), kmeans(train[:, half:], k, 2) if dims > 1 else np.zeros((1, 0)), half)
    n_cells = visits(classes, index, *_sample(classes, total, PROBE, 2), dims, threshold, target)

    def place(batches):
        for batch in batches:
            x = unit(_matrix(column(batch, "embedding"), dims))
            near = index.nearest(x, n_cells)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([column(batch, "node"), column(batch, "weight"), column(batch, "embedding"), pa.array(index.cells(x), pa.int32()), lists], ["node", "weight", "embedding", "own", "visited"])

    kind = classes.schema["embedding"].dataType.simpleString()
    placed = scratch.save(classes.select("node", "weight", "embedding").mapInArrow(place, f"node long, weight long, embedding {kind}, own int, visited array<int>"), "placed")
    chunks = lambda c, of: F.ceil(F.col("n") / of).cast("int").alias(c)
    held = placed.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("n")).select("cell", chunks("js", BLOCK))  # a row per cell: at most MOST**2
    asking = placed.select(F.explode("visited").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).select("cell", chunks("is", ASKING))
    dealt = scratch.save(held.join(asking, "cell"), "cells")
    salt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = ["node", "weight", "embedding", "own"]
    indexed = placed.withColumn("cell", F.col("own")).join(dealt, "cell").select("cell", salt("js").alias("j"), every("is").alias("i"), F.lit(False).alias("query"), *base, "visited")
    queries = placed.withColumn("cell", F.explode("visited")).join(dealt, "cell").select("cell", every("js").alias("j"), salt("is").alias("i"), F.lit(True).alias("query"), *base, F.expr("cast(array() as array<int>)").alias("visited"))
    blocks = indexed.unionByName(queries).repartition("cell", "j", "i").sortWithinPartitions("cell", "j", "i", "query")
    met = scratch.save(blocks.mapInArrow(lambda batches: _blocks(batches, dims, threshold), "a long, b long, n long"), "links")
    counts = met.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("node"), "n")
    comps = connected(met.where("a != b").select("a", "b"), scratch)
    known = classes.join(counts, "node", "left").join(comps, "node", "left").select("embedding", "weight", "least_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("comp", "node").alias("comp"))
    ids = known.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    known = known.join(ids, "comp").select("embedding", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    return rows.join(known, "embedding").select("vec_id", "n_links", "component_id")
