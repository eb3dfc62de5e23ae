"""Graph construction as DataFrame operators: layers, candidates, diverse links, back-links, statistics, walks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.distance import euclidean
from lodestone.functions.sizing import layer, max_neighbors, uniform
from lodestone.operators.knn import batch_pairs
from lodestone.plans.runtime import Scratch
from lodestone.schema import CANDIDATES, candidate_limit


def assign_layers(vectors: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """id, layer: the top layer of each node, from its id."""
    return vectors.select("id", layer(uniform(F.col("id"), seed), m).alias("layer"))


def entry_point(layers: DataFrame) -> DataFrame:
    """id, layer of the node that search starts at: the first of the highest."""
    return layers.orderBy(F.desc("layer"), "id").limit(1)


def candidates(vectors: DataFrame, layers: DataFrame, at: int, limit: int = CANDIDATES) -> DataFrame:
    """src, dst, d: the nearest members of layer `at` with a smaller id, `limit` of them at most."""
    members = vectors.join(layers.where(F.col("layer") >= at).select("id"), "id", "left_semi") if at else vectors
    found = batch_pairs(members.select(F.col("id").alias("query_id"), "embedding"), members, limit, before=True)
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, limit).alias("c"))  # limit per block
    return best.select(F.col("query_id").alias("src"), F.explode("c").alias("c")).select("src", F.col("c.id").alias("dst"), F.col("c.d").alias("d"))


def diverse(base_d: np.ndarray, vectors: np.ndarray, max_count: int, limit: int | None = None, priority: int | None = None) -> list[int]:
    """Which candidates to link: positions, in order of selection.

    `base_d` are the candidates' distances to the base, in input order. Up to max_count candidates are all
    taken as they come. Otherwise the nearest `limit` are walked; one is passed over if some selected one is
    strictly nearer to it than the base is. If fewer than half of max_count remain, the nearest passed over
    fill up to max_count. A `priority` candidate among the nearest max_count takes the last place if left out.
    """
    n = len(base_d)
    if n <= max_count:
        return list(range(n))
    first = np.arange(min(n, limit or candidate_limit(max_count)))
    key = np.where(np.isnan(base_d[first]), np.inf, base_d[first])
    order = first[np.argsort(key, kind="stable")].tolist()
    x = vectors[order].astype(np.float64)
    gaps = x[:, None] - x[None, :]
    apart = np.sqrt(np.einsum("ijk,ijk->ij", gaps, gaps)).tolist()  # a bounded number of candidates
    near, places = base_d[order].tolist(), []
    for c in range(len(order)):
        if len(places) == max_count:
            break
        row, own = apart[c], near[c]
        if not any(row[t] < own for t in places):
            places.append(c)
    taken = [order[c] for c in places]
    if len(taken) < max_count / 2:
        taken += [c for c in order if c not in taken][: max_count - len(taken)]
    if priority is not None and priority not in taken and priority in order[:max_count]:
        if len(taken) >= max_count:
            taken.pop()
        taken.append(priority)
    return taken


def _select(lists: DataFrame, max_count: int) -> DataFrame:
    """src, slot, dst, d from src and c: an array of (d, id, embedding), a bounded number per node."""

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, int, float]] = []
            for src, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = np.array([x["d"] for x in c])
                keep = diverse(d, np.array([x["embedding"] for x in c]), max_count)
                out += [(src, slot, c[i]["id"], d[i]) for slot, i in enumerate(keep)]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], ["src", "slot", "dst", "d"])

    return lists.select("src", "c").mapInArrow(run, "src long, slot int, dst long, d double")


def _listed(pairs: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """src and its `limit` nearest pairs as an array of (d, id, embedding), ascending."""
    near = pairs.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("dst").alias("id")))), 1, limit).alias("c"))
    flat = near.select("src", F.explode("c").alias("c")).select("src", "c.d", "c.id").join(vectors, "id")
    return flat.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("d", "id", "embedding"))).alias("c"))


def forward_links(vectors: DataFrame, layers: DataFrame, at: int, m: int) -> DataFrame:
    """src, slot, dst, d: the links that each node of a layer makes to nodes before it."""
    cap = max_neighbors(at, m)
    limit = candidate_limit(cap)
    return _select(_listed(candidates(vectors, layers, at, limit), vectors, limit), cap)


def back_links(forward: DataFrame) -> DataFrame:
    """src, dst, d: links and their reverses, each once."""
    return forward.select("src", "dst", "d").union(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d")).dropDuplicates(["src", "dst"])


def pruned(both: DataFrame, vectors: DataFrame, at: int, m: int) -> DataFrame:
    """src, slot, dst, d with at most the layer's cap of links a node. A hub's links are cut to the nearest
    candidates by a bounded aggregate before vectors are joined."""
    cap = max_neighbors(at, m)
    limit = candidate_limit(cap)
    salted = both.withColumn("s", F.pmod(F.xxhash64("dst"), F.lit(64)))
    near = salted.groupBy("src", "s").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "dst"))), 1, limit).alias("c"))
    cut = near.select("src", F.explode("c").alias("c")).select("src", "c.dst", "c.d")
    return _select(_listed(cut, vectors, limit), cap)


def layer_graph(vectors: DataFrame, layers: DataFrame, at: int, m: int, scratch: Scratch) -> DataFrame:
    """src, slot, dst, d of one whole layer: forward links, back-links, pruning."""
    forward = scratch.save(forward_links(vectors, layers, at, m), f"forward-{at}")
    return pruned(back_links(forward), vectors, at, m)


def link_filter(links: DataFrame, node_count: int) -> DataFrame:
    """Links that may be written: not to oneself, to an unused slot (null or negative) or to a node not yet there."""
    return links.where(F.col("dst").isNotNull() & (F.col("dst") >= 0) & (F.col("dst") != F.col("src")) & (F.col("dst") < node_count))


def graph_violations(graph: DataFrame, node_count: int, m: int, max_layers: int) -> DataFrame:
    """id, layer, fault of the rows (id, layer, neighbors) that the layout does not allow: a node or layer that cannot
    be, more links than the layer's cap, a link to a node that is not there, to itself, or twice to one."""
    cap = F.when(F.col("layer") == 0, max_neighbors(0, m)).otherwise(max_neighbors(1, m))
    faults = [
        (F.col("id").isNull() | (F.col("id") < 0) | (F.col("id") >= node_count), "no such node"),
        (F.col("layer").isNull() | (F.col("layer") < 0) | (F.col("layer") >= max_layers), "no such layer"),
        (F.col("neighbors").isNull() | (F.size("neighbors") > cap), "too many links, or none at all"),
        (F.exists("neighbors", lambda x: x.isNull() | (x < 0) | (x >= node_count)), "a link to a node that is not there"),
        (F.array_contains("neighbors", F.col("id")), "a link to itself"),
        (F.size(F.array_distinct("neighbors")) < F.size("neighbors"), "a link twice"),
    ]
    fault = F.coalesce(*[F.when(wrong, F.lit(name)) for wrong, name in faults])
    return graph.select("id", "layer", fault.alias("fault")).where("fault is not null")


def edited(graph: DataFrame, edits: DataFrame, node_count: int, m: int) -> DataFrame:
    """`graph` (id, layer, neighbors) with the rows of `edits` in place of its own, or beside them: links that may not
    be written are left out, the first of each stays, and a row keeps as many as its layer's cap."""
    cap = F.when(F.col("layer") == 0, max_neighbors(0, m)).otherwise(max_neighbors(1, m))
    good = F.array_distinct(F.filter("neighbors", lambda x: x.isNotNull() & (x >= 0) & (x < node_count) & (x != F.col("id"))))
    new = edits.where((F.col("id") >= 0) & (F.col("id") < node_count)).select("id", "layer", F.slice(good, 1, cap).alias("neighbors"))
    return graph.select("id", "layer", "neighbors").join(new, ["id", "layer"], "left_anti").unionByName(new)


def degree_stats(graph: DataFrame) -> DataFrame:
    """layer, nodes, links, mean_degree, max_degree of a graph (layer, src, dst)."""
    per = graph.groupBy("layer", "src").agg(F.count("*").alias("degree"))
    return per.groupBy("layer").agg(F.count("*").alias("nodes"), F.sum("degree").alias("links"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))


def reachable(links: DataFrame, start: DataFrame, scratch: Scratch, rounds: int = 1000) -> DataFrame:
    """id, hops of every node that the links (src, dst) lead to from `start` (id), by widening frontiers."""
    seen = scratch.save(start.select("id", F.lit(0).alias("hops")), "frontier")
    frontier = seen
    for hop in range(1, rounds + 1):
        step = frontier.select(F.col("id").alias("src")).join(links, "src").select(F.col("dst").alias("id")).distinct()
        frontier = scratch.save(step.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hops")), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)  # tables as written, each hop's once
    raise RuntimeError(f"more than {rounds} hops")


def greedy_descent(queries: DataFrame, vectors: DataFrame, links: DataFrame, start: DataFrame, scratch: Scratch, rounds: int = 1000) -> DataFrame:
    """query_id, id, d: where each query (query_id, embedding) ends that moves from `start` to its nearest
    neighbour while that is strictly nearer."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    first = q.join(F.broadcast(start.select("id").limit(1))).join(vectors, "id")  # one row to each query
    at = scratch.save(first.select("query_id", "q", "id", euclidean(F.col("q"), F.col("embedding")).alias("d")), "walk")
    done = None
    for _ in range(rounds):
        next_ = at.join(links.select(F.col("src").alias("id"), "dst"), "id").join(vectors.select(F.col("id").alias("dst"), "embedding"), "dst")
        best = next_.groupBy("query_id").agg(F.min(F.struct(euclidean(F.col("q"), F.col("embedding")).alias("d"), F.col("dst").alias("id"))).alias("n"))
        moved = at.join(best, "query_id", "left").select("query_id", "q", F.when(F.col("n.d") < F.col("d"), F.col("n")).otherwise(F.struct("d", "id")).alias("n"), F.coalesce(F.col("n.d") < F.col("d"), F.lit(False)).alias("go"))
        moved = scratch.save(moved.select("query_id", "q", "n.id", "n.d", "go"), "walk")
        still = moved.where("not go").select("query_id", "id", "d")
        done = still if done is None else done.union(still)
        at = moved.where("go").drop("go")
        if at.isEmpty():
            return done
    raise RuntimeError(f"more than {rounds} moves")
