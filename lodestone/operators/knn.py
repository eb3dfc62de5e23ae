"""Exact k nearest neighbours.

Batch search computes blocks of distances in numpy, with one of three plans by size: the base broadcast (every
query ends where it is read), the queries broadcast (each task keeps k per query, which are merged), or, where
neither fits its bound, both cut into blocks that meet in a grid. Many pairs of short vectors are not all compared: the base is cut
into boxes, and a query meets only those that can hold one of its k nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.distance import distance, nearest
from lodestone.operators.ids import dense_ids
from lodestone.plans.runtime import Scratch

#: Neighbours of one query that are ranked in one task at most; more are ranked as they are partitioned.
IN_ONE_TASK = 100_000
#: Bytes of vectors that may be broadcast, and vectors of one side of a block.
BROADCAST_BYTES = 64 << 20
BLOCK = 4096
#: Pairs from which Euclidean search goes by boxes, elements of a vector up to which boxes keep queries out, vectors that
#: a box is to hold, and those that a splitting value is taken from (a sample; every vector is in a box).
BOXED_PAIRS, BOXED_DIMS, BOX, SPLIT_SAMPLE = 1 << 30, 8, 8192, 100_000
_PAIR = "query_id long, id long, d double"


def single(base: DataFrame, query: list[float], k: int, metric: str = "euclidean") -> DataFrame:
    """rank, id, distance of the k nearest rows of `base` (id, embedding): a projection and a top-k."""
    if k <= 0:
        return base.select(F.lit(1).alias("rank"), "id", F.lit(0.0).cast("float").alias("distance")).limit(0)
    q = F.lit([float(x) for x in query]).cast("array<double>") if len(query) else F.array().cast("array<double>")
    every = base.select("id", distance(metric, F.col("embedding"), q).alias("d"))
    if k > IN_ONE_TASK:
        ranked = dense_ids(every.select(F.col("id").alias("vec"), "d"), 1, ["d", "vec"])
        return ranked.where(F.col("id") <= k).select(F.col("id").cast("int").alias("rank"), F.col("vec").alias("id"), F.col("d").cast("float").alias("distance"))
    top = every.orderBy("d", "id").limit(k)
    return top.select(F.row_number().over(Window.orderBy("d", "id")).alias("rank"), "id", F.col("d").cast("float").alias("distance"))  # k rows


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id")).alias("rank")
    return pairs.select("query_id", rank, "id", F.col("d").cast("float").alias("distance")).where(F.col("rank") <= k)


def _shape(df: DataFrame) -> tuple[int, int]:
    n, d = df.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return n, d or 0


def matrix(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, max(dims, 1))


def _local(df: DataFrame, name: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a frame whose size was checked."""
    t = df.select(name, "embedding").toArrow()
    return t.column(name).to_numpy(), matrix(t.column("embedding"), dims)


def _pairs(query_ids: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    rows, ids, d = found
    return pa.RecordBatch.from_arrays([pa.array(query_ids[rows], pa.int64()), pa.array(ids, pa.int64()), pa.array(d, pa.float64())], ["query_id", "id", "d"])


def _mask(query_ids: np.ndarray, ids: np.ndarray, before: bool) -> np.ndarray | None:
    return ids[None, :] < query_ids[:, None] if before else None


def batch(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", before: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of `base` (id, embedding) of each row of `queries`
    (query_id, embedding), by (distance, id), NaN last; all rows if there are fewer.

    With `before`, only rows with a smaller id than the query's count: what existed when it was added.
    Distances are double while ranking and float in the result.
    """
    pairs = batch_pairs(queries, base, k, metric, before, limit)
    return _ranked(pairs, k)


def _splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Element and value that each inner node of a binary tree splits at: the widest element's median."""
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    held = {0: sample}
    for node in range(len(axis)):
        x = held.pop(node)
        if len(x):
            axis[node] = np.ptp(x, axis=0).argmax()
            value[node] = np.median(x[:, axis[node]])
        right = x[:, axis[node]] > value[node]
        held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
    return axis, value


def _leaf(x: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(len(axis).bit_length()):
        node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > value[node])
    return (node - len(axis)).astype(np.int32)


def _gaps(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distance from each row of x to each box."""
    out = np.zeros((len(x), len(lo)))
    for j in range(x.shape[1]):
        out += np.maximum(np.maximum(lo[:, j] - x[:, j, None], x[:, j, None] - hi[:, j]), 0) ** 2
    return np.sqrt(out)


def _boxed(queries: DataFrame, base: DataFrame, k: int, n_base: int, dims: int, scratch: Scratch, box: int = BOX) -> DataFrame:
    """batch_pairs() by Euclidean distance over finite vectors, in two turns: the box nearest to a query gives a bound,
    and every other box that is not beyond the bound is asked as well. Boxes of far too many rows are dealt by hash."""
    spark = queries.sparkSession
    depth = max(0, (-(-n_base // box) - 1).bit_length())
    sample = base.select("embedding").sample(min(1.0, SPLIT_SAMPLE / n_base), 0).toArrow()
    axis, value = _splits(matrix(sample.column("embedding"), dims).astype(np.float64), depth)

    def placed(batches):
        for t in batches:
            leaf = _leaf(matrix(t.column(1), dims).astype(np.float64), axis, value)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), t.column(0), t.column(1)], ["box", "id", "embedding"])

    kind = base.schema["embedding"].dataType.simpleString()
    rows = base.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(placed, f"box int, id long, embedding {kind}")
    ends = [f(F.col("embedding")[j]).cast("double").alias(f"{n}{j}") for j in range(dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    boxes = rows.groupBy("box").agg(F.count("*").alias("n"), *ends).orderBy("box").toArrow()  # a row per box
    lo, hi = (np.stack([boxes.column(f"{n}{j}").to_numpy() for j in range(dims)], 1) for n in ("lo", "hi"))
    number = boxes.column("box").to_numpy()
    parts = F.broadcast(spark.createDataFrame([(int(b), max(1, -(-int(n) // (8 * box)))) for b, n in zip(number, boxes.column("n").to_numpy(), strict=True)], "box int, parts int"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    held = rows.join(parts, "box").select("box", part, F.lit(False).alias("query"), "id", "embedding")
    q_kind = queries.schema["embedding"].dataType.simpleString()

    def asked(nearest_box: bool):
        def run(batches):
            for t in batches:
                x = matrix(t.column(1), dims).astype(np.float64)
                for a in range(0, len(x), 256):
                    gap = _gaps(x[a : a + 256], lo, hi)
                    home = gap.argmin(1)
                    if nearest_box:
                        i, j = np.arange(len(home)), home
                    else:
                        gap[np.arange(len(home)), home] = np.inf
                        bound = t.column(2).to_numpy(zero_copy_only=False)[a : a + 256]
                        i, j = np.nonzero((gap <= bound[:, None] * (1 + 1e-9) + 1e-12) & (gap < np.inf))
                    own = pa.array(i + a)
                    yield pa.RecordBatch.from_arrays([pa.array(number[j].astype(np.int32)), t.column(0).take(own), t.column(1).take(own)], ["box", "id", "embedding"])

        return run

    def meet(t: pa.Table) -> pa.Table:
        asks = t.column("query").to_numpy()
        ids, x = t.column("id").to_numpy(), matrix(t.column("embedding"), dims)
        return pa.Table.from_batches([_pairs(ids[asks], nearest("euclidean", x[asks], x[~asks], ids[~asks], k))])

    def found(asking: DataFrame, first: bool) -> DataFrame:
        to = asking.mapInArrow(asked(first), f"box int, id long, embedding {q_kind}").join(parts, "box")
        to = to.select("box", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("query"), "id", F.col("embedding").cast(kind))
        return to.unionByName(held).groupBy("box", "part").applyInArrow(meet, _PAIR)

    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    at_home = scratch.save(found(q, True), "home")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    best = at_home.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    bound = F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf"))).alias("bound")
    return at_home.unionByName(found(q.join(best.select("query_id", bound), "query_id").select("query_id", "embedding", "bound"), False))


def _finite(df: DataFrame) -> bool:
    """Whether each vector has only finite numbers, and as many as the others."""
    odd = F.expr("embedding is null or exists(embedding, v -> v is null or isnan(v) or abs(v) = double('inf'))")
    return df.agg(F.coalesce(F.bool_or(odd), F.lit(False)) | (F.min(F.size("embedding")) < F.max(F.size("embedding")))).first()[0] is False


def batch_pairs(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", before: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, id, d (double): at least the k nearest of each query."""
    if k <= 0:
        return queries.sparkSession.createDataFrame([], _PAIR)
    (n_base, d_base), (n_query, d_query) = _shape(base), _shape(queries)
    dims = max(d_base, d_query)
    sc = queries.sparkSession.sparkContext
    if metric == "euclidean" and not before and d_base == d_query and 0 < dims <= BOXED_DIMS and n_base * n_query >= BOXED_PAIRS and _finite(base) and _finite(queries):
        return _boxed(queries, base, k, n_base, dims, Scratch(queries.sparkSession))
    if n_base * dims * 8 <= limit:
        held = sc.broadcast(_local(base, "id", dims))

        def by_query(batches):
            ids, b = held.value
            for x in batches:
                qid = x.column(0).to_numpy()
                yield _pairs(qid, nearest(metric, matrix(x.column(1), dims), b, ids, k, _mask(qid, ids, before)))

        return queries.select("query_id", "embedding").mapInArrow(by_query, _PAIR)
    if n_query * dims * 8 <= limit:
        asked = sc.broadcast(_local(queries, "query_id", dims))

        def by_base(batches):
            qid, q = asked.value
            for x in batches:
                ids = x.column(0).to_numpy()
                yield _pairs(qid, nearest(metric, q, matrix(x.column(1), dims), ids, k, _mask(qid, ids, before)))

        return base.select("id", "embedding").mapInArrow(by_base, _PAIR)
    blocks_q, blocks_b = -(-n_query // BLOCK), -(-n_base // BLOCK)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(block("query_id", blocks_q).alias("i"), every(blocks_b).alias("j"), F.lit(True).alias("query"), F.col("query_id").alias("id"), "embedding")
    b = base.select(every(blocks_q).alias("i"), block("id", blocks_b).alias("j"), F.lit(False).alias("query"), "id", "embedding")

    def meet(t: pa.Table) -> pa.Table:
        asks = t.column("query").to_numpy()
        ids, x = t.column("id").to_numpy(), matrix(t.column("embedding"), dims)
        return pa.Table.from_batches([_pairs(ids[asks], nearest(metric, x[asks], x[~asks], ids[~asks], k, _mask(ids[asks], ids[~asks], before)))])

    return q.select("i", "j", "query", "id", "embedding").unionByName(b.select("i", "j", "query", "id", "embedding")).groupBy("i", "j").applyInArrow(meet, _PAIR)
