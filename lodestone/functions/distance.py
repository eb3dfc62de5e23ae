"""Distances: Spark column expressions in double precision, and their numpy twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "dot")


def _same_size(a: Column, b: Column, value: Column) -> Column:
    """zip_with pads the shorter array with nulls; unequal lengths are an error instead."""
    return F.when(F.size(a) == F.size(b), value).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("dimension mismatch")).cast("double"))


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _same_size(a, b, _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    """Root of the summed squared differences."""
    step = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return _same_size(a, b, F.sqrt(_fold(F.zip_with(a, b, step))))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """1 - dot / (norm * norm); 1 if either vector is zero."""
    product = norm(a) * norm(b)
    return F.when(product == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / product)


def distance(metric: str, a: Column, b: Column) -> Column:
    """The ranking distance of a metric; for `dot` the negated product."""
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")


def matrix_distances(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact distances of each row of q to each row of b, in double precision."""
    q, b = q.astype(np.float64), b.astype(np.float64)
    if metric == "euclidean":
        out = np.empty((len(q), len(b)))
        for i in range(len(q)):
            d = b - q[i]
            out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out
    product = q @ b.T
    if metric == "dot":
        return -product
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(b, axis=1)
    return np.where(norms == 0, 1.0, 1 - product / np.where(norms == 0, 1, norms))


#: Rows of each side whose distances are held at once.
QUERIES_AT_ONCE, BASE_AT_ONCE = 256, 8192


def pair_distances(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each row of q to the same row of b, by the formula that matrix_distances has."""
    if metric == "euclidean":
        gap = b - q
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))
    product = np.einsum("ij,ij->i", q, b)
    if metric == "dot":
        return -product
    norms = np.linalg.norm(q, axis=1) * np.linalg.norm(b, axis=1)
    return np.where(norms == 0, 1.0, 1 - product / np.where(norms == 0, 1, norms))


def _rough(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that order pairs as their distances do, but for rounding."""
    if metric == "euclidean":
        return (q * q).sum(1)[:, None] + (b * b).sum(1) - 2 * (q @ b.T)
    if metric == "dot":
        return -(q @ b.T)
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(b, axis=1)
    return np.where(norms == 0, 1.0, 1 - (q @ b.T) / np.where(norms == 0, 1, norms))


def nearest(metric: str, q: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the k nearest of each row, by (distance, id); NaN distances come last.

    Block by block, matrix products propose what may be among the k, with room for their rounding error; the exact
    formula ranks the proposed pairs. `allowed` masks pairs.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(q) or not len(b) or k < 1:
        return none
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    q, b = q.astype(np.float64), b.astype(np.float64)
    if not (np.isfinite(q).all() and np.isfinite(b).all()):
        return _nearest_of_any(metric, q, b, ids, k, allowed)
    largest = (b * b).sum(1).max()
    found = []
    for a in range(0, len(q), QUERIES_AT_ONCE):
        part = q[a : a + QUERIES_AT_ONCE]
        slack = 1e-12 * (1 + (part * part).sum(1) + largest)
        bound = np.full(len(part), np.inf)
        held = []
        for c in range(0, len(b), BASE_AT_ONCE):
            rough = _rough(metric, part, b[c : c + BASE_AT_ONCE])
            if allowed is not None:
                rough[~allowed[a : a + QUERIES_AT_ONCE, c : c + BASE_AT_ONCE]] = np.inf
            near = (rough <= bound[:, None]) & (rough < np.inf)
            if rough.shape[1] >= k and np.count_nonzero(near) > 4 * k * len(part):  # the first block, and where nearer ones come late
                bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
                near &= rough <= bound[:, None]
            i, j = np.nonzero(near)
            held.append((i, j + c, rough[i, j]))
        i, j, rough = (np.concatenate(x) for x in zip(*held, strict=True))
        near = rough <= bound[i]
        i, j = i[near], j[near]
        d = pair_distances(metric, part[i], b[j])
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[place < k] + a, ids[j[place < k]], d[place < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _nearest_of_any(metric: str, q: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest() where some numbers are not finite: every distance by the exact formula."""
    rows, out_id, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in range(len(q)):
        d = matrix_distances(metric, q[i : i + 1], b)[0]
        usable = np.arange(len(b)) if allowed is None else np.flatnonzero(allowed[i])
        order = usable[np.lexsort((ids[usable], d[usable]))[:k]]
        rows.append(np.full(len(order), i))
        out_id.append(ids[order])
        out_d.append(d[order])
    return np.concatenate(rows), np.concatenate(out_id), np.concatenate(out_d)
