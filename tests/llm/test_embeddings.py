"""Near-duplicate vectors against all pairs."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import embeddings


def brute(ids, vectors, threshold):
    """(n_links, component) of each row; None vectors link with nothing."""
    n = len(ids)
    good = [v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    x = np.array([v if g else [1.0] * 8 for v, g in zip(vectors, good, strict=True)], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= threshold) & np.array(good)[:, None] & np.array(good)[None, :]
    np.fill_diagonal(link, False)
    comp = np.arange(n)
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(n)])
        if np.array_equal(new, comp):
            break
        comp = new
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[comp[i]] = min(least.get(comp[i], ids[i]), ids[i])
    return [(ids[i], int(link[i].sum()), least.get(comp[i])) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_links_and_components(spark, scratch, threshold):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    for base in range(0, 20):
        rows += [(1000 + 10 * base + j, (np.array(rows[base][1]) + rng.normal(0, 0.08, 8)).tolist()) for j in range(6)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)]  # equal vectors
    rows += [(3000, (np.array(rows[1][1]) * 7).tolist()), (3001, (np.array(rows[1][1]) * -1).tolist())]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 8), (4003, [float("nan")] + [1.0] * 7), (4004, [float("inf")] + [1.0] * 7), (4005, [None] + [1.0] * 7), (4006, [1.0] * 9)]
    rows += [(None, rows[2][1]), (5, rows[3][1]), (5, rows[3][1])]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, cell string")
    got = embeddings.near_vectors(df, scratch, threshold).collect()
    want = brute([i for i, _ in rows], [v for _, v in rows], threshold)
    if threshold == 0.95:
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == Counter(want)
    else:  # far links in few dimensions spread over many cells: the contract is recall
        assert 0.98 * sum(n for _, n, _ in want) <= sum(r["n_links"] for r in got) <= sum(n for _, n, _ in want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_no_vectors(spark, scratch):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(df, scratch).count() == 0
    only_bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embeddings.near_vectors(only_bad, scratch).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_multi_sequence_visits_the_nearest_cells():
    rng = np.random.default_rng(1)
    index = embeddings.MultiIndex(rng.normal(size=(7, 4)), rng.normal(size=(5, 4)), 4)
    x = rng.normal(size=(50, 8))
    a, b = index.distances(x)
    every = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
    for n in (1, 6, 35):
        near = index.nearest(x, n)
        assert np.allclose(np.take_along_axis(every, near, 1), np.sort(every, 1)[:, :n])
    assert (index.rank(x, index.cells(x)) == 1).all()


def test_recall_on_clusters(spark, scratch):
    """Recall against all pairs, with far more vectors than a cell holds."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4000, 16))
    near = base[rng.integers(0, 400, 2000)] + rng.normal(0, 0.1, (2000, 16))
    x = np.concatenate([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = np.zeros(len(x), int)
    for r in embeddings.near_vectors(df, scratch).collect():
        got[r["vec_id"]] = r["n_links"]
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum()


def test_recall_of_sparse_pairs_near_the_threshold(spark, scratch):
    """Few vectors have a near one, at cosine 0.95 to 0.97, and hardly any of those is probed."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(400, 64))
    x = centres[rng.integers(0, 400, 40_000)] + rng.normal(0, 0.6, (40_000, 64))
    x = embeddings.unit(x)
    u, cosine = x[:300], rng.uniform(0.951, 0.97, 300)[:, None]
    side = rng.normal(size=u.shape)
    side = embeddings.unit(side - (side * u).sum(1, keepdims=True) * u)
    x = np.concatenate([x, cosine * u + (1 - cosine**2) ** 0.5 * side]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}))
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, scratch).where("n_links > 0").collect()}
    met = [i for i in range(300) if i in got and 40_000 + i in got]
    assert len(met) >= 0.98 * 300
    assert all(got[i]["component_id"] == got[40_000 + i]["component_id"] and not got[40_000 + i]["kept"] for i in met)
    assert len(got) == 2 * len(met)


def test_a_probes_own_vector_is_no_link(spark):
    """One hot group of close vectors does not set the cells that rare pairs need."""
    rng = np.random.default_rng(5)
    x = embeddings.unit(rng.normal(size=(3000, 16)))
    x[:1500] = embeddings.unit(x[0] + rng.normal(0, 0.001, (1500, 16)))
    index = embeddings.MultiIndex(embeddings.kmeans(x[:, :8], 8, 1), embeddings.kmeans(x[:, 8:], 8, 2), 8)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, embedding array<double>")
    at = np.arange(0, 3000, 10)
    n = embeddings.visits(df, index, at, x[at], 16, 0.95, 0.998)
    side = rng.normal(size=x[1500:].shape)
    side = embeddings.unit(side - (side * x[1500:]).sum(1, keepdims=True) * x[1500:])
    y = 0.95 * x[1500:] + (1 - 0.95**2) ** 0.5 * side
    every = np.arange(1500)
    assert (index.meeting(x[1500:], y, every, every) <= n).mean() >= 0.98


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_of_a_few_pairs_among_random_vectors(spark, scratch, seed):
    """Thirty pairs at cosine 0.955 among 20,000 vectors that have no other links."""
    rng = np.random.default_rng(seed)
    x = embeddings.unit(rng.normal(size=(20_000, 64)))
    side = rng.normal(size=(30, 64))
    side = embeddings.unit(side - (side * x[:30]).sum(1, keepdims=True) * x[:30])
    x = np.concatenate([x, 0.955 * x[:30] + (1 - 0.955**2) ** 0.5 * side])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))}))
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df, scratch).where("n_links > 0").collect()}
    assert sum(got.values()) >= 0.98 * 60 and set(got.values()) == {1}
    assert all((i + 20_000 if i < 30 else i - 20_000) in got for i in got)


def test_every_length_is_compared(spark, scratch):
    """Vectors of equal direction link with those of their own length, whichever length most have."""
    rows = [(i, [1.0, 2.0 * (i + 1)]) for i in range(2)] + [(10 + i, [float(i + 1), 2.0 * (i + 1), 0.5 * (i + 1)]) for i in range(5)]
    rows += [(20 + i, [3.0 + i]) for i in range(3)] + [(30, [-1.0]), (40, [0.0, 0.0]), (41, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df, scratch).collect()}
    assert [got[i] for i in (10, 11, 12, 13, 14)] == [(4, 10, True)] + [(4, 10, False)] * 4
    assert got[0] == (1, 0, True) and got[1] == (1, 0, False)
    assert [got[i] for i in (20, 21, 22, 30)] == [(2, 20, True), (2, 20, False), (2, 20, False), (0, 30, True)]
    assert got[40] == (0, 40, True) and got[41] == (0, 41, True)
