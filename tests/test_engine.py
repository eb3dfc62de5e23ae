"""Functions, search, graph operators, store and facade of the vector index."""

import gc
import json
import math
import os
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import __version__, index
from lodestone.errors import CorruptIndexError, DimensionMismatchError, IndexLockedError, IndexNotFoundError, InvalidPathError, LodestoneError, OutOfBoundsError
from lodestone.functions import distance as fn
from lodestone.functions import sizing
from lodestone.index import SearchResult, VectorIndex
from lodestone.operators import ann, graph, knn
from lodestone.plans.runtime import Scratch, ship
from lodestone.schema import IndexOptions
from lodestone.sources.store import Store, dense_ids
from lodestone.streaming.ingest import append_batch, ingest

VECTOR = "id long, embedding array<float>"


@pytest.fixture
def scratch(spark):
    ship(spark)
    s = Scratch(spark)
    yield s
    s.release()


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], VECTOR)


def asking(df):
    return df.select(F.col("id").alias("query_id"), "embedding")


def exact(q, b, ids, k):
    d = np.sqrt(((b - q) ** 2).sum(1))
    return sorted(zip(d.tolist(), ids, strict=True))[:k]


# --- functions


@pytest.mark.parametrize("n", [3, 7, 15, 31, 128, 768, 1536])
def test_distances_of_waves(spark, n):
    a, b = [math.sin(i) for i in range(n)], [math.cos(i) for i in range(n)]
    r = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(fn.euclidean(F.col("a"), F.col("b")), fn.cosine(F.col("a"), F.col("b")), fn.dot(F.col("a"), F.col("b"))).first()
    x, y = np.array(a), np.array(b)
    assert r[0] == pytest.approx(np.linalg.norm(x - y), abs=1e-9)
    assert r[1] == pytest.approx(1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-9)
    assert r[2] == pytest.approx(x @ y, abs=1e-9)


def test_zero_norms_and_unequal_lengths(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    assert tuple(df.select(fn.cosine(a, b), fn.cosine(a, a)).first()) == (1.0, 1.0)
    with pytest.raises(Exception, match="dimension mismatch"):
        df.select(fn.euclidean(a, F.array(F.lit(1.0)))).collect()
    with pytest.raises(ValueError, match="unknown metric"):
        fn.distance("manhattan", a, b)


def test_layout_arithmetic():
    assert [sizing.record_size(*c) for c in ((16, 8), (16, 16), (32, 16), (64, 16))] == [1168, 2192, 4368, 8720]
    assert [sizing.layer_offset(n, 16) for n in (0, 1, 2, 15, 16)] == [16, 272, 400, 2064, None]
    assert sizing.page_align(4097) == 8192 and sizing.page_align(4096) == 4096
    assert sizing.vector_end(10_000, 768) + sizing.graph_size(10_000, 16) < 100 << 20
    assert (sizing.max_neighbors(0, 16), sizing.max_neighbors(3, 16)) == (32, 16)
    assert sizing.node_offset(2, 1, 4, 16) - sizing.node_offset(1, 1, 4, 16) == 2192
    assert sizing.layer_of(1e-300, 16) == 15 and sizing.layer_of(0.99, 16) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**40), st.integers(2, 64))
def test_draws_lie_between_the_bounds(i, m):
    u = sizing.uniform_of(i)
    assert 0 < u < 1 and 0 <= sizing.layer_of(u, m) <= 15


# --- search


@pytest.mark.parametrize("limit", [1 << 26, 4096, 0], ids=["base", "queries", "grid"])
def test_batch_equals_all_pairs(spark, limit):
    rng = np.random.default_rng(0)
    b, q = rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(20, 8)).astype(np.float32)
    got = {}
    for r in knn.batch(asking(frame(spark, q)), frame(spark, np.concatenate([b, b])), 7, limit=limit).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    both = np.concatenate([b, b]).astype(float)
    for i, x in enumerate(q.astype(float)):
        want = exact(x, both, range(600), 7)
        assert [n for n, _, _ in got[i]] == list(range(1, 8))
        assert [n for _, n, _ in got[i]] == [n for _, n in want]
        assert [d for *_, d in got[i]] == pytest.approx([d for d, _ in want], rel=1e-6)


def test_single_ties_limits_and_nan(spark):
    df = spark.createDataFrame([(3, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 0.0]), (0, [float("inf"), 0.0]), (4, [4.0, 0.0]), (5, [5.0, 0.0])], VECTOR)
    assert [r["id"] for r in knn.single(df, [0.0, 0.0], 99).orderBy("rank").collect()] == [1, 3, 4, 5, 0, 2]
    assert {r["id"] for r in knn.single(df, [4.5, 0.0], 2).collect()} == {4, 5}
    assert knn.single(df, [0.0, 0.0], 0).count() == 0
    q = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["id"] for r in knn.batch(q, df, 99).orderBy("rank").collect()] == [1, 3, 4, 5, 0, 2]
    assert knn.batch(q, df, 0).count() == 0 and knn.batch(q, df.limit(0), 3).count() == 0


def test_many_neighbours_of_one_query_are_ranked_in_parts(spark, monkeypatch):
    v = frame(spark, [[i * 7 % 50, 0.0] for i in range(200)])
    want = [tuple(r) for r in knn.single(v, [3.0, 0.0], 150).orderBy("rank").collect()]
    monkeypatch.setattr(knn, "IN_ONE_TASK", 10)
    assert [tuple(r) for r in knn.single(v, [3.0, 0.0], 150).orderBy("rank").collect()] == want and len(want) == 150
    assert knn.single(v, [3.0, 0.0], 999).count() == 200


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_other_metrics(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5))
    x[3] = 0
    df = frame(spark, x)
    fast = knn.batch(asking(df), df, 5, metric).orderBy("query_id", "rank").collect()
    pairs = df.crossJoin(df.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))).select("query_id", "id", fn.distance(metric, F.col("embedding"), F.col("q")).alias("d"))
    plain = knn._ranked(pairs, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"]) for r in fast] == [(r["query_id"], r["rank"]) for r in plain]
    assert [r["distance"] for r in fast] == pytest.approx([r["distance"] for r in plain], abs=1e-6)


# --- graph


def test_diversity_rule():
    line = np.array([[1.0, 0], [2.0, 0], [-1.5, 0], [0, 3.0]])
    d = np.linalg.norm(line, axis=1)
    assert graph.diverse(d, line, 4) == [0, 1, 2, 3]  # few: all, as they come
    assert graph.diverse(d, line, 3) == [0, 2, 3]  # the one behind another is passed over
    near = np.array([[1.0 + i / 100, 0] for i in range(10)])
    dn = np.linalg.norm(near, axis=1)
    assert graph.diverse(dn, near, 8) == list(range(8))  # fewer than half remain: filled from the nearest
    same = np.ones((40, 3))
    assert graph.diverse(np.zeros(40), same, 8) == list(range(8))  # ties are kept
    assert graph.diverse(dn, near, 4, priority=3)[-1] == 3
    assert 9 not in graph.diverse(dn, near, 4, priority=9)  # not among the nearest
    assert graph.diverse(np.array([]), np.zeros((0, 2)), 4) == []


def test_layers_candidates_links_and_caps(spark, scratch):
    rng = np.random.default_rng(2)
    v = frame(spark, rng.normal(size=(120, 4)))
    layers = graph.assign_layers(v, 4)
    top = graph.entry_point(layers).first()
    assert top["layer"] == max(r["layer"] for r in layers.collect())
    c = graph.candidates(v, layers, 0).groupBy("src").agg(F.count("*").alias("n"), F.max("dst").alias("hi")).collect()
    assert {r["src"]: r["n"] for r in c} == {i: min(i, 33) for i in range(1, 120)} and all(r["hi"] < r["src"] for r in c)
    g = scratch.save(graph.layer_graph(v, layers, 0, 4, scratch), "graph")
    assert g.groupBy("src").count().agg(F.max("count")).first()[0] <= 8
    assert g.where("src = dst").count() == 0
    both = graph.back_links(graph.forward_links(v, layers, 0, 4))
    assert graph.reachable(both, graph.entry_point(layers), scratch).count() == 120
    stats = graph.degree_stats(g.withColumn("layer", F.lit(0))).first()
    assert stats["nodes"] == 120 and stats["max_degree"] <= 8


def test_hub_is_pruned_and_bad_links_go(spark, scratch):
    v = frame(spark, [[0.0, 0.0]] + [[math.cos(i), math.sin(i)] for i in range(1, 100)])
    hub = spark.createDataFrame([(0, i, 1.0) for i in range(1, 100)], "src long, dst long, d double")
    assert graph.pruned(hub, v, 0, 8).count() <= 16
    links = spark.createDataFrame([(0, 1), (0, 999), (0, 1000), (1, 1), (1, -1), (1, None)], "src long, dst long")
    assert [tuple(r) for r in graph.link_filter(links, 3).collect()] == [(0, 1)]


def test_walks_end(spark, scratch):
    ring = spark.createDataFrame([(i, (i + 1) % 10) for i in range(10)] + [((i + 1) % 10, i) for i in range(10)], "src long, dst long")
    v = frame(spark, [[math.cos(2 * math.pi * i / 10), math.sin(2 * math.pi * i / 10)] for i in range(10)])
    start = spark.createDataFrame([(0,)], "id long")
    assert {r["id"]: r["hops"] for r in graph.reachable(ring, start, scratch).collect()} == {i: min(i, 10 - i) for i in range(10)}
    assert {r["query_id"]: r["id"] for r in graph.greedy_descent(asking(v), v, ring, start, scratch).collect()} == {i: i for i in range(10)}


def test_sharded_search_recall(spark, scratch):
    rng = np.random.default_rng(3)
    v = frame(spark, rng.normal(size=(800, 16)))
    q = asking(frame(spark, rng.normal(size=(60, 16))))
    truth = knn.batch(q, v, 10)
    for shards in (1, 3):
        per = -(-800 // shards)
        g = scratch.save(ann.build_graph(v, IndexOptions(), per), "graph")
        sizes = g.groupBy("id", "layer").agg(F.max(F.size("neighbors")).alias("n")).collect()
        assert all(r["n"] <= (32 if r["layer"] == 0 else 16) for r in sizes)
        low, high = (ann.recall(ann.search(q, v, g, 10, IndexOptions(ef_search=ef), 800, per), truth).first()["recall"] for ef in (10, 50))
        assert high >= 0.95 and high >= low
    assert ann.search(q, v, g, 0, IndexOptions(), 800).count() == 0


def test_a_narrow_beam_is_widened_until_it_finds_the_nearest(spark, scratch):
    x = np.random.default_rng(5).normal(size=(1500, 32))
    v, options = frame(spark, x), IndexOptions(max_connections=6, ef_search=1)
    g = scratch.save(ann.build_graph(v, options), "graph")
    truth = knn.batch(asking(v.where("id % 10 = 0")), v, 10)
    found = ann.search(asking(v.where("id % 10 = 0")), v, g, 10, options, 1500)
    assert ann.recall(found, truth).first()["recall"] >= 0.95


def test_a_beam_as_wide_as_the_shard_ends_with_all_that_links_lead_to(monkeypatch):
    x = np.random.default_rng(6).normal(size=(60, 3))
    rows = [(i, 0, sorted({(i + 7) % 30, (i * i) % 30} - {i}) if i < 30 else [i - 30, 30 + (i + 1) % 30]) for i in range(60)]
    rows += [(40, 1, [5]), (5, 1, [40])]
    g = ann.Graph.of(np.arange(60), x, rows, 4)
    q = np.random.default_rng(7).normal(size=(40, 3))
    walked = [(i, n, d) for i in range(40) for d, n in g.search(q[i], 10, 60)]
    monkeypatch.setattr(ann.Graph, "beam", None)  # no walk
    assert sorted(zip(*(c.tolist() for c in g.search_all(q, 10, 60)), strict=True)) == sorted(walked)
    assert len(g.reach) == 2 and sorted(map(len, g.reach)) == [30, 60]


def test_boxes_of_short_vectors_miss_no_neighbour(spark, scratch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(0, 4, (1500, 3)), rng.normal(size=(500, 3)) * 9, np.ones((700, 3))]).astype(np.float32)
    v = frame(spark, x)
    q = frame(spark, np.concatenate([x[::40], [[99.0, 0, 0]]]).astype(np.float32))
    for k in (3, 40):
        want = knn.batch(asking(q), v, k).orderBy("query_id", "rank").collect()
        assert knn._ranked(knn._boxed(asking(q), v, k, 2700, 3, scratch, 60), k).orderBy("query_id", "rank").collect() == want
    assert knn._finite(v) and not knn._finite(frame(spark, np.array([[1.0, np.nan]])))


def test_search_terminates_on_cycles_and_sees_only_what_is_there():
    x = np.array([[float(i), 0.0] for i in range(6)])
    rows = [(i, 0, [(i + 1) % 6, (i - 1) % 6, 77]) for i in range(6)]
    g = ann.Graph.of(np.arange(6), x, rows, 4)
    assert [n for _, n in g.search(np.array([4.4, 0.0]), 3, 1)] == [4, 5, 3]
    assert ann.Graph.of(np.arange(0), x[:0], [], 4).search(np.array([0.0, 0.0]), 3, 5) == []


def test_a_graph_that_grows_equals_one_built_at_once(spark, scratch):
    v = frame(spark, np.random.default_rng(8).normal(size=(500, 8)))
    options = IndexOptions(max_connections=4, ef_construction=30)
    once = {(r["id"], r["layer"]): r["neighbors"] for r in ann.build_graph(v, options, 200).collect()}
    old = scratch.save(ann.build_graph(v.where("id < 250"), options, 200), "old")
    grown = ann.build_graph(v, options, 200, 0, 250, old).collect()
    assert {r["id"] for r in grown} == set(range(200, 500))  # the full shard is left alone
    kept = {(r["id"], r["layer"]): r["neighbors"] for r in old.where("id < 200").collect()}
    assert kept | {(r["id"], r["layer"]): r["neighbors"] for r in grown} == once


def test_rows_that_the_layout_does_not_allow(spark):
    rows = [(0, 0, [1, 2]), (1, 0, [1]), (2, 0, [9]), (3, 0, [0, 0]), (4, 16, [0]), (5, 1, [0, 1, 2]), (6, 0, None), (-1, 0, [0]), (7, 0, [-1])]
    bad = graph.graph_violations(spark.createDataFrame(rows, "id long, layer int, neighbors array<long>"), 8, 2, 16).collect()
    assert sorted(r["id"] for r in bad) == [-1, 1, 2, 3, 4, 5, 6, 7]
    edits = spark.createDataFrame([(0, 0, [0, 3, 3, 99, 4, 5, 6, 7]), (99, 0, [1])], "id long, layer int, neighbors array<long>")
    got = {(r["id"], r["layer"]): r["neighbors"] for r in graph.edited(spark.createDataFrame(rows[:2], "id long, layer int, neighbors array<long>"), edits, 8, 2).collect()}
    assert got == {(0, 0): [3, 4, 5, 6], (1, 0): [1]}


def test_draws_of_any_id(spark):
    ids = [0, 7, 2**31 - 1, 2**31, 9 * 10**9, 2**62]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select(sizing.uniform(F.col("id")).alias("u")).collect()
    assert [r["u"] for r in got] == [sizing.uniform_of(i) for i in ids]


# --- store and facade


def test_dense_ids_follow_the_order(spark, scratch):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v long").repartition(7)
    assert [(r["id"], r["v"]) for r in dense_ids(df, 5, ["v"], scratch).orderBy("id").collect()] == [(5 + i, i) for i in range(1000)]
    assert dense_ids(df.limit(0), 5, ["v"], scratch).count() == 0


def test_life_of_an_index(spark, tmp_path):
    path = str(tmp_path / "ix")
    with VectorIndex(spark, path, 4) as ix:
        assert ix.is_empty and len(ix) == 0 and ix.dimensions == 4 and ix.search([0, 0, 0, 0]) == []
        assert [ix.add([i, 0, 0, 0]) for i in range(3)] == [0, 1, 2]
        assert ix.add_batch(frame(spark, [[3, 0, 0, 0], [4, 0, 0, 0]]).select("embedding", "id"), ["id"]) == range(3, 5)
        assert ix.add_batch(np.array([[5, 0, 0, 0]])) == range(5, 6) and ix.add_batch([]) == range(6, 6)
        got = ix.search([4.4, 0, 0, 0], 2)
        assert [r.id for r in got] == [4, 5] and repr(got[0]) == "SearchResult(id=4, distance=0.400000)"
        assert len(ix) == 6 and isinstance(got[0], SearchResult)
        with pytest.raises(IndexLockedError, match="already open"):
            VectorIndex(spark, path, 4)
        with pytest.raises(DimensionMismatchError, match="dimension mismatch"):
            ix.add([1, 2])
        with pytest.raises(DimensionMismatchError):
            ix.add(np.zeros((4, 2)))
        with pytest.raises(DimensionMismatchError):
            ix.search([1.0])
        with pytest.raises(ValueError, match="k must be"):
            ix.search([0, 0, 0, 0], 0)
        with pytest.raises(DimensionMismatchError):
            ix.add_batch(spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],)], "embedding array<float>"))
        assert len(ix) == 6  # nothing of a refused batch stays
        with pytest.raises(LodestoneError, match="no graph"):
            ix.search([0, 0, 0, 0], mode="ann")
        ix.flush(graph=True)
        assert [r.id for r in ix.search([1.2, 0, 0, 0], 3, mode="ann")] == [1, 2, 0]
        assert ix.get_vector(5) == [5.0, 0, 0, 0]
        with pytest.raises(OutOfBoundsError, match="out of bounds"):
            ix.get_vector(6)
        ix.add([9, 9, 9, 9])  # never flushed
    ix.close()
    with pytest.raises(LodestoneError, match="closed"):
        len(ix)
    with VectorIndex(spark, path, 4) as ix:
        assert len(ix) == 6 and ix.add([7, 0, 0, 0]) == 6  # the id of what was lost is given anew
        reader = VectorIndex(spark, path, 4, read_only=True)
        ix.flush()
        assert len(reader) == 6 and len(VectorIndex(spark, path, 4, read_only=True)) == 7  # readers keep their snapshot
        with pytest.raises(LodestoneError, match="reading only"):
            reader.add([0, 0, 0, 0])
    assert __version__


def test_opening_refuses_what_would_do_harm(spark, tmp_path):
    path = str(tmp_path / "ix")
    VectorIndex(spark, path, 3).close()
    with pytest.raises(DimensionMismatchError, match="mismatch"):
        VectorIndex(spark, path, 4)
    with pytest.raises(LodestoneError, match="max_connections mismatch"):
        VectorIndex(spark, path, 3, IndexOptions(max_connections=8))
    VectorIndex(spark, path, 3, IndexOptions(ef_search=99)).close()
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    (foreign / "notes.txt").write_text("mine")
    with pytest.raises(InvalidPathError):
        VectorIndex(spark, str(foreign), 3)
    assert os.listdir(foreign) == ["notes.txt"] or (foreign / "notes.txt").read_text() == "mine"
    for dims in (0, 4097):
        with pytest.raises(ValueError):
            VectorIndex(spark, str(tmp_path / "new"), dims)
    assert not (tmp_path / "new").exists()
    for m in (0, 1, 32768):
        with pytest.raises(ValueError):
            IndexOptions(max_connections=m).validate()
    with pytest.raises(InvalidPathError):
        VectorIndex(spark, "", 3)
    with pytest.raises(IndexNotFoundError):
        VectorIndex(spark, str(tmp_path / "none"), 3, read_only=True)


def test_recovery(spark, tmp_path):
    path = str(tmp_path / "ix")
    with VectorIndex(spark, path, 2) as ix:
        ix.add_batch([[1, 1], [2, 2]])
        ix.flush()
    store = Store.open(spark, path, 2)
    store.stage(frame(spark, [[3, 3]]).select("embedding"))  # a writer that died before publishing
    store.close()
    manifest = json.loads((tmp_path / "ix" / "manifest.json").read_text())
    with VectorIndex(spark, path, 2) as ix:
        assert len(ix) == 2 and ix.add([3, 3]) == 2
    manifest["node_count"] = 5
    (tmp_path / "ix" / "manifest.json").write_text(json.dumps(manifest))
    for crc in (tmp_path / "ix").glob(".manifest.json*"):
        crc.unlink()
    with pytest.raises(CorruptIndexError, match="corruption"):
        VectorIndex(spark, path, 2)
    (tmp_path / "ix" / "manifest.json").write_text("{}")
    with pytest.raises(InvalidPathError):
        VectorIndex(spark, path, 2)


def test_the_lock_of_a_dead_writer_runs_out(spark, tmp_path):
    path = str(tmp_path / "ix")
    VectorIndex(spark, path, 2).close()
    lock = tmp_path / "ix" / "writer.lock"
    lock.write_text(json.dumps({"owner": "gone", "until": time.time() + 60}))
    with pytest.raises(IndexLockedError, match="already open"):
        VectorIndex(spark, path, 2)
    lock.write_text(json.dumps({"owner": "gone", "until": time.time() - 1}))
    with VectorIndex(spark, path, 2, lease=6) as ix:
        time.sleep(7)  # renewed meanwhile
        with pytest.raises(IndexLockedError):
            VectorIndex(spark, path, 2)
        ix.add([1, 1])
        for crc in (tmp_path / "ix").glob(".writer.lock*"):
            crc.unlink()
        lock.write_text(json.dumps({"owner": "thief", "until": time.time() - 1}))
        with pytest.raises(IndexLockedError, match="taken"):
            ix.flush()  # fenced off
    assert lock.exists()  # another's lock is left alone
    lost = VectorIndex(spark, path, 2, lease=1)
    assert len(lost) == 0
    del lost  # a handle that is never closed
    gc.collect()
    time.sleep(2)
    VectorIndex(spark, path, 2).close()
    assert not lock.exists()


def test_a_graph_grows_with_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 20)
    x = np.random.default_rng(5).normal(size=(50, 4)).astype(np.float32)
    with VectorIndex(spark, str(tmp_path / "ix"), 4, IndexOptions(max_connections=4)) as ix:
        for lo, hi in ((0, 10), (10, 35), (35, 50)):
            ix.add_batch(x[lo:hi])
            with pytest.raises(LodestoneError, match="no graph"):
                ix.search(x[0], 1, mode="ann")
            ix.flush(graph=True)
            ix.check()
            asked = frame(spark, x[:hi].tolist()).selectExpr("id as query_id", "embedding")
            assert {r["query_id"]: r["id"] for r in ix.search_batch(asked, 1, "ann").collect()} == {i: i for i in range(hi)}
        assert sorted(r["id"] for r in ix.graph().where("layer = 0").collect()) == list(range(50))
        assert ix.neighbors(0) and ix.neighbors(0, 15) == []
        assert [a for _, a in ix._store.manifest.graphs] == [0, 20]  # the third flush took over the last shards only
        ix.flush(graph=True)  # nothing new
    with VectorIndex(spark, str(tmp_path / "ix"), 4, IndexOptions(max_connections=4), read_only=True) as ix:
        assert [r.id for r in ix.search(x[49], 1, mode="ann")] == [49]


def test_a_batch_is_appended_once(spark, tmp_path):
    """A batch that comes again after a crash between commit and stream changes nothing; a failed one leaves nothing."""
    rows = frame(spark, [[i, i] for i in range(5)])
    with VectorIndex(spark, str(tmp_path / "ix"), 2) as ix:
        assert append_batch(ix, rows, 0, "s", ["id"])
    with VectorIndex(spark, str(tmp_path / "ix"), 2) as ix:
        assert not append_batch(ix, rows, 0, "s", ["id"]) and len(ix) == 5
        with pytest.raises(DimensionMismatchError):
            append_batch(ix, frame(spark, [[1.0]]), 1, "s", ["id"])
        assert len(ix) == 5 and append_batch(ix, rows, 1, "s", ["id"]) and append_batch(ix, rows, 0, "other", ["id"])
        assert len(ix) == 15 and ix.last_batch("s") == 1


def test_what_add_buffers_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUFFER", 8)
    with VectorIndex(spark, str(tmp_path / "ix"), 2) as ix:
        assert ix.add_batch(np.arange(20).reshape(10, 2)) == range(0, 10) and len(ix._buffer) < 4
        assert [ix.add([i, 0]) for i in range(5)] == list(range(10, 15)) and len(ix._buffer) < 4
        ix.flush()
        assert [r["embedding"][0] for r in ix.vectors().orderBy("id").collect()] == [*range(0, 20, 2), *range(5)]


def test_streaming_ingest(spark, tmp_path):
    source = str(tmp_path / "in")
    frame(spark, [[i, i] for i in range(20)]).write.parquet(source)
    with VectorIndex(spark, str(tmp_path / "ix"), 2) as ix:
        stream = spark.readStream.schema(VECTOR).parquet(source)
        ingest(stream, ix, str(tmp_path / "ck"), ["id"]).awaitTermination(120)
        assert len(ix) == 20 and ix.get_vector(7) == [7.0, 7.0]
        ingest(stream, ix, str(tmp_path / "ck"), ["id"]).awaitTermination(120)
        assert len(ix) == 20
