"""Substring and near-duplicate removal against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import components, minhash, quality, substrings, words

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def removed(texts: list, k: int) -> list[tuple[int, int, str]]:
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[a : a + k]) for w in words for a in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if seen[tuple(w[a : a + k])] > 1:
                gone[a : a + k] = [True] * k
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def sets(text, width):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def groups(rows, width, percent=80):
    """Each row's set and the rows reachable from it, over all pairs."""
    s = [sets(t, width) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                up[find(i)] = find(j)
    return s, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("k", [35, 3])
def test_repeats_go(rows, docs, scratch, k):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"], r["node"]) for r in substrings.remove_repeats(docs, scratch, k).collect())
    assert got == Counter((d, *x, 8) for (d, *_), x in zip(rows, removed([t for _, t, _ in rows], k), strict=True))


def test_chains_compact_to_unitigs(spark, scratch):
    """One passage in three texts is one unitig, whole; where a fourth text shares half of it, it splits in two."""
    passage = [f"p{i}" for i in range(300)]
    texts = [[*(f"{c}{i}" for i in range(50)), *passage, *(f"{c}{i}" for i in range(50, 100))] for c in "abc"]
    marks = lambda rows: [m for r in substrings.repeated_windows(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string"), scratch).collect() for m in r["marks"]]
    whole = marks(texts)
    spans = Counter(m["n"] for m in whole if m["unitig"] is not None)
    assert max(spans) >= 300 - 34 - 2 * 28 and sum(spans.values()) == 3
    assert len({m["unitig"] for m in whole if m["unitig"] is not None}) == 1
    split = marks([*texts, [*(f"d{i}" for i in range(50)), *passage[:150]]])
    assert len({m["unitig"] for m in split if m["unitig"] is not None}) == 2


def test_equal_digests_of_other_words_are_found_out(spark, scratch, monkeypatch):
    """With a digest that under the first salt is one for all, spans don't verify, and the next salt gives the result."""
    texts = [" ".join(f"{c}{i % 7}" for i in range(60)) for c in "ab"] + [" ".join(f"c{i}" for i in range(60))] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    real = substrings.paths

    def weak(docs, k, seed, salt):
        seen.append(salt)
        out = real(docs, k, seed, salt)
        return out if salt else out.withColumns({"seed": F.lit(1).cast("long"), "path": F.lit(2).cast("long"), "path2": F.lit(3).cast("long")})

    monkeypatch.setattr(substrings, "paths", weak)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs, scratch).collect()}
    assert got == {i: n for i, (_, n, _) in enumerate(removed(texts, 35))} and seen == [0, 1]


def test_no_documents(empty, scratch):
    assert substrings.remove_repeats(empty, scratch).count() == 0
    assert minhash.near_duplicates(empty, scratch).count() == 0
    assert minhash.keep_one(empty, scratch).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), min_size=1, max_size=80), st.integers(1, 40))
def test_least_is_leftmost(values, width):
    x = np.array(values, np.uint64)
    want = [a + int(np.argmin(x[a : a + width])) for a in range(len(x) - width + 1)]
    assert substrings.least(x, width).tolist() == want


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(rows, docs, scratch, width):
    s, root = groups(rows, width)
    ids = defaultdict(list)
    for (d, *_), r in zip(rows, root, strict=True):
        if d is not None:
            ids[r].append(d)
    want = Counter()
    for (d, *_), x, r in zip(rows, s, root, strict=True):
        c = (min(ids[r]) if ids[r] else None) if x else d
        want[d, len(x), c, d == c] += 1
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs, scratch, width).collect()) == want


def test_one_of_each_group_stays(rows, docs, scratch):
    s, root = groups(rows, 5)
    kept = minhash.keep_one(docs, scratch)
    assert kept.columns == docs.columns
    got = kept.collect()
    empty_rows = sum(not x for x in s)
    assert len(got) == len({r for r, x in zip(root, s, strict=True) if x}) + empty_rows
    place = {(d, t): r for (d, t, *_), r in zip(rows, root, strict=True)}
    filled = [place[r["doc_id"], r["text"]] for r in got if (r["text"] or "").split()]
    assert len(filled) == len(set(filled))


def test_star_of_copies_that_only_the_original_links(spark, scratch):
    """Copies that link with the original but hardly with each other, plus texts just below the threshold."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]

    def copy(edits):
        w = list(base)
        for at in rng.sample(range(0, 150, 4), edits):
            w[at] = f"e{rng.randrange(10**9)}"
        return " ".join(w)

    rows = [(0, " ".join(base), None)] + [(i, copy(8), None) for i in range(1, 60)] + [(i, copy(rng.choice([9, 10, 12])), None) for i in range(60, 120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    _, root = groups(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, scratch, 2).collect()}
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert got == {i: least[r] for i, r in enumerate(root)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    m, n, shared = 240, 300, 267
    seen = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
        sig = minhash.superminhash(np.concatenate([x[:n], x[:shared], x[n:]]), np.array([n, n]), m)
        seen.append((sig[0] == sig[1]).mean())
    truth = shared / (2 * n - shared)
    assert abs(np.mean(seen) - truth) < 0.01
    assert np.std(seen) < (truth * (1 - truth) / m) ** 0.5  # below plain MinHash's


def test_signature_does_not_depend_on_blocks():
    x = np.random.default_rng(1).integers(0, 2**63, 200_000, dtype=np.uint64)
    whole = minhash.superminhash(x, np.array([len(x)]), 64)
    parts = np.minimum(minhash.superminhash(x[:90_000], np.array([90_000]), 64), minhash.superminhash(x[90_000:], np.array([110_000]), 64))
    assert np.array_equal(whole, parts)


def test_shingles_of_short_texts():
    sets = minhash.Shingles(pa.array(["a b c", "A b", "a", "", None, "a a a a"]), 2)
    assert sets.count.tolist() == [2, 1, 1, 0, 0, 1]
    assert sets.text.tolist() == [0, 0, 1, 2, 5]
    assert len(set(sets.code.tolist())) == 4


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark, scratch):
    """A Thue-Morse word and its complement collide under any polynomial modulo 2**64."""
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rest = " ".join(f"p{i}" for i in range(34))
    texts = [f"{rest} {x}", f"{rest} {y}", x, y]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs, scratch).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0}
    same = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs.where("doc_id > 1"), scratch, 2).collect()}
    assert same == {2: 2, 3: 3}
    line = pa.array([f"{x}\n{y}\n{x}"])
    assert quality.measure_texts(line)["n_dup_lines"].tolist() == [1]


def test_links_need_equal_words_whatever_the_digests(spark, scratch, monkeypatch):
    """With digests that meet all the time, signatures propose too much; full sets of words decide."""
    monkeypatch.setattr(minhash, "superminhash", lambda value, count, m: np.ones((len(count), m), np.uint64))
    texts = pa.array(["a b c d e", "a b c d e f", "v w x y z"])
    node, comp = np.arange(3), np.arange(3)
    assert minhash._block_links(texts, comp, node, 2, 80) == [(1, 0)]
    assert minhash._block_links(texts, comp, node, 2, 81) == []


@pytest.mark.parametrize("width", [1, 2, 5, 8, 35])
def test_run_codes_and_digests_tell_runs_apart(width):
    rng = np.random.default_rng(width)
    for top in (2, 50, 2**40):
        codes = rng.integers(0, top, 400)
        runs = [tuple(codes[i : i + width].tolist()) for i in range(len(codes) - width + 1)]
        exact = words.run_codes(codes, width).tolist()
        assert len(set(runs)) == len(set(exact)) == len(set(zip(runs, exact, strict=True)))
        digests = words.run_digests(words.mix(codes.astype(np.uint64)), width, 1).tolist()
        assert len(set(runs)) == len(set(digests)) == len(set(zip(runs, digests, strict=True)))


def test_components_of_a_chain_and_a_star(spark, scratch):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r["node"]: r["comp"] for r in components.connected(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1200)}


def test_few_edges_are_joined_without_rounds_and_many_in_rounds(spark, scratch, monkeypatch):
    edges = [(x + 1, x) for x in range(300)] + [(900 + x, 1000 - x) for x in range(40)] + [(5000, 4000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = {x: 0 for x in range(301)} | {x: min(x, 1900 - x) for e in edges[300:340] for x in e} | {4000: 4000, 5000: 4000}
    for few in (components.FEW, 0):
        monkeypatch.setattr(components, "FEW", few)
        before = scratch.n
        assert {r["node"]: r["comp"] for r in components.connected(df, scratch).collect()} == want
        assert (scratch.n - before <= 2) == (few > 0)
