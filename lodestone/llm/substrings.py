"""Removal of long passages that repeat, through a De Bruijn graph of word k-mers.

An edge of the graph is a window of k words. Windows are never shuffled one by one: each belongs to the least
seed (a shorter run of words) within it, so equal windows meet at equal seeds, and the consecutive windows of a
text under one seed form a path, named by BLAKE2b over its words. A seed met once holds no repeat. Paths are the
nodes of the compacted graph, each with the path that follows it in its text. Where a repeated path is always
followed by the same one, which always follows it, the two compact; joins that double their reach compact whole
chains into unitigs. Only paths that occur once, under a seed that others share, are taken apart into windows, read
again from their source coordinates.

At last every span that a unitig marks is read at its source coordinates and its words are held, by SHA-256, to those
of the unitig's other spans. Should two differ, all is done again under another salt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.batches import WORDS_BYTES, column, slices, working
from lodestone.llm.words import U, Words, forget, lanes, mix, run_digests
from lodestone.plans.runtime import Scratch

K = 35
SEED = 8
SPANS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("unitig", "d1", "d2")]))
#: Salts to try, and doublings of a chain's reach (2**40 paths).
SALTS, DOUBLINGS = 4, 40


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in each run of `width` values, by doubling."""
    at, low, span = np.arange(len(values)), values, 1
    while span < width:
        step = min(span, width - span)
        if len(low) <= step:
            return at[:0]
        right = low[step:] < low[:-step]
        at, low = np.where(right, at[step:], at[:-step]), np.where(right, low[step:], low[:-step])
        span += step
    return at


def seed_paths(w: Words, k: int, seed: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """The paths of a batch: text, seed hash, the two halves of the path's digest, first window (counted in its
    text), windows. The digest is of the path's words and of the place of the seed among them."""
    none = (np.zeros(0, np.int64),) * 6
    if len(w.start) < k:
        return none
    hashes = run_digests(w.digests()[:, 0], seed, 0)
    low = least(hashes, k - seed + 1)
    window = np.flatnonzero(w.text[: len(w.text) - k + 1] == w.text[k - 1 :])
    if not len(window):
        return none
    low = low[window]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(window) != 1) | (np.diff(low) != 0)]))
    start, n, place = window[head], np.diff(np.concatenate([head, [len(window)]])), low[head]
    path = lanes(w.spans(start, start + n + k - 1, salt))
    first = mix(path[:, 0] + (place - start).astype(U))
    text = w.text[start]
    return text, hashes[place].view(np.int64), first.view(np.int64), path[:, 1].copy().view(np.int64), start - w.first[text], n


def paths(docs: DataFrame, k: int, seed: int, salt: int) -> DataFrame:
    """tid, seed, path, path2, after, start, n for every path of every text, and doc_id and tkey (a hash of the text) at
    each text's first. tid numbers texts; after is the path that follows, 0 at a text's end."""

    def run(batches):
        working("words", forget)
        tid = TaskContext.get().partitionId() << 33
        for batch in slices(batches, limit=WORDS_BYTES):
            text, s, p, q, start, n = seed_paths(Words(column(batch, "text")), k, seed, salt)
            after = np.zeros(len(text), np.int64)
            after[:-1] = np.where(text[1:] == text[:-1], p[1:], 0)
            take = pa.array(text, pa.int64(), mask=start > 0)
            cols = [column(batch, "doc_id").take(take), column(batch, "tkey").take(take), *(pa.array(x, pa.int64()) for x in (text + tid, s, p, q, after)), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tkey", "tid", "seed", "path", "path2", "after", "start", "n"])
            tid += batch.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, f"doc_id {kind}, tkey long, tid long, seed long, path long, path2 long, after long, start int, n int")


def path_windows(docs: DataFrame, asked: DataFrame, k: int, salt: int) -> DataFrame:
    """edge, j, and the digest (window, window2) of every window of the paths asked for (doc_id, tkey, asked list)."""

    def run(batches):
        working("words", forget)
        for batch in slices(batches, limit=WORDS_BYTES):
            w = Words(column(batch, "text"))
            want = column(batch, "asked")
            text = np.repeat(np.arange(len(want)), pc_lengths(want))
            flat = want.flatten()
            edge, start, n = (flat.field(i).to_numpy() for i in range(3))
            row = np.repeat(np.arange(len(text)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = (w.first[text] + start)[row] + j
            d = lanes(w.spans(at, at + k, salt)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edge[row]), pa.array(j, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["edge", "j", "window", "window2"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").alias("d").join(asked.alias("a"), F.expr("d.doc_id <=> a.doc_id and d.tkey = a.tkey"))
    return rows.select("d.text", "a.asked").mapInArrow(run, "edge long, j int, window long, window2 long")


def pc_lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def unitigs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """edge, unitig, off, total of every repeated path among `nodes` (edge, path, next, c, n): the first path of its
    chain, the windows before it there, and the windows of the whole chain.

    Two paths compact where the one is followed by the other alone (next), and they occur equally often, so that
    nothing else precedes that. Each join then doubles the reach of the pointers to what comes before.
    """
    after = nodes.where("next is not null and next != path").select(F.col("edge").alias("before"), F.col("next").alias("path"), F.col("n").alias("step"), F.col("c"))
    linked = nodes.select("edge", "path", "n", "c").join(after, ["path", "c"], "left")
    chain = scratch.save(linked.select("edge", "n", F.coalesce("before", "edge").alias("unitig"), F.coalesce("step", F.lit(0)).cast("long").alias("off"), F.col("before").isNull().alias("done")), "chain")
    for _ in range(DOUBLINGS):
        if chain.where("not done").isEmpty():
            break
        back = chain.select(F.col("edge").alias("unitig"), F.col("unitig").alias("u"), F.col("off").alias("o"), F.col("done").alias("d"))
        moved = chain.where("not done").join(back, "unitig").select("edge", "n", F.col("u").alias("unitig"), (F.col("off") + F.col("o")).alias("off"), F.col("d").alias("done"))
        chain = scratch.save(moved.union(chain.where("done")), "chain")
    else:
        raise RuntimeError("paths follow each other in a circle")
    total = chain.groupBy("unitig").agg(F.max(F.col("off") + F.col("n")).alias("total"))
    return chain.select("edge", "unitig", "off").join(total, "unitig")


def repeated_windows(docs: DataFrame, scratch: Scratch, k: int = K, seed: int = SEED, salt: int = 0) -> DataFrame:
    """doc_id, tkey, marks: for each text with repeats, an array of what repeats there. A mark says that the windows
    from `at` on do, `n` of them as unitig says, or, where unitig is null, those of the 32 from `at` whose bit is set."""
    seed = max(min(seed, k), k - 31)  # a path has at most k - seed + 1 windows, a mark's bits 32
    every = scratch.save(paths(docs, k, seed, salt), "paths")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("path", "path2") for f in (F.min, F.max)]
    seeds = every.groupBy("seed").agg(F.count("*").alias("c"), *ends).where("c > 1")
    # written first, so that the join deals both sides anew and can split a seed that a third of all paths have
    seeds = scratch.save(seeds.select("seed", F.expr("min_path != max_path or min_path2 != max_path2").alias("branches")), "seeds")
    texts = scratch.save(every.where("start = 0").select("tid", "doc_id", "tkey"), "texts")
    met = scratch.save(every.join(seeds, "seed").select("tid", "seed", "path", "path2", "after", "start", "n", "branches"), "met")
    scratch.forget("paths", "seeds")

    same = ["seed", "path", "path2"]
    follow = [F.min("after").alias("next"), F.max("after").alias("other")]
    edges = met.groupBy(*same).agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("n", "branches", "tid", "start")], *follow)
    edges = edges.withColumn("next", F.expr("if(next = other and next != 0, next, null)")).drop("other")
    edges = scratch.save(edges.withColumn("edge", F.monotonically_increasing_id()), "edges")  # unique as written

    # what occurs once may still hold windows that other paths under its seed hold
    sources = edges.where("branches").select("tid", F.struct("edge", "start", "n").alias("a")).groupBy("tid").agg(F.collect_list("a").alias("asked"))
    asked = sources.join(texts, "tid").groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("asked")).alias("asked"))
    windows = scratch.save(path_windows(docs, asked, k, salt), "windows")
    twice = windows.groupBy("window", "window2").agg(F.min("edge").alias("lo"), F.max("edge").alias("hi")).where("lo != hi").select("window", "window2")
    twice = scratch.save(twice, "twice")
    bits = windows.join(twice, ["window", "window2"]).groupBy("edge").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits"))
    bits = scratch.save(bits, "bits")
    scratch.forget("windows", "twice")

    chains = unitigs(edges.where("c > 1").select("edge", "path", "next", "c", "n"), scratch)
    known = edges.join(chains, "edge", "left").join(bits, "edge", "left").where("c > 1 or bits is not null")
    known = scratch.save(known.select(*same, "unitig", "off", "total", F.when(F.col("c") == 1, F.col("bits")).alias("bits")), "known")
    scratch.forget("chain", "edges", "bits")
    at = F.when(F.col("unitig").isNull(), F.col("start")).otherwise(F.col("start") - F.col("off")).cast("int").alias("at")
    mark = F.struct(at, F.col("total").cast("int").alias("n"), "unitig", "bits")
    marked = met.join(known, same).select("tid", mark.alias("mark")).groupBy("tid").agg(F.collect_set("mark").alias("marks"))
    marked = marked.join(texts, "tid").groupBy("doc_id", "tkey").agg(F.first("marks").alias("marks"))  # wholly equal rows have equal marks
    marked = scratch.save(marked, "marks")
    scratch.forget("met", "known", "texts")
    return marked


def remove_repeats(docs: DataFrame, scratch: Scratch, k: int = K, seed: int = SEED) -> DataFrame:
    """`docs` with n_words, n_removed, and kept_text: the words left, joined by one blank.

    A word goes if a window of k words covers it whose sequence also starts anywhere else, in its own text or
    another. Every row is a document: wholly equal rows repeat each other. A null text has no words and
    an empty kept_text; null ids are matched as equal; texts shorter than k words stay whole; extra columns
    are carried, but for ones named as the three new ones, which give way; an empty table gives no rows.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    names = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)])
    for salt in range(SALTS):
        done = scratch.save(_removed(plain, repeated_windows(plain.select("doc_id", "text"), scratch, k, seed, salt), k), "removed")
        scratch.forget("marks")
        held = done.select(F.explode("spans").alias("s")).groupBy("s.unitig").agg(*[f(f"s.{c}").alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)])
        if held.where("min_d1 != max_d1 or min_d2 != max_d2").isEmpty():
            return done.drop("spans").toDF(*names, "n_words", "n_removed", "kept_text")
        scratch.forget("removed")
    raise RuntimeError(f"different words had one digest under {SALTS} salts")


def _removed(plain: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """`plain` with n_words, n_removed, kept_text, and spans: each unitig that marked words, with a digest of those."""
    rows = plain.withColumn("tkey", F.xxhash64("text")).alias("d").join(marks.alias("m"), F.expr("d.doc_id <=> m.doc_id and d.tkey = m.tkey"), "left")
    rows = rows.select(*[f"d.{c}" for c in plain.columns], "m.marks")
    carried = plain.columns

    def run(batches):
        working("words", forget)
        bit = np.arange(32)
        for batch in slices(batches, limit=WORDS_BYTES):
            n_words, n_removed, kept, ends, names, digests = [], [], [], [0], [], []
            for text, marks in zip(column(batch, "text").to_pylist(), column(batch, "marks"), strict=True):
                words = (text or "").encode("utf-8").split()
                n_words.append(len(words))
                if marks.is_valid and len(marks.values):
                    at, n, unitig, bits = (marks.values.field(i) for i in range(4))
                    cover = np.zeros(len(words) + 1, np.int64)
                    whole = unitig.is_valid().to_numpy(zero_copy_only=False)
                    at = at.to_numpy()
                    first, last = at[whole], at[whole] + n.drop_null().to_numpy() + k - 1
                    names.append(unitig.drop_null().to_numpy())
                    digests += [hashlib.sha256(b" ".join(words[a:b])).digest()[:16] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    np.add.at(cover, first, 1)
                    np.add.at(cover, last, -1)
                    own = at[~whole]
                    on = ((bits.drop_null().to_numpy()[:, None] >> bit) & 1).astype(bool)
                    first = (own[:, None] + bit)[on]
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + k, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    n_removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
                ends.append(len(digests))
            d = lanes(digests).view(np.int64)
            held = [np.concatenate([*names, np.zeros(0, np.int64)]), d[:, 0].copy(), d[:, 1].copy()]
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in held], ["unitig", "d1", "d2"]))
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), spans]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in carried), *new], [*carried, "n_words", "n_removed", "kept_text", "spans"])

    new = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()), ("spans", SPANS)]
    schema = T.StructType([*plain.schema.fields, *[T.StructField(c, kind) for c, kind in new]])
    return rows.mapInArrow(run, schema)
