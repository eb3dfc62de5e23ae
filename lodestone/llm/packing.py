"""Best-fit packing of documents into fixed-length sequences by linear grouping.

Only the histogram of lengths decides the plan, and it has at most `size` entries however many documents
there are; so the driver plans on counts, and the executors look each piece's place up by its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import SLICE_BYTES, column, slices, working
from lodestone.llm.tokenizing import forget, word_codec
from lodestone.plans.runtime import Scratch

#: (groups, large): how many groups the large lengths fall in, large being those over size / large. Rounding up
#: wastes at most a group's spread; which cut wastes least depends on the lengths, so each is planned, and the
#: plan with the fewest sequences is used.
CUTS = ((32, 2), (128, 3), (128, 4), (256, 3))


# --- the plan, on counts ------------------------------------------------------------------------------------


def _group(hist: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut (length, count), longest first, into runs of about equal total count; a length may fall in two."""
    total = sum(n for _, n in hist)
    share = -(-total // groups) if total else 1
    out: list[list[tuple[int, int]]] = [[]]
    room = share
    for length, n in hist:
        while n:
            k = min(n, room)
            out[-1].append((length, k))
            n, room = n - k, room - k
            if not room:
                out.append([])
                room = share
    return [g for g in out if g]


def _best_pattern(sizes: list[int], worth: np.ndarray, size: int) -> tuple[float, list[int]]:
    """The multiset of sizes within `size` of greatest worth (a bounded knapsack, a vector over capacities)."""
    best, took = np.zeros(size + 1), []
    for s, w in zip(sizes, worth, strict=True):
        count = np.zeros(size + 1, np.int32)
        if w > 0:
            base = best.copy()
            for c in range(1, size // s + 1):
                gain = np.concatenate([np.full(c * s, -1.0), base[: size + 1 - c * s] + c * w])
                better = gain > best + 1e-12
                best[better], count[better] = gain[better], c
        took.append(count)
    at, pattern = size, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        pattern[i] = int(took[i][at])
        at -= pattern[i] * sizes[i]
    return float(best[size]), pattern


def configurations(sizes: list[int], need: list[int], size: int) -> list[tuple[list[int], int]]:
    """Patterns of few sizes and how often to use each: column generation over the linear relaxation, floored. It ends
    where no pattern is worth more than a sequence, or a basis comes again (only without gain)."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag([float(size // s) for s in sizes])
    seen: set[tuple] = set()
    while (own := tuple(sorted(map(tuple, basis.T)))) not in seen:
        seen.add(own)
        worth = np.linalg.solve(basis.T, np.ones(m))
        gain, pattern = _best_pattern(sizes, worth, size)
        if gain <= 1 + 1e-9:
            break
        x, d = np.linalg.solve(basis, np.array(need, float)), np.linalg.solve(basis, np.array(pattern, float))
        ratio = [(max(x[i], 0) / d[i], i) for i in range(m) if d[i] > 1e-9]
        basis[:, min(ratio)[1]] = pattern
    x = np.linalg.solve(basis, np.array(need, float))
    return [([int(round(v)) for v in basis[:, i]], int(x[i] + 1e-6)) for i in range(m) if x[i] >= 1 - 1e-6]


class Plan:
    """Where the r-th piece of each length goes: rows (length, first rank, count, first sequence, pieces of the
    run in each sequence, first offset)."""

    def __init__(self, hist: dict[int, int], size: int, groups: int, large: int):
        self.size, self.used, self.sequences = size, defaultdict(int), 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> runs (first sequence, count)
        self.left: list[int] = []  # the spaces in `room`, ascending
        big = [(n, hist[n]) for n in sorted(hist, reverse=True) if n * large > size]
        rest = {n: hist[n] for n in hist if n * large <= size}
        parts = _group(big, groups)
        for pattern, times in configurations([g[0][0] for g in parts], [sum(n for _, n in g) for g in parts], size):
            self._use(pattern, times, parts)
        for g in parts:  # what flooring the relaxation left over
            for length, n in g:
                rest[length] = rest.get(length, 0) + n
        for length in sorted(rest, reverse=True):
            self._best_fit(length, rest[length])

    def _place(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        self.rows.append((length, self.used[length], count, first, each, offset))
        self.used[length] += count

    def _open(self, space: int, first: int, count: int) -> None:
        if space and count:
            if space not in self.room or not self.room[space]:
                at = bisect_left(self.left, space)
                if at == len(self.left) or self.left[at] != space:
                    self.left.insert(at, space)
            self.room[space].append((first, count))

    def _use(self, pattern: list[int], times: int, parts: list[list[tuple[int, int]]]) -> None:
        """Substitute actual pieces for the rounded sizes of `times` sequences, in runs of equal lengths."""
        slots = [i for i, c in enumerate(pattern) for _ in range(c)]
        fill = []
        for i in slots:
            take, runs = times, []
            while take and parts[i]:
                length, n = parts[i][0]
                k = min(n, take)
                runs.append((length, k))
                take -= k
                if k == n:
                    parts[i].pop(0)
                else:
                    parts[i][0] = (length, n - k)
            fill.append(runs + [(0, take)] * bool(take))
        cuts = sorted({sum(k for _, k in runs[: j + 1]) for runs in fill for j in range(len(runs))} | {times})
        at, pos = 0, [[0, 0] for _ in fill]
        for cut in cuts:
            count, offset = cut - at, 0
            if not count:
                continue
            for runs, p in zip(fill, pos, strict=True):
                while p[1] == runs[p[0]][1]:
                    p[0], p[1] = p[0] + 1, 0
                length = runs[p[0]][0]
                p[1] += count
                if length:
                    self._place(length, count, self.sequences + at, 1, offset)
                    offset += length
            self._open(self.size - offset, self.sequences + at, count)
            at = cut
        self.sequences += times

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect_left(self.left, length)
            while at < len(self.left) and not self.room[self.left[at]]:
                self.left.pop(at)
            if at == len(self.left):
                each = self.size // length
                count = -(-n // each)
                self.left.insert(at, self.size)
                self.room[self.size] = [(self.sequences, count)]
                self.sequences += count
                continue
            space = self.left[at]
            first, count = self.room[space].pop()
            if not self.room[space]:
                self.left.pop(at)
            each = space // length
            whole = min(count, n // each)
            if whole:
                self._place(length, whole * each, first, each, self.size - space)
                self._open(space - each * length, first, whole)
                n -= whole * each
            if n and whole < count:  # fewer than a sequence takes
                k = min(n, each)
                self._place(length, k, first + whole, k, self.size - space)
                self._open(space - k * length, first + whole, 1)
                n -= k
                whole += 1
            self._open(space, first + whole, count - whole)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows by (length, first rank), and where each length's begin."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 6)
        return rows, np.searchsorted(rows[:, 0], np.arange(self.size + 2))


def best_plan(hist: dict[int, int], size: int, cuts: tuple[tuple[int, int], ...] = CUTS) -> Plan:
    """The plan with the fewest sequences over the cuts."""
    return min((Plan(dict(hist), size, *c) for c in cuts), key=lambda p: p.sequences)


# --- documents to pieces to places -------------------------------------------------------------------------


def cut_pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank (lrank) among those of its length in its
    task (pid)."""

    def run(batches):
        working("tokens", forget)
        codec, seen, pid = word_codec(path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, limit=2 * SLICE_BYTES):
            ids, at = codec.encode(column(batch, "text").fill_null(""))
            raw = ids.astype("<u4").tobytes()
            row, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                whole = raw[4 * a : 4 * b] + end
                for k, s in enumerate(range(0, b - a + 1, size)):
                    part = whole[4 * s : 4 * (s + size)]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            n = np.array(length, np.int64)
            order = np.argsort(n, kind="stable")
            run_at = np.searchsorted(n[order], n[order])
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - run_at + seen[n[order]]
            seen += np.bincount(n, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(rank), pa.array(np.full(len(n), pid, np.int64))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "lrank", "pid"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, lrank long, pid long")


def pack(docs: DataFrame, path: str, scratch: Scratch, size: int = 4096, end_id: int = 1, cuts: tuple[tuple[int, int], ...] = CUTS) -> DataFrame:
    """Pack every document into sequences of at most `size` tokens: one row per piece with its sequence and place.

    Ids come from the tokenizers file at `path`, then `end_id`; only documents longer than `size` are cut, the
    last piece being the shorter. Large lengths are rounded up within groups of equal cardinality
    (`cuts`), column generation finds configurations of the few sizes, actual pieces take the rounded
    ones' slots, and the rest goes where it fits best. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset; offsets within a sequence are gapless from 0.

    A null or empty text is the single `end_id`; a null doc_id is carried along; repeated rows are packed each;
    other columns are ignored; an empty table gives no rows.
    """
    pieces = scratch.save(cut_pieces(docs, path, size, end_id), "pieces")
    per_task = scratch.save(pieces.groupBy("length", "pid").agg(F.count("*").alias("n")), "lengths")
    hist = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    rows, begin = best_plan(hist, size, cuts).table()
    plan = docs.sparkSession.sparkContext.broadcast((rows, begin))  # bounded by size and cuts, not by documents
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        rows, begin = plan.value
        key = rows[:, 0] * (1 << 40) + rows[:, 1]
        for b in batches:
            length = column(b, "length").to_numpy()
            rank = column(b, "rank").to_numpy()
            r = rows[np.searchsorted(key, length * (1 << 40) + rank, "right") - 1]
            k = rank - r[:, 1]
            out = [pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *out], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # dealt by key at every size: the table of bases has a row per task and length, so it grows with the documents
    ranked = pieces.join(base.hint("merge"), ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("lrank")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
