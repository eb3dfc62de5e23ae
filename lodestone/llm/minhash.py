"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, components.

SuperMinHash gives element e a random permutation of the m places and adds a fresh fraction to each rank; place
p keeps the least rank + fraction that any element puts there. Ranks of one element are thereby correlated over
places, which lowers the variance of the estimate, and ranks above the greatest value kept can be skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import WORDS_BYTES, column, slices, working
from lodestone.llm.components import UnionFind, connected
from lodestone.llm.words import U, Words, digest, forget, lanes, mix, run_codes, run_digests, word_digests
from lodestone.plans.runtime import Scratch

#: Bands x rows: at similarity 0.8 a pair misses every band with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: Agreeing bits of 240 below which a pair is not verified: at 0.8, 216 are expected with deviation 4.6, so
#: a link is lost with probability under 1e-6.
AGREE = 193
#: Turns in which each node is tried against one hub; what they leave apart is tried in full.
STARS = 2
#: Members of a bucket that one block holds of each of its two chunks.
CHUNK = 512
_BLOCK = 1 << 14
_GOLD = U(0x9E3779B97F4A7C15)


class Shingles:
    """The distinct shingles of lower-cased (A-Z) texts, by text: text number (`text`), a code that two shingles of
    the batch share if and only if their words are equal (`code`), and how many each text has (`count`).

    A text of fewer than `width` words is one shingle, its whole sequence; one of none has none.
    """

    def __init__(self, col: pa.Array, width: int):
        w = Words(col, lower=True)
        self.words, self.distinct = w.codes()
        n = np.minimum(w.count, width)
        starts = np.maximum(w.count - width + 1, (w.count > 0).astype(np.int64))
        text = np.repeat(np.arange(w.n_texts), starts)
        at = w.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts)
        size = n[text]
        code, base = np.zeros(len(at), np.int64), 0
        for x in np.unique(size).tolist():
            own = np.flatnonzero(size == x)
            runs = run_codes(self.words, x)[at[own]]
            if int(runs.max(initial=0)) * w.n_texts > 1 << 61:
                runs = np.unique(runs, return_inverse=True)[1]
            code[own] = runs + base
            base += int(runs.max(initial=0)) + 1
        if base * max(1, w.n_texts) > 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            base = int(code.max(initial=0)) + 1
        fresh = np.unique(text * base + code, return_index=True)[1]
        self.at, self.size = at[fresh], size[fresh]
        self.text, self.code = text[fresh], code[fresh]
        self.count = np.bincount(self.text, minlength=w.n_texts)

    def digests(self) -> np.ndarray:
        """(shingles, 2) lanes, the same in every batch."""
        words = word_digests(self.distinct)[self.words]
        out = np.zeros((len(self.at), 2), U)
        for x in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == x)
            for lane in (0, 1):
                out[own, lane] = run_digests(words[:, lane], x, lane)[self.at[own]] + U(x)
        return out


def _rounds(value: np.ndarray, doc: np.ndarray, sig: np.ndarray) -> None:
    """Take elements into the signatures (documents, m), a rank at a time, until no rank left can matter."""
    m = sig.shape[1]
    flat = sig.reshape(-1)
    perm = None
    row = np.arange(len(value))
    for j in range(m):
        r = mix(value + U((j + 1) * int(_GOLD) % (1 << 64)))
        k = j + (((r & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
        if perm is None:
            place = k
        else:
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(flat, doc * m + place, (U(j) << U(32)) | (r >> U(32)))
        open_docs = sig.max(1) >= (U(j + 1) << U(32))
        left = open_docs[doc]
        if not left.any() or j + 1 == m:
            return
        if perm is None:
            value, doc, k = value[left], doc[left], k[left]
            row = np.arange(len(value))
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(value), 1))
            perm[row, k] = 0
        elif not left.all():
            value, doc, row = value[left], doc[left], row[left]


def superminhash(value: np.ndarray, count: np.ndarray, m: int) -> np.ndarray:
    """Signatures of sets that stand one after another in `value`; an empty set keeps the greatest value."""
    sig = np.full((len(count), m), np.iinfo(np.uint64).max, np.uint64)
    first = np.cumsum(count) - count
    order = np.argsort(count, kind="stable")
    order = order[count[order] > 0]
    ends = np.cumsum(count[order])
    at = 0
    while at < len(order):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BLOCK, "right")))
        part = order[at:upto]
        own = sig[part]
        n = count[part]
        doc = np.repeat(np.arange(len(part)), n)
        index = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(len(doc))
        for a in range(0, len(index), _BLOCK):
            _rounds(value[index[a : a + _BLOCK]], doc[a : a + _BLOCK], own)
        sig[part] = own
        at = upto
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    part = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(U) * _GOLD), part.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * U(0x2545F4914F6CDD1D) + part[:, :, i])
    return key


def sketch(sig: np.ndarray) -> np.ndarray:
    """A bit of each value, as (sets, 4) longs."""
    bits = np.zeros((len(sig), 256), np.uint8)
    bits[:, : min(256, sig.shape[1])] = (mix(sig) & U(1))[:, :256]
    return np.packbits(bits, axis=1).view(np.int64)


def features(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tkey, n_shingles, fp1, fp2 (a fingerprint of the set), keys (of bands) and bits for each row."""

    def run(batches):
        working("words", forget)
        for batch in slices(batches, limit=WORDS_BYTES):
            sets = Shingles(column(batch, "text"), width)
            count, both = sets.count, sets.digests()
            sig = superminhash(both[:, 0].copy(), count, bands * rows)
            keys = band_keys(sig, bands, rows).view(np.int64)
            # a set's fingerprint: BLAKE2b over its shingles' digests in order
            both = both[np.lexsort((both[:, 1], both[:, 0], sets.text))]
            view, cut = memoryview(both.tobytes()), (16 * np.concatenate([[0], np.cumsum(count)])).tolist()
            prints = lanes([digest(view[a:b]) for a, b in zip(cut, cut[1:], strict=False)]).view(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "tkey"), pa.array(count.astype(np.int64)), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), lists(keys), lists(sketch(sig))], ["doc_id", "tkey", "n_shingles", "fp1", "fp2", "keys", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, f"doc_id {kind}, tkey long, n_shingles long, fp1 long, fp2 long, keys array<long>, bits array<long>")


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet 100 * intersection >= percent * union."""

    def run(batches):
        working("words", forget)
        for batch in slices(batches, "text_a", 1 << 19):
            n = batch.num_rows
            sets = Shingles(pa.concat_arrays([column(batch, "text_a"), column(batch, "text_b")]), width)  # codes of both sides agree
            n1, n2 = sets.count[:n], sets.count[n:]
            pair = np.sort((sets.text % n) * (int(sets.code.max(initial=0)) + 1) + sets.code)
            met = pair[1:][pair[1:] == pair[:-1]]
            both = np.bincount(met // (int(sets.code.max(initial=0)) + 1), minlength=n)
            ok = pa.array(np.flatnonzero(100 * both >= percent * (n1 + n2 - both)))
            yield pa.RecordBatch.from_arrays([column(batch, "a").take(ok), column(batch, "b").take(ok)], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("kid", F.coalesce(F.col("doc_id"), F.lit(0).cast(docs.schema["doc_id"].dataType))).withColumn("knull", F.col("doc_id").isNull()).withColumn("tkey", F.xxhash64("text"))


def group(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, tkey, n_shingles, comp, component_id for each row; comp and component_id are null for empty sets.

    Equal sets form one class first. In a few turns each class is tried against one hub of its buckets; at last
    every pair of a bucket that is still in different components is tried, each time on full sets. Pairs inside
    one component are never formed.
    """
    feats = scratch.save(features(docs, width, bands, rows), "features")
    firsts = [F.first(c).alias(c) for c in ("tkey", "keys", "bits")]
    classes = feats.where("n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("least_id"), F.first("doc_id").alias("doc_id"), *firsts)
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # unique as written

    banded = classes.select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = scratch.save(banded.join(buckets, "key"), "members")
    nodes = members.select("node").distinct()
    source = classes.join(nodes, "node").select("node", F.coalesce(F.col("doc_id"), F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("kid"), F.col("doc_id").isNull().alias("knull"), "tkey")
    texts = _keyed(docs.select("doc_id", "text")).join(source, ["kid", "knull", "tkey"]).groupBy("kid", "knull", "tkey").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    texts = scratch.save(texts.select("node", "text"), "texts")

    facts = scratch.save(classes.select("node", "n_shingles", *[F.col("bits")[i].alias(f"b{i}") for i in range(4)]).join(nodes, "node", "left_semi"), "facts")
    links, comps = None, classes.select("node", F.col("node").alias("comp")).limit(0)
    for turn in range(STARS):
        asked = scratch.save(_stars(members, facts, comps, percent, turn), "asked")
        if asked.isEmpty():
            break
        found = scratch.save(verify(asked, texts, width, percent), "links")
        links = found if links is None else links.union(found)
        comps = connected(links, scratch)
    rest = scratch.save(_rest(members, facts, comps, texts, width, percent, scratch), "rest")
    if not rest.isEmpty():
        comps = connected(rest if links is None else links.union(rest), scratch)

    placed = classes.join(comps, "node", "left").select("fp1", "fp2", "n_shingles", "least_id", F.coalesce("comp", "node").alias("comp"))
    ids = placed.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    placed = scratch.save(placed.join(ids, "comp").select("fp1", "fp2", "n_shingles", "comp", "component_id"), "placed")
    return feats.select("doc_id", "tkey", "n_shingles", "fp1", "fp2").join(placed, ["fp1", "fp2", "n_shingles"], "left").select("doc_id", "tkey", "n_shingles", "comp", "component_id")


def _agree() -> Column:
    """Bits of the sketches of x and y that agree, the unused ones included."""
    return F.lit(256) - sum(F.bit_count(F.col(f"b{i}_x").bitwiseXOR(F.col(f"b{i}_y"))) for i in range(4))


def _likely(percent: int) -> Column:
    """What sizes and sketches do not rule out."""
    near = 100 * F.least("n_shingles_x", "n_shingles_y") >= percent * F.greatest("n_shingles_x", "n_shingles_y")
    return near & (_agree() >= 256 - 240 + AGREE)


def _named(facts: DataFrame, side: str) -> DataFrame:
    return facts.select(*[F.col(c).alias(f"{c}_{side}") for c in facts.columns])


def _stars(members: DataFrame, facts: DataFrame, comps: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs a, b to try next: each node with the hub, of all its buckets, that its sketch is nearest to and that is
    in another component. A bucket's hub is the member that meets most others over all its buckets (an original
    meets its copies more often than they meet each other), in later turns any."""
    of = members.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    size = of.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key", "size")
    mixed = of.join(size, "key")
    if turn % 2 == 0:
        mixed = mixed.join(mixed.groupBy("node").agg(F.sum("size").alias("worth")), "node")
    else:
        mixed = mixed.withColumn("worth", F.xxhash64(F.lit(turn), "key", "node"))
    hubs = mixed.groupBy("key").agg(F.max_by("node", "worth").alias("hub")).join(mixed.select("key", F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), ["key", "hub"])
    pairs = mixed.join(hubs, "key").where("comp != hub_comp").groupBy(F.col("node").alias("node_x"), F.col("hub").alias("node_y")).agg(F.count("*").alias("met"))
    near = pairs.join(_named(facts, "x"), "node_x").join(_named(facts, "y"), "node_y").where(_likely(percent))
    best = near.groupBy("node_x").agg(F.max_by("node_y", _agree()).alias("hub"))
    return best.select(F.greatest("node_x", "hub").alias("a"), F.least("node_x", "hub").alias("b")).distinct()


def _complete(batches):
    """Tables of whole groups (runs of equal key, i, j) from batches sorted so, with the groups' bounds."""
    held = None

    def bounds(t: pa.Table) -> np.ndarray:
        cols = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        return np.concatenate([[0], np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1, [t.num_rows]])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        cut = bounds(t)
        held = t.slice(cut[-2])
        if len(cut) > 2:
            yield t.slice(0, cut[-2]), cut[:-1]
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _block_links(col: pa.Array, comp: np.ndarray, node: np.ndarray, width: int, percent: int) -> list[tuple[int, int]]:
    """Linked pairs of a block, as many as join what they join: intersections by products of incidence matrices."""
    sets = Shingles(col, width)
    text, count = sets.text, sets.count
    code = np.unique(sets.code, return_inverse=True)[1]
    shared = np.bincount(code) > 1
    keep = shared[code]
    text, code = text[keep], np.cumsum(shared)[code[keep]] - 1
    order = np.argsort(code, kind="stable")
    text, code = text[order], code[order]
    both = np.zeros((len(count), len(count)), np.float32)
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        lo, hi = np.searchsorted(code, [a, a + 4096])
        m = np.zeros((len(count), 4096), np.float32)
        m[text[lo:hi], code[lo:hi] - a] = 1
        both += m @ m.T
    out = []
    groups = UnionFind(comp)
    for x in range(len(count)):
        size = both[x].astype(np.int64)
        ok = np.flatnonzero((100 * size >= percent * (count[x] + count - size)) & (count > 0))
        out += [(max(node[x], node[y]), min(node[x], node[y])) for y in ok.tolist() if groups.join(comp[x], comp[y])]
    return out


def _rest(members: DataFrame, facts: DataFrame, comps: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links a, b between members of one bucket that are still in different components: every pair that sizes and
    sketches do not rule out is tried on full sets, block against block, and only what joins components comes out.

    A bucket of more than CHUNK members is dealt over blocks by hash; first sketches alone say which members have
    any likely partner, and only their texts are read.
    """
    of = members.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = of.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    # block (i, j), i <= j, holds chunks i and j
    dealt = of.join(mixed, "key").withColumn("own", own).withColumn("other", F.explode(every)).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp")
    grouped = dealt.join(facts, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def likely(batches):
        for t, cut in _complete(batches):
            comp, n = t.column("comp").to_numpy(), t.column("n_shingles").to_numpy()
            bits = np.stack([t.column(f"b{i}").to_numpy() for i in range(4)], 1).view(np.uint64)
            some = np.zeros(t.num_rows, bool)
            for lo, hi in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                for a in range(lo, hi, 256):
                    x = slice(a, min(a + 256, hi))
                    agree = 256 - np.bitwise_count(bits[x, None, :] ^ bits[None, lo:hi, :]).sum(2, dtype=np.int64)
                    ok = (agree >= 256 - 240 + AGREE) & (comp[x, None] != comp[None, lo:hi])
                    ok &= 100 * np.minimum(n[x, None], n[None, lo:hi]) >= percent * np.maximum(n[x, None], n[None, lo:hi])
                    some[x] |= ok.any(1)
            yield from t.filter(pa.array(some)).select(["key", "i", "j", "node", "comp"]).to_batches()

    left = scratch.save(grouped.mapInArrow(likely, "key long, i int, j int, node long, comp long"), "likely")

    def links(batches):
        working("words", forget)
        for t, cut in _complete(batches):
            comp, node, text = t.column("comp").to_numpy(), t.column("node").to_numpy(), t.column("text").combine_chunks()
            out = [p for lo, hi in zip(cut.tolist(), cut[1:].tolist(), strict=False) for p in _block_links(text.slice(lo, hi - lo), comp[lo:hi], node[lo:hi], width, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return left.join(texts, "node").select("key", "i", "j", "node", "comp", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Two texts are linked if 100 * intersection >= percent * union of their distinct `width`-word shingles
    (A-Z lower-cased). component_id is the smallest doc_id reachable over links, kept whether the row has it.
    A text without words links with nothing and is its own component; a null doc_id links as any other but is
    never the smallest (its component_id is null if all reachable ids are); rows that share a doc_id are
    judged by their own texts; extra columns are ignored; an empty table gives no rows.
    """
    found = group(docs.select("doc_id", "text"), scratch, width, percent)
    cid = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row of smallest doc_id (of several, that
    of the smallest text hash; of wholly equal rows, one). Texts without words all stay."""
    found = group(docs.select("doc_id", "text"), scratch, width, percent).where("comp is not null")
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("knull"), F.coalesce(F.col("doc_id"), F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("kid"), "tkey")).alias("k")).select("k.*")
    first = scratch.save(first, "first")
    names = docs.columns
    plain = _keyed(docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)]))
    filled = F.col("text").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    own = [c for c in plain.columns if c not in ("kid", "knull", "tkey")]
    one = plain.where(filled).join(first, ["kid", "knull", "tkey"]).groupBy("kid", "knull", "tkey").agg(*[F.first(c).alias(c) for c in own]).select(*own)
    return one.union(plain.where(~F.coalesce(filled, F.lit(False))).select(*own)).toDF(*names)
