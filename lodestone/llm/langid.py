"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths slide over the bytes, each keeps its greatest response within a fixed-length window, and a
softmax layer reads those. A text's prediction weighs the probabilities of all its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import column, slices

WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bytes of a window; a window also sees the next bytes up to the widest filter.
WINDOW = 256
#: Most labelled documents per language that training reads, and of all languages, each keeping one at least.
TRAIN_PER_LANG, TRAIN_ROWS = 1000, 64_000
#: Windows that training gets of each such document, spread evenly over its whole text.
DRAWS = 8
#: Share of training windows whose a to z are raised, so that text in capitals is known too.
RAISED = 0.1
#: Steps for up to STEP_LANGS languages, and more in proportion.
STEPS, BATCH, STEP_LANGS = 1500, 64, 64
UNKNOWN = "und"


N_BYTES = 256
RAISE = np.arange(256, dtype=np.uint8)
RAISE[97:123] -= 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
REACH = max(WIDTHS) - 1


def windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all windows of texts that stand at data[start:end]: (windows, window + reach), each
    window's text, and its own bytes. Past a text's end there is 0."""
    count = -(-(end - start) // window)
    text = np.repeat(np.arange(len(start)), count)
    first = start[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * window
    at = first[:, None] + np.arange(window + REACH)
    inside = at < end[text][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8), text, np.minimum(end[text] - first, window)


@dataclass
class ByteCnn:
    """taps[w][i] is (256, filters): what byte i under a filter of width w adds."""

    langs: list[str]
    taps: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def new(cls, langs: list[str], rng: np.random.Generator) -> ByteCnn:
        k = FILTERS * len(WIDTHS)
        taps = [rng.normal(0, 0.3, (w, N_BYTES, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(langs, taps, np.zeros(k, np.float32), rng.normal(0, 0.1, (k, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        n = x.shape[1] - REACH
        out = []
        for t in self.taps:
            r = t[0].take(x[:, :n], axis=0)
            for i in range(1, len(t)):
                r += t[i].take(x[:, i : i + n], axis=0)
            out.append(r)
        return out

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def pooled(self, x: np.ndarray, block: int = 48) -> np.ndarray:
        """Greatest response of each filter in each window, a block of windows at a time."""
        out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for a in range(0, len(x), block):
            out[a : a + block] = np.concatenate([r.max(1) for r in self.responses(x[a : a + block])], 1)
        return out

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and probability of each whole text."""
        lettered = pc.match_substring_regex(col, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
        col = col.fill_null("")
        size = pc.binary_length(col).to_numpy().astype(np.int64)
        data = np.frombuffer("".join(col.to_pylist()).encode("utf-8"), np.uint8)
        end = np.cumsum(size)
        x, text, weight = windows(data, end - size, end)
        p = np.zeros((len(col), max(1, len(self.langs))))
        if len(x) and self.langs:
            np.add.at(p, text, self.softmax(self.pooled(x)) * weight[:, None])
        p /= np.maximum(size, 1)[:, None]
        best = p.argmax(1)
        known = lettered & bool(self.langs)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)


def train(texts: list[str] | list[bytes], langs: list[str], seed: int = 7, steps: int = STEPS) -> ByteCnn:
    """Fit by Adam on random windows of 8 to WINDOW bytes, languages drawn evenly. Deterministic."""
    raw = [t.encode("utf-8") if isinstance(t, str) else t for t in texts]
    rows = [(t, g) for t, g in zip(raw, langs, strict=True) if t.strip()]
    names = sorted({g for _, g in rows} or set(langs))
    rng = np.random.default_rng(seed)
    model = ByteCnn.new(names, rng)
    of: dict[str, list[np.ndarray]] = {g: [] for g in names}
    for t, g in rows:
        of[g].append(np.frombuffer(t, np.uint8))
    by = list(of.values())
    if len(names) < 2:
        return model
    params = [*model.taps, model.bias, model.dense, model.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), BATCH)
        picked = []
        for k in y:
            d = by[k][rng.integers(len(by[k]))]
            n = int(rng.integers(8, WINDOW + 1))
            a = int(rng.integers(0, max(1, len(d) - n + 1)))
            picked.append(RAISE[d[a : a + n]] if rng.random() < RAISED else d[a : a + n])
        end = np.cumsum([len(d) for d in picked])
        x, _, _ = windows(np.concatenate(picked), end - [len(d) for d in picked], end)
        best, pooled = [], []
        for r in model.responses(x):
            at = r.argmax(1)
            best.append(at)
            pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
        pooled = np.concatenate(pooled, 1)
        h = np.maximum(pooled + model.bias, 0)
        p = model.softmax(pooled)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        back = (p @ model.dense.T) * (h > 0)
        grads = []
        for k, t in enumerate(model.taps):
            g = np.zeros_like(t)
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for i in range(len(t)):
                np.add.at(g[i], (np.take_along_axis(x, best[k] + i, 1), np.arange(FILTERS)[None, :]), part)
            grads.append(g)
        grads += [back.sum(0), h.T @ p, p.sum(0)]
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p_, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p_ -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread(data: bytes, seed: int, draws: int = DRAWS, window: int = WINDOW) -> list[bytes]:
    """Windows of a text (the whole, if it is no longer than one): one at a random place of each of `draws` equal parts,
    fewer where parts would be shorter than a window. Those with letters, if any has."""
    n = max(1, min(draws, len(data) // window))
    rng = np.random.default_rng(seed & (1 << 63) - 1)
    cuts = [len(data) * i // n for i in range(n + 1)]
    out = [data[a : a + window] for a in (int(rng.integers(lo, max(lo, hi - window) + 1)) for lo, hi in zip(cuts, cuts[1:], strict=False))]
    lettered = [x for x in out if LETTER[np.frombuffer(x, np.uint8)].any()]
    return lettered or out


def sample(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, most: int = TRAIN_ROWS) -> list[tuple[list[bytes], str]]:
    """(windows of a text, lang) of `per_lang` documents at most of every language (fewer where so many languages would
    make more than `most`, but one at least), by a hash of text and id, so that copies come in by their share; only
    texts with letters, each read as a whole. Two scans, no shuffle but of about twice those windows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text", "doc_id").alias("draw"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()  # a row per language
    if not counts:
        return []
    per = max(1, min(per_lang, most // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], (2 * per + 20) / r["n"], r["least"]) for r in counts], "lang string, share double, least long")
    drawn = rows.join(F.broadcast(shares), "lang").where((F.pmod("draw", F.lit(1_000_000)) / 1e6 < F.col("share")) | (F.col("draw") == F.col("least")))

    def cut(batches):
        for batch in slices(batches):
            out = [spread(t.encode("utf-8"), d) for t, d in zip(column(batch, "text").to_pylist(), column(batch, "draw").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), column(batch, "draw"), pa.array(out, pa.list_(pa.binary()))], ["lang", "draw", "windows"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))  # about 2 * per rows each
    found = drawn.select("lang", "text", "draw").mapInArrow(cut, "lang string, draw long, windows array<binary>").withColumn("place", place).where(F.col("place") <= per).collect()
    return sorted(([bytes(x) for x in r["windows"]], r["lang"]) for r in found)


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, by a network trained on a bounded sample of the rows that
    are not held out, with every language that is labelled there.

    A null text, or one without letters, is `und` with score 0, as is every text where no language is labelled;
    empty texts likewise. Null ids and repeated rows are predicted as any other; other columns are ignored.
    """
    drawn = sample(docs, per_lang)
    steps = STEPS * max(1, -(-len({g for _, g in drawn}) // STEP_LANGS))
    windows_of = [(w, g) for ws, g in drawn for w in ws]
    model = docs.sparkSession.sparkContext.broadcast(train([w for w, _ in windows_of], [g for _, g in windows_of], steps=steps))  # grows with the languages only

    def run(batches):
        net = model.value
        for batch in slices(batches):
            lang, score = net.predict(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
