"""Document quality: rule measurements of whole texts, and cutoffs whose false rejections are bounded.

Labelled documents fall into two halves by a hash of their id. One half proposes, for each stratum (a language), a
ladder of cutoffs of all rules, each step rejecting all that the one before does. The other half, the holdout, is
asked step by step whether the rules together reject at most a fixed share of good documents: an exact binomial
bound, at a level divided by the strata that are tested. The first step that fails ends the ladder (a fixed
sequence needs no further correction), and the last that passed is used. Without a pass, no cutoff is.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import WORDS_BYTES, slices, working
from lodestone.llm.words import Words, coded, forget, run_codes

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct"]
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
PUNCT = np.zeros(256, bool)
PUNCT[[b for b in range(33, 127) if not chr(b).isalnum() and not SYMBOL[b]]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
WINDOW = 5

#: Rules: what is measured, and the cutoffs tried, most lenient first; a document above the cutoff is rejected.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [x / 20 for x in range(60, 0, -1)]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [x / 64 for x in range(64, 0, -1)]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [x / 64 for x in range(64, 0, -1)]),
    "word_length": ("word_chars / greatest(n_words, 1)", [x / 4 for x in range(76, 15, -1)]),
    "upper": ("n_upper / greatest(word_chars, 1)", [x / 64 for x in range(64, 0, -1)]),
    "punct": ("n_punct / greatest(word_chars, 1)", [x / 64 for x in range(64, 0, -1)]),
}
#: Share of a stratum's good documents (of those that pass the base rules) that all its rules together may reject,
#: and the chance of a breach in any stratum.
ALPHA, DELTA = 0.02, 0.05
#: Steps of a ladder: on the proposing half, a rule of step i rejects up to i / (STEPS - 1) of ALPHA.
STEPS = 8
#: What the share of good documents that a cutoff rejects weighs against the share of bad ones.
PRICE = 20


def _keys(text: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One code for each text and code of it."""
    top = int(code.max(initial=0)) + 1
    if top > (1 << 62) // (int(text.max(initial=0)) + 1):
        code = np.unique(code, return_inverse=True)[1]
        top = int(code.max(initial=0)) + 1
    return text * top + code


def repeated(text: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each item, whether its text holds the code twice or more."""
    key = _keys(text, code)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def distinct_per_text(text: np.ndarray, code: np.ndarray, n_texts: int) -> np.ndarray:
    return np.bincount(text[np.unique(_keys(text, code), return_index=True)[1]], minlength=n_texts)


def measure_texts(col: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text (null: no words)."""
    w = Words(col)
    per_text = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[np.concatenate([w.text_start, [len(w.bytes)]])])
    out = {"n_words": w.count, "word_chars": per_text(w.inside & ((w.bytes & 0xC0) != 0x80)), "n_symbols": per_text(SYMBOL[w.bytes]), "n_upper": per_text(UPPER[w.bytes]), "n_punct": per_text(PUNCT[w.bytes])}
    # lines: every text ends one more; its last byte is the separator that Words put there
    breaks = np.union1d(np.flatnonzero(w.bytes == 10), w.text_end - 1)
    start = np.concatenate([[0], breaks[:-1] + 1])
    filled = np.diff(np.searchsorted(w.start, np.concatenate([start, [len(w.bytes)]]))) > 0
    start, end = start[filled], breaks[filled]
    text = np.searchsorted(w.text_end, start, "right")
    n_lines = np.bincount(text, minlength=w.n_texts)
    out["n_lines"] = n_lines
    held = np.zeros(len(w.bytes) + 1, np.int64)
    held[start] += 1
    held[end] -= 1
    lines = coded(w.bytes, np.cumsum(held)[:-1] > 0, end - start)[0]  # lines and words are compared as they are, not by hash
    out["n_dup_lines"] = n_lines - distinct_per_text(text, lines, w.n_texts)
    # words in windows that the text holds twice
    cover = np.zeros(len(w.start) + 1, np.int64)
    if len(w.start) >= WINDOW:
        at = np.flatnonzero(w.text[: len(w.text) - WINDOW + 1] == w.text[WINDOW - 1 :])
        twice = at[repeated(w.text[at], run_codes(w.codes()[0], WINDOW)[at])]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
    out["n_repeat_words"] = w.sums(np.cumsum(cover)[:-1] > 0)
    return {k: v.astype(np.int64) for k, v in out.items()}


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry`, then MEASURES of the column text."""
    names = carry if "text" in carry else [*carry, "text"]

    def run(batches):
        working("words", forget)
        for batch in slices(batches, limit=WORDS_BYTES):
            m = measure_texts(batch.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in carry), *(pa.array(m[k]) for k in MEASURES)], [*carry, *MEASURES])

    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = kept.select(*[F.col(f"`{c}`") for c in carry]).schema
    for k in MEASURES:
        schema = schema.add(k, "long")
    return kept.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) at rate p: the exact test that the rate is p or more."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def ladder(good: list[int], bad: list[int], n_good: int, n_bad: int, alpha: float, steps: int = STEPS) -> list[int]:
    """The cutoff of one rule at each step (-1: none yet), never more lenient than the step before. good and bad count
    the documents of the proposing half that each cutoff rejects, most lenient first."""
    worth = [b / max(n_bad, 1) - PRICE * g / max(n_good, 1) for g, b in zip(good, bad, strict=True)]
    out, at = [], -1
    for i in range(steps):
        room = alpha * n_good * i / max(steps - 1, 1)
        best = max((j for j, g in enumerate(good) if g <= room), key=lambda j: worth[j], default=-1)
        if best > at and worth[best] > 0:
            at = best
        out.append(at)
    return out


def passed(rejected: list[int], n_good: int, alpha: float, level: float) -> int:
    """How many steps the holdout confirms, in order, until one fails: rejected counts its good documents by step."""
    for i, k in enumerate(rejected):
        if binomial_tail(k, n_good, alpha) > level:
            return i
    return len(rejected)


def in_holdout(doc_id: Column) -> Column:
    return F.crc32(F.concat(F.lit("holdout "), doc_id.cast("string")).cast("binary")) % 2 == 1


def learn_cutoffs(measured: DataFrame, labels: DataFrame, save, alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """Cutoffs of each stratum by rule (every labelled language is one, null lang another), from every labelled row of `measured` (doc_id, lang, MEASURES).

    `labels` has doc_id and quality (1 good, 0 bad; other values and nulls are left out; a doc_id labelled
    twice counts with its lower label). `save` writes the labelled rows' bins. Only counts by stratum, rule and
    cutoff, then by stratum and step, reach the driver.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.where(~base_failed()).join(marked, "doc_id").withColumn("holdout", in_holdout(F.col("doc_id")))
    step = [F.expr(f"cast({len(cuts)} - size(filter(array({','.join(f'{c}D' for c in cuts)}), c -> {value} > c)) as int)").alias(rule) for rule, (value, cuts) in RULES.items()]
    binned = save(rows.select("lang", "quality", "holdout", *step).groupBy("lang", "quality", "holdout", *RULES).count(), "bins")  # a map-side sum
    per = binned.where("not holdout").select("lang", "quality", "count", F.posexplode(F.array(*RULES)).alias("rule", "bin")).groupBy("lang", "quality", "rule", "bin").agg(F.sum("count").alias("n"))
    table: dict = defaultdict(lambda: defaultdict(int))
    for r in per.collect():  # strata x rules x cutoffs x 2 rows at most
        table[r["lang"], r["rule"]][r["quality"], r["bin"]] += r["n"]
    ladders: dict[str | None, dict[str, list[int]]] = defaultdict(dict)
    for (s, i), counts in table.items():
        rule, (_, cuts) = list(RULES.items())[i]
        above = [[sum(n for (q, b), n in counts.items() if q == quality and b <= j) for j in range(len(cuts))] for quality in (1, 0)]
        n_good, n_bad = (sum(n for (q, _), n in counts.items() if q == quality) for quality in (1, 0))
        ladders[s][rule] = ladder(above[0], above[1], n_good, n_bad, alpha)
    asked = {s: [{rule: steps[i] for rule, steps in by.items()} for i in range(STEPS)] for s, by in ladders.items() if any(x >= 0 for steps in by.values() for x in steps)}
    if not asked:
        return {}
    kind = f"array<struct<{', '.join(f'{rule}: int' for rule in RULES)}>>"
    climbs = measured.sparkSession.createDataFrame([(s, [tuple(x[rule] for rule in RULES) for x in steps]) for s, steps in asked.items()], f"stratum string, steps {kind}")
    falls = "array_position(transform(steps, x -> " + " or ".join(f"{rule} <= x.{rule}" for rule in RULES) + "), true)"  # from 1; 0: at no step
    held = binned.where("holdout and quality = 1").join(F.broadcast(climbs), F.expr("lang <=> stratum"))  # a row per labelled language
    found: dict = defaultdict(lambda: [0] * (STEPS + 1))
    for r in held.groupBy("stratum", F.expr(falls).cast("int").alias("falls")).agg(F.sum("count").alias("n")).collect():
        found[r["stratum"]][r["falls"]] += r["n"]
    out: dict[str | None, dict[str, float]] = {}
    for s, steps in asked.items():
        rejected = [sum(found[s][1 : i + 2]) for i in range(STEPS)]
        n = passed(rejected, sum(found[s]), alpha, delta / len(asked))
        out[s] = {rule: RULES[rule][1][j] for rule, j in (steps[n - 1].items() if n else ()) if j >= 0}
    return out


def judged(measured: DataFrame, cutoffs: dict[str | None, dict[str, float]]) -> DataFrame:
    """`measured` with kept: whether a row with lang and MEASURES passes the base rules and those of its stratum, if
    that has any."""
    rows = [(s, True, *(rules.get(r) for r in RULES)) for s, rules in cutoffs.items() if rules]
    table = measured.sparkSession.createDataFrame(rows, "__stratum string, __known boolean, " + ", ".join(f"__{r} double" for r in RULES))
    fails = F.expr(" or ".join(f"coalesce({value} > __{rule}, false)" for rule, (value, _) in RULES.items()))
    joined = measured.join(F.broadcast(table), F.expr("lang <=> __stratum"), "left")  # a row per language that has over 100 labels
    return joined.withColumn("kept", ~base_failed() & ~fails).drop(*table.columns)


def judge(docs: DataFrame, labels: DataFrame, save, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row.

    `save` writes the measurements, so texts are read once. A null text has no words and fails; a null lang
    is a stratum of its own; a null doc_id is judged but never labelled; repeated rows are judged
    alike; other columns are ignored; without enough labels in a stratum only the base rules apply there.
    """
    measured = save(measure(docs, ["doc_id", "lang"]), "measures")
    cutoffs = learn_cutoffs(measured, labels, save, alpha, delta)
    return judged(measured, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, save, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of `docs` that pass, with their columns. Texts are measured again in place of a join, so
    repeated rows and null ids come through as they are."""
    measured = save(measure(docs, ["doc_id", "lang"]), "measures")
    cutoffs = learn_cutoffs(measured, labels, save, alpha, delta)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" if c not in ("text", "lang") else c for i, c in enumerate(names)])
    return judged(measure(plain, plain.columns), cutoffs).where("kept").select(*plain.columns).toDF(*names)
