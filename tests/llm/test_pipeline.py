"""The pipeline against plain-Python stages, and the queries' registration."""

import os
import re
import subprocess
import sys
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
from test_pii_plain import plain
from test_substrings_minhash import groups, removed
from test_text_kernels import laid_out, measured
from tokenizers import Tokenizer

import __spark_entry__ as entry

from lodestone.llm.queries_pii import KEY
from lodestone.plans.runtime import shared_dir


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "substring dedup", "pii pseudonyms", "best-fit packing"]
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_equals_plain_stages(spark, docs, rows, tmp_path):
    """Labels are too few for any cutoff, so quality is the base rules."""
    extra = [(500, "Call +1 (551) 555-0826 about card 4111111111111111, one two three four five six.", "en")]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    done, seen = [], table
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{i}")
        stage(spark, seen, str(tmp_path)).write.parquet(path)
        seen = spark.read.parquet(path)
        done.append(seen)
        if i < 4:
            assert seen.columns == table.columns

    now = [(d, t) for d, t, *_ in [*rows, *extra] if measured(t)[0] >= 10 and 100 * measured(t)[4] <= 20 * measured(t)[0]]
    assert Counter((r["doc_id"], r["text"]) for r in done[0].collect()) == Counter(now)

    _, root = groups(now, 5)
    second = [(r["doc_id"], r["text"]) for r in done[1].collect()]
    place = {x: r for x, r in zip(now, root, strict=True)}
    assert Counter(place[x] for x in second) == Counter(set(root))
    least = {}
    for (d, _), r in zip(now, root, strict=True):
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    assert Counter((d is None, d or 0) for d, _ in second) == Counter(least.values())

    third = Counter()
    for (d, t), (_, n, kept) in zip(second, removed([t for _, t in second], 35), strict=True):
        third[d, kept if n else t] += 1
    got = done[2].collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == third
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in got)

    fourth = Counter((r["doc_id"], r["text"]) for r in done[3].collect())
    assert fourth == Counter((r["doc_id"], plain(r["text"], KEY)[0]) for r in got)
    assert not any("4111111111111111" in t or "555-0826" in t for _, t in fourth)

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for (d, text), n in fourth.items():
        want[d] += n * -(-(len(t.encode(text, add_special_tokens=False).ids) + 1) // 4096)
    packed = done[4].collect()
    assert Counter(r["doc_id"] for r in packed) == want
    laid_out(packed, 4096)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in cols) for r in whole) == Counter(tuple(r[c] for c in cols) for r in packed)


def test_pipeline_over_no_documents(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_chain_unwritten_and_leave_nothing_behind(spark, docs, tmp_path):
    """Stages composed without writing keep their tables; run() leaves its result alone; a key changes pseudonyms."""
    extra = spark.createDataFrame([(500, "Call +1 (551) 555-0826 about card 4111111111111111, one two three four five six.", "en")], "doc_id long, text string, lang string")
    docs.where("doc_id < 200").unionByName(extra, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = corpus_pipeline.quality_rules(spark, table, str(tmp_path))
    once = corpus_pipeline.minhash_near_dedup(spark, good, str(tmp_path))
    twice = corpus_pipeline.substring_dedup(spark, once, str(tmp_path))
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    ends = [corpus_pipeline.run(spark, str(tmp_path), key=k) for k in ("a", "b")]
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert len(left) == 2
    assert twice.count() == once.count()
    assert {r["doc_id"] for r in twice.collect()} == {r["doc_id"] for r in ends[0].collect()}
    crc = [{(r["doc_id"], r["ids_crc32"]) for r in e.collect()} for e in ends]
    assert {i for i, _ in crc[0] ^ crc[1]} == {500}


def test_entry_survives_what_is_missing():
    """Without a library that the subpackage needs, or without the pipeline's script, the rest is registered."""
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules[{!r}] = None; import __spark_entry__ as e; print(len([n for n in e.queries() if n.startswith('op')]), 'knn_single_l2' in e.queries(), 'pipeline' in e.queries())"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(name)], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__), timeout=100).stdout.split()
    assert run("tokenizers.nothing") == ["10", "True", "True"]
    assert run("public_tokenizers") == ["0", "True", "False"]
    assert run("corpus_pipeline") == ["10", "True", "False"]
