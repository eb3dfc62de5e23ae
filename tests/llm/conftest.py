"""Documents that hold every awkward case, for the operators' tests."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, node long, key string, comp long, found string, kept boolean, path string"


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text, lang): nulls, empties, long texts, ties, repeated rows, copies, shared passages."""
    passage, base = prose(1, 60), prose(2, 200)
    near = base.split()
    near[50] = "changed"
    rows = [(i, prose(100 + i, 20 + i), "en" if i % 2 else "fr") for i in range(30)]
    rows += [(100, None, "en"), (101, "", None), (102, " \n\t ", "en"), (None, prose(3, 40), None), (None, None, None), (None, base, "en")]
    rows += [(110, base, "en"), (111, base, "en"), (112, " ".join(near), None), (113, base.upper(), "en"), (114, "one", "en"), (115, "ONE", "en")]
    rows += [(120 + i, f"{prose(200 + i, 50)} {passage} {prose(300 + i, 30)}", "en") for i in range(5)]
    rows += [(130, prose(4, 60_000, 50_000), "en"), (131, "same " * 500, "en"), (132, "x" * 200_000, "en"), (133, "é日本🙂  z q", "fr")]
    rows += [(140, prose(5, 80), "en")] * 3 + [(141, prose(6, 45), "en"), (141, prose(7, 45), "fr")]
    return rows


def wide(rows: list[tuple]) -> list[tuple]:
    return [(i, t, lang, "src", len(t or ""), 7, 8, "k", 9, "f", True, "p") for i, t, lang in rows]


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows as a table with extra columns whose names clash with the operators' own."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(wide(rows), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def scratch(spark):
    from lodestone.plans.runtime import Scratch, ship

    ship(spark)
    s = Scratch(spark)
    yield s
    s.release()
