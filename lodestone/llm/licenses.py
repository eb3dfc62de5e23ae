"""License notices by diagonal voting, in DataFrame operations only.

Every rolling k-gram of a text's words whose hash a template has is joined to the positions where templates have it:
one pass over the words, linear in the text, picks them before rows are made of them. Hits of one
notice share the offset between text and template, its diagonal; a word put in or left out shifts to a
neighbouring diagonal, so near diagonals are merged, and a notice counts if its hits cover enough of the
template. Base phrases are templates that must stand whole on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of this operator's own: label -> wordings. No wording has the letter k (see `words_of`).
NOTICES = {
    "agpl": ["gnu affero general public license"],
    "apache-2.0": ["apache license version 2 0", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "bsd": ["bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["cc by nc"],
    "cc-by-nd": ["cc by nd"],
    "cc-by-sa": ["cc by sa"],
    "cc0": ["cc0 1 0 universal"],
    "gpl-2": ["gnu general public license version 2", "either version 2 of the license or at your option any later version"],
    "gpl-3": ["gnu general public license version 3", "either version 3 of the license or at your option any later version"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["gnu lesser general public license"],
    "mit-text": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
K = 2
#: K-grams of these words alone are everywhere and cast no vote.
COMMON = "a and any at by for in is of or the this to with you".split()
#: Diagonals at most this far apart are one notice; share of a template's words that hits must cover (short
#: templates, under SHORT words: all).
DRIFT, COVER, SHORT = 2, 0.8, 8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, whether a base phrase, words)."""
    rows = [(label, True, text) for text, label in PHRASES.items()] + [(label, False, text) for label, texts in NOTICES.items() for text in texts]
    out = [(i, label, base, text.split()) for i, (label, base, text) in enumerate(rows)]
    assert not any("k" in w for *_, words in out for w in words)
    return out


def _voting() -> list[tuple[int, str, bool, int, list[str], int, int]]:
    """(template, label, base, place, the k words there, the template's words, its votes) of every voting k-gram."""
    rows = []
    for number, label, base, words in templates():
        votes = [i for i in range(len(words) - K + 1) if base or not all(w in COMMON for w in words[i : i + K])]
        rows += [(number, label, base, i, words[i : i + K], len(words), len(votes)) for i in votes]
    return rows


def template_grams(spark: SparkSession) -> DataFrame:
    """gram, template, at, w0.., size, votes for every voting k-gram of the templates: a fixed few hundred rows."""
    names = [f"w{j}" for j in range(K)]
    df = spark.createDataFrame([(t, label, base, at, *words, size, votes) for t, label, base, at, words, size, votes in _voting()], f"template int, label string, base boolean, at int, {', '.join(f'{n} string' for n in names)}, size int, votes int")
    return df.withColumn("gram", F.xxhash64(*names))


def gram_hits(words: Column, grams: list[int]) -> Column:
    """(pos, gram, w0..) of each k-gram of the words whose hash is among `grams`, and before them one with pos -1,
    which stands for the text itself."""
    ks = [F.slice(words, j + 1, F.size(words)) for j in range(1, K)]
    rolled = F.arrays_zip(words.alias("w0"), *[x.alias(f"w{j}") for j, x in enumerate(ks, 1)])
    hashed = F.transform(rolled, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(*[x[f"w{j}"] for j in range(K)]).alias("gram"), *[x[f"w{j}"].alias(f"w{j}") for j in range(K)]))
    none = F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("gram"), *[F.lit("").alias(f"w{j}") for j in range(K)])
    return F.concat(F.array(none), F.filter(hashed, lambda x: x["gram"].isin(grams)))


def words_of(text: str) -> str:
    """SQL for the words of a text, A-Z lower-cased. lower() also folds other letters; of those only the Kelvin
    sign becomes ASCII, so word bounds and matches of words without a k are those of an A-Z fold."""
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD.replace(chr(92), chr(92) * 2)}', 0)"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    n_base counts the places of base phrases, first_word and last_word are their least and greatest first word
    (from 0; null without). labels adds those of notices; score is the greatest share of a template's words
    that one notice covers (1 with a base phrase). A null text is empty; a null doc_id is carried along; wholly
    equal rows are scanned alike; other columns are ignored; an empty table gives no rows.
    """
    grams = template_grams(docs.sparkSession)
    known = [r["gram"] for r in grams.select("gram").distinct().collect()]  # fixed rows, whatever the input
    key = ["doc_id", "tkey"]
    split = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.expr(words_of("text")).alias("words"))
    every = split.select(*key, F.size("words").cast("long").alias("n_words"), F.explode(gram_hits(F.col("words"), known)).alias("h")).select(*key, "n_words", "h.*")
    # a hash only proposes; the words themselves decide
    g = F.broadcast(grams).alias("g")
    on = F.expr(" and ".join(["h.gram = g.gram", *[f"h.w{j} = g.w{j}" for j in range(K)]]))
    hits = every.alias("h").join(g, on, "left").where("h.pos < 0 or g.template is not null")
    hits = hits.select(*[f"h.{c}" for c in key], "n_words", "template", "label", "base", "size", "votes", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    copies = F.count_if(F.col("template").isNull()).alias("copies")  # of the row itself, where several are wholly equal
    voted = hits.groupBy(*key, "template", "label", "base", "size", "votes", "diagonal").agg(F.collect_set("at").alias("ats"), F.max("n_words").alias("n_words"), copies)
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    # a base phrase is whole on its own diagonal; notices gather neighbours
    first = (F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT) | F.lag("diagonal").over(along).isNull() | F.col("base")
    parts = voted.withColumn("part", F.sum(first.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ats = F.array_distinct(F.flatten(F.collect_list("ats")))
    spans = parts.groupBy(*key, "template", "label", "base", "size", "votes", "part").agg(ats.alias("ats"), F.min("diagonal").alias("start"), F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + K - 1)))))
    spans = spans.withColumn("cover", F.when(F.size("ats") == F.col("votes"), 1.0).otherwise(covered / F.col("size")))
    spans = spans.withColumn("real", F.when(F.col("base") | (F.col("size") < SHORT), F.size("ats") == F.col("votes")).otherwise(F.col("cover") >= COVER))
    base = F.col("real") & F.col("base")
    text = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        spans.groupBy(*key)
        .agg(
            F.max("n_words").alias("n_words"),
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            text(base).alias("base_labels"),
            text(F.col("real")).alias("labels"),
            F.coalesce(F.max(F.when(~F.col("base") | F.col("real"), F.col("cover"))), F.lit(0.0)).alias("score"),
            F.sum("copies").alias("copies"),
        )
        .withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )


def scan_sql() -> str:
    """The same scan as DuckDB SQL over `documents`."""
    values = [f"({t}, '{label}', {str(base).lower()}, {at}, '{words[0]}', '{words[1]}', {size}, {votes})" for t, label, base, at, words, size, votes in _voting()]
    return f"""
    WITH grams(template, label, base, tpos, w0, w1, size, votes) AS (VALUES {', '.join(values)}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD.replace("x00", "x{0}")}') AS words FROM documents),
    pairs AS (SELECT r, i - 1 AS pos, words[i] AS w0, words[i + 1] AS w1 FROM (SELECT r, words, unnest(range(1, len(words))) AS i FROM docs)),
    lines AS (SELECT r, template, label, base, size, votes, pos - tpos AS diagonal, list(DISTINCT tpos) AS ats FROM pairs JOIN grams USING (w0, w1) GROUP BY ALL),
    jumps AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER w > {DRIFT}, true) THEN 1 ELSE 0 END AS jump FROM lines WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
    parts AS (SELECT *, sum(jump) OVER (PARTITION BY r, template ORDER BY diagonal) AS part FROM jumps),
    spans AS (SELECT r, template, label, base, size, votes, part, list_distinct(flatten(list(ats))) AS ats, min(diagonal) AS first FROM parts GROUP BY r, template, label, base, size, votes, part),
    judged AS (SELECT *, CASE WHEN len(ats) = votes THEN 1.0::DOUBLE ELSE len(list_distinct(list_concat(ats, list_transform(ats, lambda x: x + 1))))::DOUBLE / size END AS cover FROM spans),
    held AS (SELECT *, CASE WHEN base OR size < {SHORT} THEN len(ats) = votes ELSE cover >= {COVER} END AS holds FROM judged),
    found AS (SELECT r, count(*) FILTER (holds AND base) AS n_base, min(first) FILTER (holds AND base) AS first_word, max(first) FILTER (holds AND base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds) AS labels,
        max(cover) FILTER (NOT base OR holds) AS score FROM held GROUP BY r)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM docs LEFT JOIN found USING (r)"""
