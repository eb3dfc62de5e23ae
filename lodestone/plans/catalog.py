"""Named queries over the table embeddings, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import sizing
from lodestone.functions.distance import cosine, dot, euclidean, norm
from lodestone.index import VectorIndex
from lodestone.operators import ann, graph, knn
from lodestone.operators.ids import dense_ids
from lodestone.plans.runtime import Scratch, ship
from lodestone.schema import MAX_LAYERS, IndexOptions, violations

M = 16
#: A small M, so that the diversity rule shows on small tables.
SMALL_M = 4
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return put


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def asking(v: DataFrame) -> DataFrame:
    return v.select(F.col("id").alias("query_id"), "embedding")


def shown(found: DataFrame) -> DataFrame:
    """Results with distances rounded as the SQL twins round them."""
    return found.withColumn("distance", F.round(F.col("distance").cast("double"), 4))


# --- SQL fragments

_V = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"
_D = {"euclidean": "list_distance(q.v, b.v)", "cosine": "CASE WHEN list_dot_product(q.v, q.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 1 ELSE 1 - list_cosine_similarity(q.v, b.v) END", "dot": "-list_dot_product(q.v, b.v)"}


def _batch_sql(metric: str, k: str) -> str:
    return f"""WITH e AS ({_V}), p AS (SELECT q.id AS query_id, b.id AS id, {_D[metric]} AS d FROM e q, e b),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank, id, d FROM p)
    SELECT query_id, rank::INT AS rank, id, round(d::FLOAT::DOUBLE, 4) AS distance FROM r WHERE rank <= {k}"""


# --- search


@query(f"WITH e AS ({_V}) SELECT row_number() OVER (ORDER BY d, id)::INT AS rank, id, round(d::FLOAT::DOUBLE, 4) AS distance FROM (SELECT b.id, {_D['euclidean']} AS d FROM e b, (SELECT v FROM e WHERE id = 0) q ORDER BY d, id LIMIT 10)")
def knn_single_l2(spark, sf_dir):
    v = vectors(spark, sf_dir)
    row = v.where("id = 0").first()
    return shown(knn.single(v, row["embedding"] if row else [], 10 if row else 0))


@query(_batch_sql("euclidean", "10"))
def knn_batch_l2(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return shown(knn.batch(asking(v), v, 10))


@query(_batch_sql("cosine", "10"))
def knn_batch_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return shown(knn.batch(asking(v), v, 10, "cosine"))


@query(_batch_sql("dot", "10"))
def knn_batch_dot(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return shown(knn.batch(asking(v), v, 10, "dot"))


@query(_batch_sql("euclidean", "5"))
def knn_grid_l2(spark, sf_dir):
    """The plan for two sides that are both too large to broadcast."""
    v = vectors(spark, sf_dir)
    return shown(knn.batch(asking(v), v, 5, limit=0))


@query(_batch_sql("euclidean", "5"))
def knn_batch_sql(spark, sf_dir):
    """The blockwise plan at every size, held to the SQL of all pairs."""
    v = vectors(spark, sf_dir)
    return shown(knn.batch(asking(v), v, 5))


@query(f"""WITH l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS id, [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100]::FLOAT[]::DOUBLE[] AS v FROM lineitem),
    p AS (SELECT q.id AS query_id, min({{'d': {_D['euclidean']}, 'id': b.id}}, 10) AS n FROM l q, l b WHERE q.id % 50 = 0 GROUP BY q.id)
    SELECT query_id, i::INT AS rank, n[i].id AS id, round(n[i].d::FLOAT::DOUBLE, 4) AS distance FROM (SELECT query_id, n, unnest(range(1, len(n) + 1)) AS i FROM p)""")
def knn_lineitem_l2(spark, sf_dir):
    """Every fiftieth of the lines as a query against all of them, as vectors of four numbers each."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    x = F.expr("cast(array(l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100) as array<float>)")
    scratch = Scratch(spark)
    v = scratch.save(dense_ids(l.select(*order, x.alias("embedding")), 0, order, scratch).select("id", "embedding"), "vectors")
    return shown(knn.batch(asking(v.where("id % 50 = 0")), v, 10))


@query(f"WITH e AS ({_V}), q AS (SELECT v FROM e WHERE id = 0) SELECT row_number() OVER (ORDER BY d, id)::INT AS rank, id, round(d::FLOAT::DOUBLE, 4) AS distance FROM (SELECT b.id, {_D['euclidean']} AS d FROM e b, q)")
def knn_k_exceeds_n(spark, sf_dir):
    v = vectors(spark, sf_dir)
    row = v.where("id = 0").first()
    return shown(knn.single(v, row["embedding"] if row else [], v.count() + 5))


@query("SELECT vec_id AS query_id, 1::INT AS rank, vec_id AS id, 0::DOUBLE AS distance FROM embeddings LIMIT 0")
def knn_k_zero(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return shown(knn.batch(asking(v), v, 0))


# --- functions: each vector against the one after it


def _neighbours(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next")), "id")


def _pairwise_sql(value: str) -> str:
    return f"WITH e AS ({_V}) SELECT q.id, round({value}, 6) AS d FROM e q JOIN e b ON b.id = q.id + 1"


@query(_pairwise_sql(_D["euclidean"]))
def pairwise_l2(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", F.round(euclidean(F.col("embedding"), F.col("next")), 6).alias("d"))


@query(_pairwise_sql(_D["cosine"]))
def pairwise_cosine(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("d"))


@query(_pairwise_sql("list_dot_product(q.v, b.v)"))
def pairwise_dot(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", F.round(dot(F.col("embedding"), F.col("next")), 6).alias("d"))


@query("SELECT vec_id AS id, 1::DOUBLE AS d FROM embeddings")
def zero_norm_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("id", cosine(F.col("embedding"), F.transform("embedding", lambda x: x * 0)).alias("d"))


@query("""WITH e AS (SELECT vec_id, CASE vec_id % 4 WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN '-Infinity'::DOUBLE ELSE embedding[1]::DOUBLE END AS d FROM embeddings)
    SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id)::INT AS rank FROM e""")
def nan_order(spark, sf_dir):
    v = vectors(spark, sf_dir)
    d = F.expr("case id % 4 when 1 then double('NaN') when 2 then double('Infinity') when 3 then double('-Infinity') else double(embedding[0]) end")
    ranked = dense_ids(v.select(F.col("id").alias("vec"), d.alias("d")), 1, ["d", "vec"])
    return ranked.select(F.col("vec").alias("id"), F.col("id").cast("int").alias("rank"))


# --- reading and appending


def _dims(v: DataFrame) -> int:
    return v.agg(F.max(F.size("embedding"))).first()[0] or 1


@contextmanager
def _index(spark, v: DataFrame, options: IndexOptions | None = None) -> Iterator[Callable[..., VectorIndex]]:
    """A way to open one index, as often as wanted, in a folder of the scratch that this query leaves behind."""
    path, dims = f"{Scratch(spark).root}/index", _dims(v)
    yield lambda **how: VectorIndex(spark, path, dims, options, **how)


@query("SELECT vec_id AS id, i - 1 AS pos, round(embedding[i]::DOUBLE, 6) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id IN (0, 7, (SELECT max(vec_id) FROM embeddings)))")
def get_vector(spark, sf_dir):
    """Point reads of three ids, through an index that was written, closed and opened again."""
    v = vectors(spark, sf_dir)
    with _index(spark, v) as opened:
        with opened() as ix:
            last = len(ix.add_batch(v, ["id"])) - 1
            ix.flush()
        with opened(read_only=True) as ix:
            rows = [(i, pos, x) for i in sorted({0, 7, last}) if 0 <= i <= last for pos, x in enumerate(ix.get_vector(i))]
    return spark.createDataFrame(rows, "id long, pos long, value float").select("id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("SELECT vec_id AS id, len(embedding)::INT AS dimensions, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def facade_round_trip(spark, sf_dir):
    """Two appends by two writers, one after the other, then a reader of what they committed."""
    v = vectors(spark, sf_dir)
    half = v.count() // 2
    with _index(spark, v) as opened:
        for part in (v.where(F.col("id") < half), v.where(F.col("id") >= half)):
            with opened() as ix:
                ix.add_batch(part, ["id"])
                ix.flush()
        with opened(read_only=True) as ix:
            return ix.vectors().select("id", F.size("embedding").alias("dimensions"), F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT vec_id AS id, len(embedding)::INT AS dimensions, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def full_scan(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.size("embedding").alias("dimensions"), F.round(norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS id FROM embeddings")
def dense_id_assignment(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return dense_ids(e, 0, ["label", "vec_id"]).select("vec_id", "id")


@query("SELECT vec_id, row_number() OVER (ORDER BY label >= 5, vec_id) - 1 AS id FROM embeddings")
def batch_append(spark, sf_dir):
    """Two appends of one handle: the second's ids go on from the first's. The first element carries vec_id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.expr("array(cast(vec_id as float))").alias("embedding"))
    with _index(spark, e) as opened, opened() as ix:
        ix.add_batch(e.where("label < 5"), ["vec_id"])
        ix.add_batch(e.where("label >= 5 or label is null"), ["vec_id"])
        ix.flush()
        return ix.vectors().select(F.expr("cast(embedding[0] as long)").alias("vec_id"), "id")


@query("WITH n AS (SELECT (count(*) * 9) // 10 AS committed FROM embeddings) SELECT vec_id AS id, vec_id < committed AS visible FROM embeddings, n")
def ghost_rollback(spark, sf_dir):
    """Nine tenths are committed; a writer that dies before it publishes the rest leaves ghosts, which no one sees."""
    v = vectors(spark, sf_dir)
    committed = v.count() * 9 // 10
    with _index(spark, v) as opened:
        with opened() as ix:
            ix.add_batch(v.where(F.col("id") < committed), ["id"])
            ix.flush()
            ix.add_batch(v.where(F.col("id") >= committed), ["id"])
        with opened(read_only=True) as ix:
            seen = ix.vectors().select("id", F.lit(True).alias("seen"))
    return v.join(seen, "id", "left").select("id", F.coalesce("seen", F.lit(False)).alias("visible"))


@query("SELECT count(*) AS len, count(*) = 0 AS is_empty, max(len(embedding))::INT AS dimensions FROM embeddings")
def index_stats(spark, sf_dir):
    """What an open index says of itself."""
    v = vectors(spark, sf_dir)
    with _index(spark, v) as opened, opened() as ix:
        ix.add_batch(v, ["id"])
        ix.flush()
        return spark.createDataFrame([(len(ix), ix.is_empty, ix.dimensions)], "len long, is_empty boolean, dimensions int")


@query("SELECT vec_id AS id, (len(embedding) - 1)::INT AS size FROM embeddings WHERE label = 0")
def dimension_violations(spark, sf_dir):
    """Vectors of label 0 lose an element and are found."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    dims = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    cut = e.select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, F.slice("embedding", 1, max(dims - 1, 0))).otherwise(F.col("embedding")).alias("embedding"))
    return violations(cut, dims).select("id", F.size("embedding").alias("size"))


# --- graph

def _layers(m: int) -> str:
    return f"SELECT vec_id AS id, least(floor(-ln(((vec_id % {sizing.MODULUS} * {sizing.MULTIPLIER} + {sizing.INCREMENT}) % {sizing.MODULUS} + 1) / {float(sizing.MODULUS + 1)}) * {sizing.level_scale(m)!r}), 15)::INT AS layer FROM embeddings"


def _selected(c: str, cap: int, out: str) -> str:
    """The diversity rule over candidates c (src, r, dst, d), ranked from 1 by r: all where they are at most `cap`."""
    return f"""{out}_n AS (SELECT src, max(r) AS n FROM {c} GROUP BY src),
    {out}_walk AS (SELECT src, 0::BIGINT AS r, []::BIGINT[] AS taken, []::DOUBLE[][] AS held FROM {out}_n WHERE n > {cap}
        UNION ALL SELECT w.src, c.r, CASE WHEN ok THEN list_append(taken, c.dst) ELSE taken END, CASE WHEN ok THEN list_append(held, e.v) ELSE held END
        FROM {out}_walk w JOIN {c} c ON c.src = w.src AND c.r = w.r + 1 JOIN e ON e.id = c.dst,
        LATERAL (SELECT len(w.taken) < {cap} AND len(list_filter(w.held, lambda s: list_distance(s, e.v) < c.d)) = 0 AS ok)),
    {out}_last AS (SELECT w.src, w.taken FROM {out}_walk w JOIN {out}_n n ON n.src = w.src AND n.n = w.r),
    {out}_kept AS (SELECT src, dst, d, r FROM {c} JOIN {out}_n USING (src) WHERE n <= {cap}
        UNION ALL SELECT c.src, c.dst, c.d, c.r FROM {c} c JOIN {out}_last USING (src) WHERE list_contains(taken, c.dst)),
    {out}_filled AS (SELECT c.src, c.dst, c.d, row_number() OVER (PARTITION BY c.src ORDER BY c.r) AS k, len(taken) AS have FROM {c} c JOIN {out}_last USING (src) WHERE len(taken) < {cap} / 2.0 AND NOT list_contains(taken, c.dst)),
    {out} AS (SELECT src, dst, d FROM {out}_kept UNION ALL SELECT src, dst, d FROM {out}_filled WHERE k <= {cap} - have)"""


def _both(links: str, out: str, limit: int = 33) -> str:
    """Links and their reverses, each once (out), and the nearest of each node, ranked (out_c)."""
    return f"""{out} AS (SELECT src, dst, d FROM {links} UNION SELECT dst, src, d FROM {links}),
    {out}_c AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r, dst, d FROM {out} QUALIFY r <= {limit})"""


def _near(members: str, out: str) -> str:
    return f"{out} AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r, dst, d FROM (SELECT q.id AS src, b.id AS dst, {_D['euclidean']} AS d FROM {members} q JOIN {members} b ON b.id < q.id) QUALIFY r <= 33)"


_LAYERS = _layers(M)
_CANDIDATES = f"e AS ({_V}), {_near('e', 'c')}"
_FORWARD = f"{_CANDIDATES}, {_selected('c', 2 * SMALL_M, 'fwd')}"
_BOTH = f"{_FORWARD}, {_both('fwd', 'links')}"
#: Layer 1 of the small graph: forward links, then back-links and pruning.
_FORWARD_1 = f"e AS ({_V}), e1 AS (SELECT e.* FROM e JOIN ({_layers(SMALL_M)}) l USING (id) WHERE l.layer >= 1), {_near('e1', 'c1')}, {_selected('c1', SMALL_M, 'fwd1')}"


@query(_LAYERS)
def layer_assignment(spark, sf_dir):
    return graph.assign_layers(vectors(spark, sf_dir), M)


@query(f"SELECT layer, count(*) AS nodes FROM ({_LAYERS}) GROUP BY layer")
def layer_histogram(spark, sf_dir):
    return graph.assign_layers(vectors(spark, sf_dir), M).groupBy("layer").agg(F.count("*").alias("nodes"))


@query(f"SELECT id, layer FROM ({_LAYERS}) ORDER BY layer DESC, id LIMIT 1")
def entry_point(spark, sf_dir):
    return graph.entry_point(graph.assign_layers(vectors(spark, sf_dir), M))


@query(f"WITH {_CANDIDATES} SELECT src, dst, round(d, 6) AS d FROM c")
def forward_candidates_l0(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return graph.candidates(v, graph.assign_layers(v, M), 0).select("src", "dst", F.round("d", 6).alias("d"))


def _forward(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v, Scratch(spark).save(graph.forward_links(v, graph.assign_layers(v, SMALL_M), 0, SMALL_M), "forward")


@query(f"WITH RECURSIVE {_FORWARD} SELECT src, dst, round(d, 6) AS d FROM fwd")
def forward_links_l0(spark, sf_dir):
    return _forward(spark, sf_dir)[1].select("src", "dst", F.round("d", 6).alias("d"))


@query(f"WITH RECURSIVE {_BOTH} SELECT src, dst, round(d, 6) AS d FROM links")
def back_links_l0(spark, sf_dir):
    return graph.back_links(_forward(spark, sf_dir)[1]).select("src", "dst", F.round("d", 6).alias("d"))


@query(f"WITH RECURSIVE {_BOTH}, {_selected('links_c', 2 * SMALL_M, 'pruned')} SELECT src, dst, round(d, 6) AS d FROM pruned")
def pruned_links_l0(spark, sf_dir):
    """Back-links cut to the layer's cap."""
    v, forward = _forward(spark, sf_dir)
    return graph.pruned(graph.back_links(forward), v, 0, SMALL_M).select("src", "dst", F.round("d", 6).alias("d"))


@query(f"WITH RECURSIVE {_FORWARD_1} SELECT src, dst, round(d, 6) AS d FROM fwd1")
def forward_links_l1(spark, sf_dir):
    """Selection above layer 0: among the members of layer 1 only, with its lower cap."""
    v = vectors(spark, sf_dir)
    return graph.forward_links(v, graph.assign_layers(v, SMALL_M), 1, SMALL_M).select("src", "dst", F.round("d", 6).alias("d"))


@query(f"WITH RECURSIVE {_FORWARD_1}, {_both('fwd1', 'links1')}, {_selected('links1_c', SMALL_M, 'pruned1')} SELECT src, dst, round(d, 6) AS d FROM pruned1")
def layer_graph_l1(spark, sf_dir):
    """One whole layer by the combined operator: forward links, back-links, pruning."""
    v = vectors(spark, sf_dir)
    return graph.layer_graph(v, graph.assign_layers(v, SMALL_M), 1, SMALL_M, Scratch(spark)).select("src", "dst", F.round("d", 6).alias("d"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), every AS (SELECT vec_id AS id, unnest(CASE WHEN vec_id % 10 = 0 THEN [vec_id, 0, vec_id + 5, 0, -1] ELSE [vec_id - 1, vec_id + 1] END) AS dst FROM embeddings)
    SELECT DISTINCT id, dst FROM every, n WHERE dst >= 0 AND dst < n AND dst != id""")
def graph_edits(spark, sf_dir):
    """A chain whose every tenth record is replaced: bad links are left out, double ones kept once."""
    v = vectors(spark, sf_dir)
    n = v.count()
    chain = v.select("id", F.lit(0).alias("layer"), F.expr(f"filter(array(id - 1, id + 1), x -> x >= 0 and x < {n})").alias("neighbors"))
    edits = v.where("id % 10 = 0").select("id", F.lit(0).alias("layer"), F.expr("array(id, 0L, id + 5, 0L, -1L)").alias("neighbors"))
    return graph.edited(chain, edits, n, M).select("id", F.explode("neighbors").alias("dst"))


@query("""SELECT vec_id AS id, CASE vec_id % 6 WHEN 1 THEN 'a link to itself' WHEN 2 THEN 'a link to a node that is not there' WHEN 3 THEN 'a link twice' WHEN 4 THEN 'too many links, or none at all' ELSE 'no such layer' END AS fault
    FROM embeddings WHERE vec_id % 6 > 0""")
def graph_faults(spark, sf_dir):
    """Five kinds of broken records are told apart, sound ones pass."""
    v = vectors(spark, sf_dir)
    n = v.count()
    lists = f"case id % 6 when 1 then array(id) when 2 then array({n}L) when 3 then array((id + 1) % {n}, (id + 1) % {n}) when 4 then sequence(0L, {2 * M}L) else array((id + 1) % {n}) end"
    rows = v.select("id", F.expr("if(id % 6 = 5, 16, 0)").alias("layer"), F.expr(lists).alias("neighbors"))
    return graph.graph_violations(rows, n, M, MAX_LAYERS).select("id", "fault")


@query(f"WITH RECURSIVE {_BOTH}, {_selected('links_c', 2 * SMALL_M, 'pruned')}, g AS (SELECT src, count(*) AS degree FROM pruned GROUP BY src) SELECT 0 AS layer, count(*) AS nodes, sum(degree)::BIGINT AS links, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM g")
def degree_stats(spark, sf_dir):
    """Degrees of the links that nodes keep."""
    v, forward = _forward(spark, sf_dir)
    return graph.degree_stats(graph.pruned(graph.back_links(forward), v, 0, SMALL_M).withColumn("layer", F.lit(0)))


@query(f"WITH RECURSIVE {_BOTH}, seen(id) AS (SELECT id FROM (SELECT id FROM ({_LAYERS}) ORDER BY layer DESC, id LIMIT 1) UNION SELECT dst FROM seen JOIN links ON links.src = seen.id) SELECT id FROM seen")
def reachable_from_entry(spark, sf_dir):
    v, forward = _forward(spark, sf_dir)
    scratch = Scratch(spark)
    both = scratch.save(graph.back_links(forward), "links")
    return graph.reachable(both, graph.entry_point(graph.assign_layers(v, M)), scratch).select("id")


@query(f"""WITH RECURSIVE {_BOTH}, start AS (SELECT e.id, e.v FROM e JOIN (SELECT id FROM ({_LAYERS}) ORDER BY layer DESC, id LIMIT 1) USING (id)),
    move(query_id, id, d, done) AS (SELECT q.id, start.id, list_distance(q.v, start.v), false FROM e q, start
        UNION ALL SELECT query_id, CASE WHEN nd < d THEN nid ELSE id END, CASE WHEN nd < d THEN nd ELSE d END, NOT coalesce(nd < d, false)
        FROM (SELECT m.query_id, m.id, m.d, min(list_distance(q.v, b.v)) AS nd, arg_min(b.id, list_distance(q.v, b.v)) AS nid FROM move m JOIN links l ON l.src = m.id JOIN e b ON b.id = l.dst JOIN e q ON q.id = m.query_id WHERE NOT m.done GROUP BY m.query_id, m.id, m.d))
    SELECT query_id, id, round(d, 6) AS d FROM move WHERE done""")
def greedy_descent(spark, sf_dir):
    v, forward = _forward(spark, sf_dir)
    scratch = Scratch(spark)
    both = scratch.save(graph.back_links(forward), "links")
    done = graph.greedy_descent(asking(v), v, both, graph.entry_point(graph.assign_layers(v, M)), scratch)
    return done.select("query_id", "id", F.round("d", 6).alias("d"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), l AS (SELECT vec_id AS src, unnest([vec_id, vec_id + 1, vec_id - 1, vec_id * 2, -1]) AS dst FROM embeddings)
    SELECT src, dst FROM l, n WHERE dst >= 0 AND dst != src AND dst < n""")
def link_filters(spark, sf_dir):
    v = vectors(spark, sf_dir)
    links = v.select(F.col("id").alias("src"), F.explode(F.expr("array(id, id + 1, id - 1, id * 2, -1)")).alias("dst"))
    return graph.link_filter(links, v.count())


@query(f"""WITH s AS (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings), v AS (SELECT n, d, 4096 + n * d * 4 AS vector_end FROM s)
    SELECT n AS vectors, d::INT AS dimensions, 2192::INT AS record_size, vector_end, (vector_end + {sizing.SLACK} + 4095) // 4096 * 4096 AS graph_start, 64 + n * 2192 AS graph_size FROM v""")
def sizing_report(spark, sf_dir):
    s = vectors(spark, sf_dir).agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimensions"))
    end = F.lit(sizing.FILE_HEADER) + F.col("vectors") * F.col("dimensions") * 4
    start = F.floor((end + sizing.SLACK + sizing.PAGE - 1) / sizing.PAGE).cast("long") * sizing.PAGE
    return s.select("vectors", "dimensions", F.lit(sizing.record_size(M)).alias("record_size"), end.alias("vector_end"), start.alias("graph_start"), (sizing.GRAPH_HEADER + F.col("vectors") * sizing.record_size(M)).alias("graph_size"))


# --- approximate search


def _built(spark, v: DataFrame, options: IndexOptions) -> tuple[DataFrame, int]:
    """The graph of `v`, written, and the ids that it spans."""
    return Scratch(spark).save(ann.build_graph(v, options), "graph"), (v.agg(F.max("id")).first()[0] or 0) + 1


def _searched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v, options = vectors(spark, sf_dir), IndexOptions()
    built, n = _built(spark, v, options)
    return v, ann.search(asking(v), v, built, 10, options, n)


@query()
def ann_search(spark, sf_dir):
    return _searched(spark, sf_dir)[1]


@query()
def ann_recall(spark, sf_dir):
    v, found = _searched(spark, sf_dir)
    return ann.recall(found, knn.batch(asking(v), v, 10))


@query("SELECT count(*) AS queries, count(*) * least(count(*), 10) AS rows, true AS ranks_whole, true AS ascending, true AS distances_true, true AS recall_at_least_95 FROM embeddings")
def ann_search_checks(spark, sf_dir):
    """What approximate search with the default options promises: k ranked rows a query, true distances, recall."""
    v, found = _searched(spark, sf_dir)
    found = Scratch(spark).save(found, "found")
    true = found.join(v.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(v, "id").withColumn("true", euclidean(F.col("q"), F.col("embedding")))
    per = true.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"), F.max(F.abs(F.col("true") - F.col("distance"))).alias("off"), F.array_sort(F.collect_list(F.struct("rank", "distance"))).alias("list"))
    sorted_ = F.expr("forall(sequence(1, size(list) - 1), i -> list[i - 1].distance <= list[i].distance)") | (F.size("list") < 2)
    share = ann.recall(found, knn.batch(asking(v), v, 10)).select((F.col("recall") >= 0.95).alias("recall_at_least_95"))
    whole = F.bool_and(F.col("ranks") == F.col("n") * (F.col("n") + 1) / 2)
    return per.agg(F.count("*").alias("queries"), F.sum("n").alias("rows"), whole.alias("ranks_whole"), F.bool_and(sorted_).alias("ascending"), (F.max("off") < 1e-4).alias("distances_true")).join(share)  # a row each


@query(_batch_sql("euclidean", "10"))
def ann_exhaustive_l2(spark, sf_dir):
    """A beam as wide as the table misses nothing that the links of layer 0 lead to: exact search, through the graph."""
    v = vectors(spark, sf_dir)
    n = v.count()
    built, span = _built(spark, v, IndexOptions())
    return shown(ann.search(asking(v), v, built, 10, IndexOptions(ef_search=max(n, 1)), span))


@query(f"""WITH l AS ({_LAYERS}) SELECT r.layer::INT AS layer, count(*) AS nodes, true AS within_cap, true AS sound FROM (SELECT unnest(range(0, max(layer) + 1)) AS layer FROM l) r JOIN l ON l.layer >= r.layer GROUP BY r.layer""")
def graph_build_checks(spark, sf_dir):
    """What the builder promises of each layer: its nodes, its cap, records that the layout allows."""
    v = vectors(spark, sf_dir)
    built, n = _built(spark, v, IndexOptions())
    bad = graph.graph_violations(built, n, M, MAX_LAYERS).select("id", "layer", F.lit(True).alias("bad"))
    cap = F.when(F.col("layer") == 0, sizing.max_neighbors(0, M)).otherwise(sizing.max_neighbors(1, M))
    return built.join(bad, ["id", "layer"], "left").groupBy("layer").agg(F.count("*").alias("nodes"), F.bool_and(F.size("neighbors") <= cap).alias("within_cap"), F.bool_and(F.col("bad").isNull()).alias("sound"))


@query("SELECT count(*) AS nodes, 0::BIGINT AS differing FROM embeddings")
def graph_growth(spark, sf_dir):
    """A graph of the first half that grows by the second, in shards, equals the one built at once."""
    v, options, per_shard = vectors(spark, sf_dir), IndexOptions(SMALL_M, 50), 200
    half = v.count() // 2
    scratch = Scratch(spark)
    old = scratch.save(ann.build_graph(v.where(F.col("id") < half), options, per_shard), "old")
    new = ann.build_graph(v, options, per_shard, 0, half, old)
    grown = scratch.save(old.where(F.col("id") < half // per_shard * per_shard).unionByName(new), "grown")
    once = scratch.save(ann.build_graph(v, options, per_shard), "once")
    differing = grown.exceptAll(once).union(once.exceptAll(grown)).agg(F.count("*").alias("differing"))
    return grown.agg(F.count_distinct("id").alias("nodes")).join(differing)  # a row each
