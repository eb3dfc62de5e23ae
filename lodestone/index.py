"""The index facade: open, add, search, flush, close."""

from __future__ import annotations

import uuid
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import DimensionMismatchError, LodestoneError
from lodestone.operators import ann, knn
from lodestone.plans.runtime import ship
from lodestone.schema import GRAPH, VECTORS, IndexOptions, require_dimensions
from lodestone.sources.store import LEASE, Manifest, Store

MODES = ("exact", "ann")
#: Numbers that add() and add_batch() of arrays keep on the driver before they are written.
BUFFER = 4_000_000


@dataclass(frozen=True)
class SearchResult:
    id: int
    distance: float

    def __repr__(self) -> str:
        return f"SearchResult(id={self.id}, distance={self.distance:.6f})"


class VectorIndex:
    """Vectors of one dimension under dense ids, searched exactly or over a graph.

    What is added is visible to this handle at once, and to others and after reopening from flush() on. Only one
    writer may have an index open; readers (`read_only`) keep the snapshot they opened.
    """

    def __init__(self, spark: SparkSession, path: str, dimensions: int, options: IndexOptions | None = None, read_only: bool = False, lease: float = LEASE):
        ship(spark)
        self.options = (options or IndexOptions()).validate()
        self.path, self.spark = path, spark
        self._store: Store | None = Store.open(spark, path, dimensions, self.options, read_only, lease)
        self._buffer: list[np.ndarray] = []
        self._staged: list[tuple[str, int]] = []

    # --- life cycle

    def _open(self) -> Store:
        if self._store is None:
            raise LodestoneError("Index is closed")
        return self._store

    def close(self) -> None:
        """Give the lock back; what was not flushed is gone. Closing again does nothing."""
        if self._store is not None:
            self._store.close()
            self._store = None
            self._buffer, self._staged = [], []

    def __enter__(self) -> VectorIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        state = "closed" if self._store is None else f"{len(self)} vectors"
        return f"VectorIndex(path={self.path!r}, {state})"

    # --- writing

    def add(self, vector) -> int:
        """Append one vector (any sequence, narrowed to float32); its id. For many, use add_batch."""
        store = self._open()
        x = np.asarray(vector, dtype=np.float32)
        if x.ndim != 1 or len(x) != store.manifest.dimensions:
            raise DimensionMismatchError(f"dimension mismatch: expected a vector of {store.manifest.dimensions}, got shape {x.shape}")
        self._writable()
        self._buffer.append(x)
        if len(self._buffer) * len(x) >= BUFFER:
            self._spill()
        return len(self) - 1

    def add_batch(self, batch: DataFrame | np.ndarray | list, order: list[str] | None = None) -> range:
        """Append rows with a column `embedding` (or a matrix); the range of their ids.

        Ids follow the columns `order` (without any, the order in which rows are read, which may change from one
        reading to the next). All rows are checked first, and either all become visible or none.
        """
        store = self._open()
        self._writable()
        if not isinstance(batch, DataFrame):
            rows = np.asarray(batch, dtype=np.float32)
            if rows.size == 0:
                return range(len(self), len(self))
            if rows.ndim != 2 or rows.shape[1] != store.manifest.dimensions:
                raise DimensionMismatchError(f"dimension mismatch: expected rows of {store.manifest.dimensions}, got shape {rows.shape}")
            first = len(self)
            step = max(1, BUFFER // rows.shape[1])
            for at in range(0, len(rows), step):
                self._buffer += list(rows[at : at + step])
                if len(self._buffer) >= step:
                    self._spill()
            return range(first, len(self))
        self._spill()
        first = len(self)
        name, n = self._stage(batch, order)
        self._staged.append((name, n))
        return range(first, first + n)

    def _writable(self) -> None:
        if not self._open().writer:
            raise LodestoneError("the index is open for reading only")

    def _stage(self, batch: DataFrame, order: list[str] | None) -> tuple[str, int]:
        store = self._open()
        pending, committed = sum(n for _, n in self._staged), store.manifest.node_count
        store.manifest.node_count = committed + pending
        try:
            return store.stage(batch, order)
        finally:
            store.manifest.node_count = committed

    def _spill(self) -> None:
        """Stage what add() buffered."""
        if self._buffer:
            self._staged.append(self._stage(self._buffered().withColumnRenamed("id", "n"), ["n"]))
            self._buffer = []

    def _buffered(self, first: int = 0) -> DataFrame:
        x = np.stack(self._buffer)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        return self.spark.createDataFrame(pa.table({"id": pa.array(np.arange(first, first + len(x))), "embedding": rows}))

    def flush(self, graph: bool = False, batch: tuple[str, int] | None = None) -> None:
        """Commit what was added by one manifest; with `graph`, link what is not linked yet into the search graph.

        `batch` (a stream's name, the number of its batch) is committed along; see `last_batch`.
        """
        store = self._open()
        self._writable()
        self._spill()
        manifest = deepcopy(store.manifest)
        manifest.vectors += [name for name, _ in self._staged]
        manifest.node_count += sum(n for _, n in self._staged)
        if batch:
            manifest.batches[batch[0]] = batch[1]
        if self._staged or batch:
            store.publish(manifest)
            self._staged = []
        if graph and store.manifest.linked < store.manifest.node_count:
            store.publish(self._linked(deepcopy(store.manifest)))

    def _linked(self, manifest: Manifest) -> Manifest:
        """The manifest with the graph of all its vectors: shards that are full stay, the last one grows, new ones come."""
        store = self._open()
        manifest.per_shard = manifest.per_shard or ann.SHARD
        first = manifest.linked
        name = f"v={manifest.version + 1}-{uuid.uuid4().hex[:8]}/graph"
        ann.build_graph(store.vectors(), self.options, manifest.per_shard, 0, first, store.graph()).write.parquet(f"{store.root}/{name}")
        start = first // manifest.per_shard * manifest.per_shard
        manifest.graphs = [(n, a) for n, a in manifest.graphs if a < start] + [(name, start)]
        manifest.linked = manifest.node_count
        top = self.spark.read.schema(GRAPH).parquet(f"{store.root}/{name}").orderBy(F.desc("layer"), "id").first()
        if manifest.entry_point is None or (-top["layer"], top["id"]) < (-manifest.max_layer, manifest.entry_point):
            manifest.entry_point, manifest.max_layer = top["id"], top["layer"]
        return manifest

    def last_batch(self, stream: str) -> int:
        """The last batch of a stream that is committed, -1 without any."""
        return self._open().manifest.batches.get(stream, -1)

    def discard(self) -> None:
        """Forget what was added since the last flush."""
        self._open()
        self._buffer, self._staged = [], []

    # --- reading

    def vectors(self) -> DataFrame:
        """id, embedding of all that this handle sees."""
        store = self._open()
        rows = store.vectors()
        if self._staged:
            rows = rows.unionByName(self.spark.read.schema(VECTORS).parquet(*[f"{store.root}/{n}" for n, _ in self._staged]))
        if self._buffer:
            rows = rows.unionByName(self._buffered(len(self) - len(self._buffer)))
        return rows

    def get_vector(self, id_: int) -> list[float]:
        return self._open().get(id_)

    def neighbors(self, id_: int, layer: int = 0) -> list[int]:
        """The links of a node in a layer, as committed."""
        return self._open().neighbors(id_, layer)

    def check(self) -> None:
        """Raise if the committed graph breaks the layout."""
        self._open().check_graph()

    def search(self, query, k: int = 10, mode: str = "exact") -> list[SearchResult]:
        """The k nearest of one query by Euclidean distance, nearest first; fewer if there are fewer."""
        store = self._open()
        q = np.asarray(query, dtype=np.float32)
        if q.ndim != 1 or len(q) != store.manifest.dimensions:
            raise DimensionMismatchError(f"dimension mismatch: expected a query of {store.manifest.dimensions}, got shape {q.shape}")
        if k < 1:
            raise ValueError("k must be at least 1")
        if len(self) == 0:
            return []
        if mode == "exact":
            found = knn.single(self.vectors(), q.tolist(), k)
        else:
            asked = self.spark.createDataFrame([(0, q.tolist())], "query_id long, embedding array<float>")
            found = self.search_batch(asked, k, mode)
        return [SearchResult(r["id"], r["distance"]) for r in found.orderBy("rank").collect()]

    def search_batch(self, queries: DataFrame, k: int = 10, mode: str = "exact", metric: str = "euclidean") -> DataFrame:
        """query_id, rank, id, distance for a frame of queries (query_id, embedding). k = 0 gives no rows.

        `ann` needs flush(graph=True) since the last addition and ranks by Euclidean distance.
        """
        store = self._open()
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        require_dimensions(queries, store.manifest.dimensions)
        if mode == "exact":
            return knn.batch(queries, self.vectors(), k, metric)
        if metric != "euclidean":
            raise ValueError("ann search is by Euclidean distance")
        if store.manifest.linked < len(self):
            raise LodestoneError("no graph over all vectors; call flush(graph=True)")
        if not len(self):
            return knn.batch(queries, self.vectors(), 0)
        return ann.search(queries, store.vectors(), store.graph(), k, self.options, len(self), store.manifest.per_shard)

    def graph(self) -> DataFrame:
        return self._open().graph()

    # --- facts

    def __len__(self) -> int:
        return self._open().manifest.node_count + sum(n for _, n in self._staged) + len(self._buffer)

    @property
    def is_empty(self) -> bool:
        return len(self) == 0

    @property
    def dimensions(self) -> int:
        return self._open().manifest.dimensions
