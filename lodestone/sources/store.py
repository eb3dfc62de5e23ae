"""Vectors and graph on a shared file system: immutable Parquet snapshots under one manifest.

The manifest alone says what is committed. A publish writes new directories first, and then replaces the
manifest by a rename; directories that no manifest names are leftovers of a writer that died, and are ignored.
One writer at a time holds the lock file, as a lease that it renews while it lives: after a crash the lease runs out
and the next writer takes it over. Each publish makes sure that the lease and the manifest are still its own. Readers
pin the manifest they opened.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
import weakref
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import CorruptIndexError, DimensionMismatchError, IndexLockedError, IndexNotFoundError, InvalidPathError, LodestoneError, OutOfBoundsError
from lodestone.operators.graph import graph_violations
from lodestone.operators.ids import dense_ids
from lodestone.plans.runtime import Scratch
from lodestone.schema import GRAPH, MAX_LAYERS, VECTORS, IndexOptions, check_dimensions, require_dimensions

FORMAT = 1


@dataclass
class Manifest:
    """What is committed. `vectors` lists directories of appended rows; `graphs` those of the graph with the first id
    that each holds (up to the next one's first), `linked` how many nodes they link; `batches` has the last batch of
    each stream."""

    dimensions: int
    m: int
    format_version: int = FORMAT
    node_count: int = 0
    entry_point: int | None = None
    max_layer: int = 0
    m0: int = 0
    max_layers: int = MAX_LAYERS
    version: int = 0
    vectors: list[str] = field(default_factory=list)
    graphs: list[tuple[str, int]] = field(default_factory=list)
    linked: int = 0
    per_shard: int = 0
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        try:
            m = cls(**json.loads(text))
            check_dimensions(m.dimensions)
        except (ValueError, TypeError) as e:
            raise InvalidPathError(f"not a valid manifest: {e}") from e
        if m.format_version != FORMAT or not 0 <= m.linked <= m.node_count or m.m0 != 2 * m.m:
            raise InvalidPathError("not a valid manifest: unknown format or bad counts")
        return m


class Files:
    """The few file operations that publishing needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))] if self.exists("") else []

    def make(self) -> None:
        self.fs.mkdirs(self.path(""))

    def claim(self, name: str) -> bool:
        """Create a file unless it is there."""
        return self.fs.createNewFile(self.path(name))

    def modified(self, name: str) -> float:
        """When a file was written, in seconds."""
        return self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Put a file in place as a whole: written aside, then renamed over."""
        aside = f".{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync()
        finally:
            stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        options = self._array(hadoop.Options.Rename, [hadoop.Options.Rename.OVERWRITE])
        hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(aside), self.path(name), options)

    def _array(self, kind, items):
        from pyspark import SparkContext

        out = SparkContext._gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out


MANIFEST, LOCK = "manifest.json", "writer.lock"


class Lease:
    """The right to write: a file with an owner and a time until which it holds, renewed as long as this object lives."""

    def __init__(self, files: Files, seconds: float):
        self.files, self.seconds, self.owner = files, seconds, uuid.uuid4().hex
        if not files.claim(LOCK):
            owner, until = self._read()
            if time.time() < until:
                raise IndexLockedError(f"another writer holds {files.root} (already open by {owner or 'one that is starting'})")
            self._write()
            time.sleep(0.2)  # of several that take over at once, the last to write has it
            if self._read()[0] != self.owner:
                raise IndexLockedError(f"another writer took {files.root} over at the same time (already open)")
        else:
            self._write()
        self.done = threading.Event()
        threading.Thread(target=_renew, args=(weakref.ref(self), self.done, seconds / 3), daemon=True).start()
        weakref.finalize(self, self.done.set)

    def _read(self) -> tuple[str, float]:
        try:
            found = json.loads(self.files.read(LOCK))
            return found["owner"], float(found["until"])
        except (ValueError, KeyError, TypeError):  # claimed, and not yet written
            return "", self.files.modified(LOCK) + self.seconds

    def _write(self) -> None:
        self.files.replace(LOCK, json.dumps({"owner": self.owner, "until": time.time() + self.seconds}))

    def held(self) -> bool:
        return self.files.exists(LOCK) and self._read()[0] == self.owner

    def renew(self) -> None:
        if self.held():
            self._write()

    def release(self) -> None:
        self.done.set()
        if self.held():
            self.files.delete(LOCK)


def _renew(lease: weakref.ref, done: threading.Event, every: float) -> None:
    while not done.wait(every):
        own = lease()
        if own is None:
            return
        with contextlib.suppress(Exception):  # a storage that fails now may answer next time; publish() checks
            own.renew()
        del own


#: Seconds that a lease holds without renewal.
LEASE = 60.0


class Store:
    """An open index directory."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest, files: Files, lease: Lease | None):
        self.spark, self.root, self.manifest, self.files, self.lease = spark, root, manifest, files, lease

    @property
    def writer(self) -> bool:
        return self.lease is not None

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimensions: int, options: IndexOptions | None = None, read_only: bool = False, lease: float = LEASE) -> Store:
        """Open, or create where nothing is. Arguments are checked before anything is written."""
        options = (options or IndexOptions()).validate()
        check_dimensions(dimensions)
        if not isinstance(path, str) or not path or "\0" in path:
            raise InvalidPathError("path must be a non-empty string")
        root = path.rstrip("/") or "/"
        files = Files(spark, root)
        known = files.exists(MANIFEST)
        if not known:
            if read_only:
                raise IndexNotFoundError(f"no index at {root}")
            if [n for n in files.names() if n != LOCK and not n.startswith(".")]:
                raise InvalidPathError(f"path {root} is not empty and has no manifest")
            files.make()
        held = None if read_only else Lease(files, lease)
        try:
            if files.exists(MANIFEST):
                manifest = Manifest.from_json(files.read(MANIFEST))
            else:
                manifest = Manifest(dimensions, options.max_connections, m0=2 * options.max_connections)
                files.replace(MANIFEST, manifest.to_json())
            if manifest.dimensions != dimensions:
                raise DimensionMismatchError(f"dimension mismatch: the index has {manifest.dimensions}, not {dimensions}")
            if manifest.m != options.max_connections:
                raise LodestoneError(f"max_connections mismatch: the index has {manifest.m}, not {options.max_connections}")
            store = cls(spark, root, manifest, files, held)
            store._reconcile()
            return store
        except BaseException:
            if held:
                held.release()
            raise

    def close(self) -> None:
        if self.lease is not None:
            self.lease.release()
            self.lease = None

    def _rows(self) -> DataFrame:
        if not self.manifest.vectors:
            return self.spark.createDataFrame([], VECTORS)
        return self.spark.read.schema(VECTORS).parquet(*[f"{self.root}/{v}" for v in self.manifest.vectors])

    def _reconcile(self) -> None:
        """Fewer rows than committed is corruption; what lies in other directories are ghosts, which nobody reads. The
        files' footers have the counts."""
        if self._rows().count() < self.manifest.node_count:
            raise CorruptIndexError("corruption: the manifest commits to more vectors than the directories hold")

    def vectors(self) -> DataFrame:
        """The committed rows: id, embedding."""
        return self._rows().where(F.col("id") < self.manifest.node_count)

    def graph(self) -> DataFrame:
        """The committed graph: id, layer, neighbors."""
        parts = self.manifest.graphs
        if not parts:
            return self.spark.createDataFrame([], GRAPH)
        ends = [first for _, first in parts[1:]] + [self.manifest.linked]
        out = None
        for (name, first), end in zip(parts, ends, strict=True):
            part = self.spark.read.schema(GRAPH).parquet(f"{self.root}/{name}").where((F.col("id") >= first) & (F.col("id") < end))
            out = part if out is None else out.union(part)
        return out

    def neighbors(self, id_: int, layer: int = 0) -> list[int]:
        """The committed links of a node in a layer, none where it isn't."""
        if not 0 <= id_ < self.manifest.node_count:
            raise OutOfBoundsError(f"{id_} is out of bounds: {self.manifest.node_count} vectors are committed")
        row = self.graph().where((F.col("id") == id_) & (F.col("layer") == layer)).first()
        return list(row["neighbors"]) if row else []

    def check_graph(self) -> None:
        """Refuse a graph whose rows the layout does not allow."""
        bad = graph_violations(self.graph(), self.manifest.node_count, self.manifest.m, self.manifest.max_layers).first()
        if bad:
            raise CorruptIndexError(f"node {bad['id']} at layer {bad['layer']}: {bad['fault']}")

    def get(self, id_: int) -> list[float]:
        """One committed vector; Parquet statistics prune all but its row group."""
        if not 0 <= id_ < self.manifest.node_count:
            raise OutOfBoundsError(f"{id_} is out of bounds: {self.manifest.node_count} vectors are committed")
        return list(self.vectors().where(F.col("id") == id_).first()["embedding"])

    def stage(self, batch: DataFrame, order: list[str] | None = None) -> tuple[str, int]:
        """Write rows with a column embedding under fresh dense ids, in the order of `order` (as read, if none).

        Returns the directory and the rows; nothing is committed. All rows are checked before any is visible.
        """
        by = [f"__o{i}" for i in range(len(order or []))]
        narrow = batch.select(F.col("embedding").cast("array<float>").alias("embedding"), *[F.col(c).alias(o) for c, o in zip(order or [], by, strict=True)])
        require_dimensions(narrow, self.manifest.dimensions)
        name = f"v={self.manifest.version + 1}-{uuid.uuid4().hex[:8]}/vectors"
        scratch = Scratch(self.spark)
        rows = dense_ids(narrow, self.manifest.node_count, by, scratch)
        rows.select("id", "embedding").sortWithinPartitions("id").write.parquet(f"{self.root}/{name}")
        scratch.release()
        return name, self.spark.read.parquet(f"{self.root}/{name}").count()

    def publish(self, manifest: Manifest) -> None:
        """Make a manifest the committed one."""
        if not self.writer:
            raise LodestoneError("the index is open for reading only")
        if not self.lease.held() or Manifest.from_json(self.files.read(MANIFEST)).version != self.manifest.version:
            raise IndexLockedError(f"another writer has taken {self.root} over; nothing was published")
        manifest.version = self.manifest.version + 1
        self.files.replace(MANIFEST, manifest.to_json())
        self.manifest = manifest


__all__ = ["GRAPH", "Files", "Manifest", "Store", "dense_ids"]
