"""What every plan needs from the session: code on the executors, and written tables that cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_lock = threading.Lock()
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers then import the kernels by name, wherever the driver was started from. Rows go to them in smaller
    batches than Spark's default, which whole texts make heavy, unless the session has set its own size.
    """
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, "2000")
    app = spark.sparkContext.applicationId
    with _lock:
        if app in _shipped:
            return
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone_pkg.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one.

    Only where it is unset, as in local tests, a folder of this machine serves.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):  # local-cluster has executors of its own
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder in place of recomputation.

    A lost executor then costs a read, not the lineage. `release` deletes what was written, `forget` the tables of
    one name; call them once nothing reads the frames any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[str, list[str]] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df`, and return it as read back."""
        path = f"{self.root}/{self.n:03d}-{name}"
        self.n += 1
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, name: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)

    def forget(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                self._delete(path)

    def release(self) -> None:
        self._delete(self.root)


def finished(df: DataFrame, scratch: Scratch, keep: Scratch | None = None) -> DataFrame:
    """`df` as a table written to `keep` (one of its own, if none); what `scratch` holds goes."""
    out = (keep or Scratch(scratch.spark)).save(df, "result")
    scratch.release()
    return out
