"""Schemas, options and their bounds."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import DimensionMismatchError

VECTORS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)])
GRAPH = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("layer", T.IntegerType(), False), T.StructField("neighbors", T.ArrayType(T.LongType(), False), False)])
RESULT = "query_id long, rank int, id long, distance float"

MAX_DIMENSIONS = 4096
MAX_LAYERS = 16
#: Candidates that neighbour selection looks at.
CANDIDATES = 33


@dataclass(frozen=True)
class IndexOptions:
    """max_connections (M): links a node keeps above layer 0, half of those it keeps there."""

    max_connections: int = 16
    ef_construction: int = 200
    ef_search: int = 50

    def validate(self) -> IndexOptions:
        if not 2 <= self.max_connections <= 32767:
            raise ValueError("max_connections must be between 2 and 32767")
        if self.ef_construction < 1 or self.ef_search < 1:
            raise ValueError("ef_construction and ef_search must be at least 1")
        return self

    def dict(self) -> dict[str, int]:
        return asdict(self)


def check_dimensions(dimensions: int) -> int:
    if not isinstance(dimensions, int) or not 1 <= dimensions <= MAX_DIMENSIONS:
        raise ValueError(f"dimensions must be between 1 and {MAX_DIMENSIONS}")
    return dimensions


def candidate_limit(max_count: int) -> int:
    """Candidates looked at for max_count links: 33, or one more than the links where those are more."""
    return max(CANDIDATES, max_count + 1)


def violations(vectors: DataFrame, dimensions: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector is null, holds a null, or has another length."""
    return vectors.where(F.expr(f"`{column}` is null or size(`{column}`) != {dimensions} or exists(`{column}`, v -> v is null)"))


def require_dimensions(vectors: DataFrame, dimensions: int, column: str = "embedding") -> None:
    bad = violations(vectors, dimensions, column).limit(1).count()
    if bad:
        raise DimensionMismatchError(f"dimension mismatch: vectors of {dimensions} finite or non-finite, non-null elements are expected")
