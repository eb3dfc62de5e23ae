"""Layer draw and storage arithmetic of the graph layout, as Spark columns and as plain numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.schema import MAX_LAYERS

# The layout's header and page sizes, and the generator's multiplier, increment and modulus.
FILE_HEADER, GRAPH_HEADER, PAGE, SLACK = 4096, 64, 4096, 8 << 20
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 1 << 31


def level_scale(m: int) -> float:
    """1 / ln(M): a layer holds 1 / M of the one below."""
    return 1 / math.log(m)


def uniform(id_: Column, seed: int = 0) -> Column:
    """A fraction in (0, 1) from an id: integer arithmetic only, so that other engines agree, on the id modulo
    MODULUS, so that no id overflows."""
    return ((id_ % MODULUS * MULTIPLIER + INCREMENT + seed) % MODULUS + 1) / F.lit(float(MODULUS + 1))


def uniform_of(id_: int, seed: int = 0) -> float:
    return ((id_ % MODULUS * MULTIPLIER + INCREMENT + seed) % MODULUS + 1) / (MODULUS + 1)


def layer(u: Column, m: int, max_layers: int = MAX_LAYERS) -> Column:
    """Layer of a node that drew u."""
    return F.least(F.floor(-F.log(u) * F.lit(level_scale(m))), F.lit(max_layers - 1)).cast("int")


def layer_of(u: float, m: int, max_layers: int = MAX_LAYERS) -> int:
    return min(int(-math.log(u) * level_scale(m)), max_layers - 1)


def max_neighbors(layer_: int, m: int) -> int:
    return 2 * m if layer_ == 0 else m


def total_max_neighbors(m: int, max_layers: int = MAX_LAYERS) -> int:
    return 2 * m + m * (max_layers - 1)


def record_size(m: int, max_layers: int = MAX_LAYERS) -> int:
    return (16 + 8 * total_max_neighbors(m, max_layers) + 7) // 8 * 8


def layer_offset(layer_: int, m: int, max_layers: int = MAX_LAYERS) -> int | None:
    if layer_ >= max_layers:
        return None
    return 16 if layer_ == 0 else 16 + 16 * m + 8 * m * (layer_ - 1)


def page_align(n: int) -> int:
    return -(-n // PAGE) * PAGE


def vector_end(count: int, dimensions: int) -> int:
    return FILE_HEADER + 4 * count * dimensions


def graph_start(count: int, dimensions: int) -> int:
    return page_align(vector_end(count, dimensions) + SLACK)


def node_offset(id_: int, count: int, dimensions: int, m: int) -> int:
    return graph_start(count, dimensions) + GRAPH_HEADER + id_ * record_size(m)


def graph_size(nodes: int, m: int, max_layers: int = MAX_LAYERS) -> int:
    return GRAPH_HEADER + nodes * record_size(m, max_layers)
