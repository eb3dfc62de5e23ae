"""Lodestone: nearest-neighbour search over fixed-dimension vectors, on PySpark."""

__version__ = "0.1.0"
