"""Nearest-neighbour search and graph operators over DataFrames."""
