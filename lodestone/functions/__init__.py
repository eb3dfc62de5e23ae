"""Vector functions as Spark columns and as numpy kernels."""
