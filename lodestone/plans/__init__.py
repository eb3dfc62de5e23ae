"""Plan support: shipping the package to executors and cutting lineage."""
