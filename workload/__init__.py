"""Queries over the test tables: one Spark form and, where SQL can say it, one SQL form."""

from workload.registry import REGISTRY, Query, table

from workload import cleaning, filtering, jobs, profiling, ranges  # noqa: E402,F401  (registration)

__all__ = ["REGISTRY", "Query", "table"]
