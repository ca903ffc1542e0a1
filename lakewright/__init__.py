"""Extract, clean, profile and explore Parquet lakes with Spark DataFrames."""

from lakewright.plans.config import ExtractConfig
from lakewright.plans.explore import explore_table, profile_table
from lakewright.plans.extract import ExtractResult, joined_rows, run_extract
from lakewright.session import build_session

__all__ = [
    "ExtractConfig",
    "ExtractResult",
    "build_session",
    "explore_table",
    "joined_rows",
    "profile_table",
    "run_extract",
]
