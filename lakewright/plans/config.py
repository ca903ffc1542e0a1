"""Settings of the extraction job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from lakewright.operators.ranges import NARROW_HOURS
from lakewright.sinks.lake import CODEC, LEVEL, ROW_GROUP_ROWS, TARGET_FILE_BYTES


@dataclass(frozen=True)
class ExtractConfig:
    """What to join, which rows to keep, and how to lay the result out.

    ``start`` and ``end`` are days, both included whole. ``hours`` is the width of the time
    ranges that name the date folders. ``schema`` fixes the output types in advance; without
    it they are decided from the joined rows. A run with neither days nor a partition column
    writes a dataset without folders and fails where one exists, unless ``replace`` is set.
    """

    table: str
    fact_key: str
    detail_key: str
    detail_columns: tuple[str, ...]
    category: str
    prefix: str = "tb2_"
    excluded: tuple[str, ...] = ()
    category_mode: str = "allow"
    date_column: str | None = None
    start: str | None = None
    end: str | None = None
    hours: int = NARROW_HOURS
    partition_column: str | None = None
    partition_value: object | None = None
    schema: T.StructType | None = None
    min_ratio: float = 1.0
    strict_types: bool = False
    hot_share: float | None = None
    codec: str = CODEC
    level: int | None = LEVEL
    row_group_rows: int | None = ROW_GROUP_ROWS
    dictionary_columns: tuple[str, ...] | None = None
    target_file_bytes: int = TARGET_FILE_BYTES
    replace: bool = False
    facts: dict[str, str] = field(default_factory=dict)
