"""The two reading jobs: a full profile, and filter-preview-export."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import date
from functools import cache

from pyspark.sql import DataFrame

from lakewright.functions.columns import col, numeric_columns
from lakewright.operators import profile
from lakewright.operators.clean import parse_dates
from lakewright.operators.filters import filter_table
from lakewright.operators.ordering import PREVIEW_ROWS, preview
from lakewright.operators.sampling import random_sample
from lakewright.sinks.export import write_csv, write_report
from lakewright.sources.readers import overview, row_count


class Tables(Mapping[str, DataFrame]):
    """Named tables, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def profile_table(
    df: DataFrame,
    sample_rows: int | None = None,
    seed: int = 42,
    approximate: bool = False,
    bins: int = 20,
    report_path: str | None = None,
) -> Mapping[str, DataFrame]:
    """Every profile table of a dataset, by name. A table's passes run when it is asked for; those that share quantiles share the passes.

    Without ``sample_rows`` the whole table is profiled. With it, a random sample of about
    that size is; ``columns`` and ``files`` then still describe the dataset.
    """
    total = None
    sampled = df
    if sample_rows is not None:
        total = df.count()
        sampled = random_sample(df, sample_rows, seed, total)

    @cache
    def quartiles() -> dict[str, list[float | None]]:
        return profile.quantiles_of(sampled, numeric_columns(sampled), [0.25, 0.5, 0.75], approximate)

    def columns() -> DataFrame:
        return profile.column_profile(sampled, approximate, {c: [q[1]] for c, q in quartiles().items()})

    def outliers() -> DataFrame:
        return profile.rank_outliers(profile.outliers_iqr(sampled, quartiles={c: [q[0], q[2]] for c, q in quartiles().items()}))

    tables = Tables(
        {
            "rows": lambda: row_count(sampled),
            "overview": lambda: overview(sampled, total),
            "columns": columns,
            "missing": lambda: profile.missing_table(sampled),
            "histograms": lambda: profile.histogram(sampled, bins=bins),
            "correlations": lambda: profile.correlation_matrix(sampled),
            "value_counts": lambda: profile.value_counts(sampled),
            "outliers": outliers,
        }
    )
    if report_path:
        write_report(tables, report_path)
    return tables


def explore_table(
    df: DataFrame,
    category: str | None = None,
    values: Sequence = (),
    date_column: str | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
    rows: int = PREVIEW_ROWS,
    order_by: Sequence[str] = (),
    all_columns: bool = False,
    export_path: str | None = None,
) -> Mapping[str, DataFrame]:
    """Filter a table by category and days, with a preview, counts and a description.

    Text date columns are parsed for the filter; the exported original stays as read.
    """
    dated, offered = parse_dates(df)
    if date_column is not None and date_column not in offered:
        raise ValueError(f"{date_column!r} is not a usable date column; usable are {offered}")
    filtered = filter_table(dated, category, values, date_column, start, end)
    if export_path:
        write_csv(filtered, f"{export_path}/filtered")
        write_csv(df, f"{export_path}/original")
    return Tables(
        {
            "filtered": lambda: filtered,
            "preview": lambda: preview(filtered, rows, [col(c) for c in order_by], all_columns),
            "describe": lambda: profile.describe(filtered),
            "rows": lambda: row_count(filtered),
        }
    )
