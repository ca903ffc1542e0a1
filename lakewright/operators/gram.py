"""Correlation of many columns by blocks of matrix products.

A task turns its rows into matrices of deviations, zero where a value is missing, and masks of what is there. For every pair of
column blocks six matrix products hold all sums that pairwise complete correlations need; they are added up inside the task,
and the tasks' sums by Spark, one row per task and column of a block pair. Work grows with the square of the columns as fast as
a processor multiplies, and memory with the square of a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakewright.functions.columns import as_double, field_type

BLOCK = 256
_SUMS = ("n", "a", "b", "aa", "bb", "ab")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns, NaN where a value is missing."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


def blocked_correlation(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Pearson correlations of all pairs over the rows where both are present: column_a, column_b, correlation.

    A constant column correlates to null, as do pairs that meet in no row.
    """
    names = list(columns)
    values = df.select(*[as_double(n, field_type(df, n)).alias(f"c{i}") for i, n in enumerate(names)])

    def add_up(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(names)), np.zeros(len(names), np.int64)
        for batch in frames:
            x = _matrix(batch)
            total += np.nansum(x, 0)
            seen += (~np.isnan(x)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(total), pa.array(seen)], ["i", "total", "seen"])

    sums = values.mapInArrow(add_up, "i bigint, total double, seen bigint").groupBy("i").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    means = np.zeros(len(names))
    for r in sums.collect():
        means[r.i] = r.total / r.seen if r.seen else 0.0
    starts = range(0, len(names), block)

    def multiply(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in frames:
            x = _matrix(batch) - means
            mask = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
            square = x * x
            for p in starts:
                for q in starts[p // block :]:
                    a, b = slice(p, p + block), slice(q, q + block)
                    products = (
                        mask[:, a].T @ mask[:, b],
                        x[:, a].T @ mask[:, b],
                        mask[:, a].T @ x[:, b],
                        square[:, a].T @ mask[:, b],
                        mask[:, a].T @ square[:, b],
                        x[:, a].T @ x[:, b],
                    )
                    held[p, q] = [s + m for s, m in zip(held[p, q], products)] if (p, q) in held else list(products)
        for (p, q), products in held.items():
            rows = len(products[0])
            arrays = [pa.array(np.arange(p, p + rows)), pa.array(np.full(rows, q)), *[pa.array(list(m), pa.list_(pa.float64())) for m in products]]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "q", *_SUMS])

    partial = values.mapInArrow(multiply, "i bigint, q bigint, " + ", ".join(f"{s} array<double>" for s in _SUMS))
    cells = partial.select("i", "q", F.posexplode(F.arrays_zip(*_SUMS)).alias("at", "s")).select("i", (F.col("q") + F.col("at")).alias("j"), "s.*")
    added = cells.filter("i <= j").groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])

    def scaled(square: str, plain: str):
        return F.col(square) - F.col(plain) * F.col(plain) / F.col("n")

    va, vb = scaled("aa", "a"), scaled("bb", "b")
    # What rounding leaves of a constant column is no variance.
    varied = (F.col("n") > 0) & (va > F.col("aa") * 1e-14) & (vb > F.col("bb") * 1e-14)
    value = F.when(varied, (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(va) / F.sqrt(vb))
    known = {(r.i, r.j): r.value for r in added.select("i", "j", value.alias("value")).collect()}
    rows = [(a, b, known.get((min(i, j), max(i, j)))) for i, a in enumerate(names) for j, b in enumerate(names)]
    rows = [(a, b, None if v is None or math.isnan(v) else v) for a, b, v in rows]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")
