"""Helpers for operators on a column of number arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(name: str) -> Column:
    """The vector column with its entries as double."""
    return F.col(name).cast("array<double>")


def is_finite(name: str) -> Column:
    """True for a vector that is not null and holds no null, NaN or infinite entry."""
    odd = F.exists(doubles(name), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(name).isNotNull() & ~F.coalesce(odd, F.lit(True))


def floored(name: str, scale: int, limit: int) -> Column:
    """``floor(scale * entry)`` of every entry as bigint, kept within -limit..limit."""
    top = float(limit)
    return F.transform(doubles(name), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(top)), F.lit(-top))).cast("bigint"))


def by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length above 0: the batch's rows of that length, their matrix (no nulls inside)."""
    column = batch.column(batch.schema.get_field_index(name))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)


def saturated(values: np.ndarray) -> np.ndarray:
    """Python integers as int64, those beyond its range as its ends."""
    top = np.iinfo(np.int64)
    return np.array([min(max(int(v), top.min), top.max) for v in values.ravel()], np.int64).reshape(values.shape)
