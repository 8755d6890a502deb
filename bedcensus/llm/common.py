"""Helpers shared by the operators of this subpackage.

Column clashes: an operator adds columns to the rows it is given; an input
column whose name equals one of the added names (ignoring case) is replaced.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Rows of one Arrow batch; a batch of the longest texts still fits a worker.
ARROW_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns in ``names`` (ignoring case)."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and, in the struct ``_row``, every column but the text.

    What an operator adds can then not meet a column of the input.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*rest).alias("_row"))


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows made by :func:`carried`; the text is the column ``text``."""
    return df.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Hand freed memory back to the system: a worker that is kept for the next
    task would hold on to the most that this one needed."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (a session setting, read when a job runs)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    fields: list[tuple[str, str]],
) -> DataFrame:
    """Add columns computed batch by batch in Python.

    ``make()`` runs once per task and returns the function that maps a batch to
    one Arrow array per entry of ``fields`` (name, Spark type).
    """
    bounded_batches(df.sparkSession)
    names = [n for n, _ in fields]
    kept = without(df, names).columns
    added = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows:
                cols = [b.column(b.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(cols + work(b), names=kept + names)
        release_memory()

    return df.mapInArrow(run, schema)


def expand_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
    finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """Map each Arrow batch to a batch of ``schema`` with any number of rows.

    ``finish`` maps what all batches of a task give to what the task returns.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        made = (work(b) for b in batches if b.num_rows)
        yield from made if finish is None else finish(made)
        release_memory()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def crc32(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    return materialize(df, f"llm-{name}")
