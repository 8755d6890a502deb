"""Result sink: headerless comma-separated CSV, sorted, NULL as an empty field.

Result tables are histograms and calendar-sized series (at most one row per
day of the window or per distinct error value), so a single sorted file per
result is cheap: one partition, sorted inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_result(df: DataFrame, path: str, order_by: list[str] | None = None, single_file: bool = True) -> None:
    """Write ``df`` as headerless CSV at ``path`` (overwrite)."""
    keys = [F.col(c).asc_nulls_last() for c in order_by or []]
    if single_file:
        df = df.repartition(1)
        df = df.sortWithinPartitions(*keys) if keys else df
    elif keys:
        df = df.orderBy(*keys)
    (
        df.write.mode("overwrite")
        .option("header", False)
        .option("nullValue", "")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a result written by :func:`write_result` back with its schema."""
    return (
        spark.read.schema(schema)
        .option("header", False)
        .option("nullValue", "")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )
