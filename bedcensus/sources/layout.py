"""Stored layouts of the two input tables.

``write_bucketed``  both tables bucketed by the rebase join's keys, so that C10
                    and the job's attach join read co-located buckets and
                    shuffle nothing.
``write_dated``     ``evaluation`` partitioned by admission month, with the last
                    day that any stay of a month can reach, so that a window
                    reads only the months whose stays can touch it.

A folder holds ``evaluation.parquet``, ``admissions.parquet`` and ``layout``, a
one-line JSON text that says how they are stored. Without ``layout`` the same
files are read as plain tables.
"""

from __future__ import annotations

import hashlib
import json
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedcensus.config import DayWindow
from bedcensus.session import broadcast_if_bounded

JOIN_KEYS = ["subject_id", "hadm_id"]
#: The partition column of a dated table: year * 100 + month, NULL without a start.
MONTH = "admit_month"
#: A bucket of so many times the mean row count means a hot key: a bucket is one
#: task and is never split, so such a table is stored plain (its join shuffles,
#: and the adaptive planner splits the key).
SKEW_FACTOR = 4
#: Buckets of at most so many rows are never called hot.
SKEW_MIN_ROWS = 100_000
ROWS_PER_FILE = 5_000_000
#: Stays that last longer are taken to reach any later day.
LONGEST_TRACKED_DAYS = 1_000_000
LAST_DATE = date(9999, 12, 31)
#: Months that may be broadcast when files are dealt out.
MAX_MONTHS_BROADCAST = 200_000


def _layout_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/layout"


def _table(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def _say(spark: SparkSession, folder: str, layout: dict) -> None:
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(_layout_path(folder))


def read_layout(spark: SparkSession, folder: str) -> dict | None:
    """What ``layout`` says, or None for a folder without one."""
    from bedcensus.sources.tables import table_exists

    if not table_exists(spark, _layout_path(folder)):
        return None
    return json.loads(spark.read.text(_layout_path(folder)).first()["value"])


# -- buckets -----------------------------------------------------------------


def hottest_bucket(df: DataFrame, buckets: int, keys: list[str]) -> tuple[int, float]:
    """(rows of the fullest bucket, mean rows of a bucket), from one aggregate."""
    sizes = df.groupBy(F.pmod(F.hash(*keys), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"))
    row = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return row["most"] or 0, (row["all"] or 0) / buckets


def write_bucketed(
    ev: DataFrame, adm: DataFrame, folder: str, buckets: int, skew_factor: float = SKEW_FACTOR, skew_min_rows: int = SKEW_MIN_ROWS
) -> dict:
    """Write both tables with ``buckets`` buckets by (subject_id, hadm_id).

    If either table has a hot bucket both are written plain. Returns the layout.
    """
    spark = ev.sparkSession
    tables = {"evaluation": ev, "admissions": adm}
    hot = False
    for df in tables.values():
        most, mean = hottest_bucket(df, buckets, JOIN_KEYS)
        hot |= most > skew_min_rows and most > skew_factor * mean
    for name, df in tables.items():
        if hot:
            df.write.mode("overwrite").parquet(_table(folder, name))
            continue
        table = _table_name(_table(folder, name))
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        # one file a bucket: the shuffle deals rows out as the buckets do
        dealt = df.repartition(buckets, *JOIN_KEYS)
        writer = dealt.write.format("parquet").mode("overwrite").option("path", _table(folder, name))
        writer.bucketBy(buckets, *JOIN_KEYS).sortBy(*JOIN_KEYS).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # external: the files stay, readers name them again
    layout = {"buckets": 0 if hot else buckets}
    _say(spark, folder, layout)
    return layout


def _table_name(path: str) -> str:
    return f"bedcensus_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def read_bucketed_table(spark: SparkSession, path: str, schema: T.StructType, buckets: int) -> DataFrame:
    """A table written by :func:`write_bucketed`, known to this session as bucketed."""
    table, keys = _table_name(path), ", ".join(JOIN_KEYS)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    at = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet"
        f" CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{at}'"
    )
    return spark.table(table)


# -- months ------------------------------------------------------------------


def month_of(admit: str = "admittime") -> Column:
    return (F.year(admit) * 100 + F.month(admit)).cast("int")


def last_reach() -> Column:
    """A day that no stay made from this row passes, on any side of any variant.

    Halved errors lie between both lengths; a mirrored error gives a predicted
    length of about ``2 * actual - predicted`` (the rounded error is added, so
    one day more bounds it), and rounding adds at most another day.
    """
    p, a = F.col("predicted_los"), F.col("actual_los")
    longest = F.ceil(F.greatest(p, a, 2 * a - p, F.lit(0.0))) + 2
    tracked = F.date_add(F.to_date("admittime"), F.least(longest, F.lit(LONGEST_TRACKED_DAYS)).cast("int"))
    return F.when(longest < LONGEST_TRACKED_DAYS, F.least(tracked, F.lit(LAST_DATE))).otherwise(F.lit(LAST_DATE))


def write_dated(ev: DataFrame, adm: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> dict:
    """Write ``evaluation`` partitioned by admission month and ``admissions`` plain.

    A month of many rows is dealt into files of about ``rows_per_file`` rows, so
    a month that holds a third of all stays is written by many tasks. Returns
    the layout: for each month the last day its stays can reach.
    """
    spark = ev.sparkSession
    keyed = ev.withColumn(MONTH, month_of())
    stats = keyed.groupBy(MONTH).agg(F.count("*").alias("n"), F.max(last_reach()).alias("last"))
    months = stats.collect()  # a row a calendar month
    files = spark.createDataFrame([(r[MONTH], -(-r["n"] // rows_per_file)) for r in months], "_month int, _files bigint")
    files = broadcast_if_bounded(files, MAX_MONTHS_BROADCAST)
    salted = keyed.join(files, F.col(MONTH).eqNullSafe(F.col("_month")), "left")
    salted = salted.withColumn("_file", F.pmod(F.xxhash64(*ev.columns), F.coalesce("_files", F.lit(1))))
    dealt = salted.repartition(MONTH, "_file").drop("_month", "_files", "_file")
    dealt.write.mode("overwrite").partitionBy(MONTH).parquet(_table(folder, "evaluation"))
    adm.write.mode("overwrite").parquet(_table(folder, "admissions"))
    known = sorted((r[MONTH], r["last"].isoformat()) for r in months if r[MONTH] is not None)
    layout = {"months": known}
    _say(spark, folder, layout)
    return layout


def read_dated_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table written by :func:`write_dated`, with its ``admit_month``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(MONTH, T.IntegerType())])).parquet(path)


def months_within(layout: dict, window: DayWindow) -> list[int]:
    """The months with a stay that can touch ``window``."""
    found = []
    for month, last in layout["months"]:
        if date(month // 100, month % 100, 1) <= window.hi and date.fromisoformat(last) >= window.lo:
            found.append(month)
    return found


def within(ev: DataFrame, layout: dict | None, window: DayWindow) -> DataFrame:
    """``ev`` without the months that cannot touch ``window`` (``ev`` itself if
    it is not dated). A filter on the partition column, which the scan prunes
    by, also through the adjustments."""
    if not layout or "months" not in layout or MONTH not in ev.columns:
        return ev
    return ev.where(F.col(MONTH).isin(months_within(layout, window)))
