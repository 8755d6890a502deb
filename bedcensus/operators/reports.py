"""Result tables: histograms and numbered daily series.

Inputs here are calendar-sized (one row per day) or evaluation-sized with a
tiny grouped output; the un-partitioned ``row_number`` windows only ever see
at most one year of days or one row per occupancy level.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedcensus.functions.columns import los_error


def histogram(df: DataFrame, value: str = "error") -> DataFrame:
    """``(value, n)`` with ``n = count(value)``, ascending, NULL last.

    ``count`` of the column, not of rows: a NULL group reports 0.
    """
    return df.groupBy(value).agg(F.count(value).alias("n")).orderBy(F.col(value).asc_nulls_last())


def los_error_histogram(ev: DataFrame) -> DataFrame:
    """Histogram of ``round(actual_los - predicted_los)``."""
    return histogram(ev.select(los_error().alias("error")))


def occupancy_error(occ: DataFrame) -> DataFrame:
    return occ.select("timeline", (F.col("actual_count") - F.col("predicted_count")).cast("bigint").alias("error"))


def occupancy_error_histogram(occ: DataFrame) -> DataFrame:
    """Histogram of ``actual_count - predicted_count`` per day."""
    return histogram(occupancy_error(occ).select("error"))


def _year_filter(col: str, year: int):
    # A range on the column instead of year(col) = y: prunable by statistics.
    return (F.col(col) >= F.lit(date(year, 1, 1))) & (F.col(col) < F.lit(date(year + 1, 1, 1)))


def occupancy_error_series(occ: DataFrame, year: int) -> DataFrame:
    """C17: ``(rn, timeline, error)`` for the days of ``year``, numbered by day."""
    w = Window.orderBy("timeline")
    return (
        occupancy_error(occ)
        .where(_year_filter("timeline", year))
        .select(F.row_number().over(w).cast("bigint").alias("rn"), "timeline", "error")
        .orderBy("timeline")
    )


def bed_occupancy_series(act_days: DataFrame, year: int) -> DataFrame:
    """``(rn, day, n)`` distinct actual ids per day of ``year``."""
    per_day = (
        act_days.where(_year_filter("day", year))
        .groupBy("day")
        .agg(F.countDistinct("hadm_id").alias("n"))
    )
    return numbered_days(per_day, year)


def numbered_days(per_day: DataFrame, year: int) -> DataFrame:
    """``(rn, day, n)`` for the days of ``year``, numbered by day."""
    w = Window.orderBy("day")
    return (
        per_day.where(_year_filter("day", year))
        .select(F.row_number().over(w).cast("bigint").alias("rn"), "day", "n")
        .orderBy("day")
    )


def occupancy_level_frequency(occ: DataFrame) -> DataFrame:
    """``(rn, actual_count, n)`` days per actual occupancy level,
    numbered by level after grouping."""
    w = Window.orderBy("actual_count")
    grouped = occ.groupBy("actual_count").agg(F.count("actual_count").alias("n"))
    return grouped.select(
        F.row_number().over(w).cast("bigint").alias("rn"), "actual_count", "n"
    ).orderBy("rn")
