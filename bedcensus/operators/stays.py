"""Stays -> stay-days (C08, C09, C11, C12) and the old-timeline rebase.

The original joins every stay with a generated calendar under a two-sided
range predicate (``start <= day <= end``); Catalyst would plan that as a
broadcast nested-loop join. Here each stay generates its own clipped day
range with ``explode(sequence(...))``: a narrow, per-row operator with no
shuffle and no calendar table, cost proportional to the output.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedcensus.config import DayWindow
from bedcensus.functions.columns import day_span, discharge_day


def stay_days(ev: DataFrame, window: DayWindow, los_col: str) -> DataFrame:
    """One row per (stay, day) with ``date(admittime) <= day <= dischtime``.

    ``dischtime = date(admittime) + round(los)``; days are clipped to the
    closed ``window``; a negative rounded length gives no day, zero gives one.
    Stays admitted after the window end are filtered on the raw column first,
    which the scan can push down.
    """
    start = F.to_date("admittime")
    end = discharge_day("admittime", los_col)
    days = day_span(start, end, window.lo, window.hi)
    return ev.where(F.col("admittime") < F.lit(window.hi + timedelta(days=1))).select(
        "subject_id",
        "hadm_id",
        start.alias("admittime"),
        end.alias("dischtime"),
        F.explode(days).alias("day"),
    )


def predicted_stay_days(ev: DataFrame, window: DayWindow) -> DataFrame:
    """Predicted stay-days."""
    return stay_days(ev, window, "predicted_los")


def actual_stay_days(ev: DataFrame, window: DayWindow) -> DataFrame:
    """Actual stay-days."""
    return stay_days(ev, window, "actual_los")


def rebase_admissions(ev: DataFrame, adm: DataFrame) -> DataFrame:
    """Replace ``admittime`` by the admissions table's start date.

    Inner equi-join on ``(subject_id, hadm_id)``: a sort-merge join hashed on
    both keys; AQE splits a skewed key's partition.
    """
    left = ev.select("subject_id", "hadm_id", "predicted_los", "actual_los")
    right = adm.select("subject_id", "hadm_id", F.to_date("admittime").alias("admittime"))
    # both tables grow with the data: sort-merge, never broadcast
    return left.join(right.hint("merge"), ["subject_id", "hadm_id"], "inner").select(
        "subject_id", "hadm_id", "admittime", "predicted_los", "actual_los"
    )


REBASE_COLUMNS = ("_old_admittime", "_old_match")


def attach_old_admission(ev: DataFrame, adm: DataFrame) -> DataFrame:
    """``ev`` plus the admissions start date as ``_old_admittime`` and a match
    flag ``_old_match``, by one left join on ``(subject_id, hadm_id)``.

    Valid only when ``adm`` has at most one row per key (checked by the
    caller). The adjustments keep extra columns, so four variants can take
    their old timeline from this one join (:func:`rebased_from_attached`)
    instead of joining again each.
    """
    right = adm.select(
        "subject_id",
        "hadm_id",
        F.to_date("admittime").alias("_old_admittime"),
        F.lit(True).alias("_old_match"),
    )
    return ev.join(right.hint("merge"), ["subject_id", "hadm_id"], "left")


def rebased_from_attached(ev: DataFrame) -> DataFrame:
    """C10 from a table made by :func:`attach_old_admission`."""
    return ev.where(F.col("_old_match")).select(
        "subject_id",
        "hadm_id",
        F.col("_old_admittime").alias("admittime"),
        "predicted_los",
        "actual_los",
    )


def predicted_stay_days_old(ev: DataFrame, adm: DataFrame, window: DayWindow) -> DataFrame:
    """C11: C10 then C08 on the old timeline."""
    return predicted_stay_days(rebase_admissions(ev, adm), window)


def actual_stay_days_old(ev: DataFrame, adm: DataFrame, window: DayWindow) -> DataFrame:
    """C10 then C09 on the old timeline."""
    return actual_stay_days(rebase_admissions(ev, adm), window)
