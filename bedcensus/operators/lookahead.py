"""Look-ahead presence (C20) and the look-ahead occupancy error.

For every (day, stay) actually present, C20 asks whether the same stay has
any row ``days`` later; C22 compares, per day, the actual count with the
number of such look-ahead matches plus a constant inflow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedcensus.operators.reports import histogram


def lookahead_presence(flags: DataFrame, days: int = 3, counted: bool = False) -> DataFrame:
    """C20: ``(time, predicted)`` — left equi-join of the actually present rows
    with the rows of the same id ``days`` later, keyed on (id, day + days).

    Row-level output: one row per (present row, matching later row), as the
    original. With ``counted`` equal rows are one row with their number in
    ``copies``. The literal ("join") form builds C22 from that table, as the
    rows themselves grow with the square of an id's rows per day; the other
    forms count the matches without joining
    (:func:`bedcensus.plans.forms.lookahead_counts_by_id`, the sweep).
    """
    # equal rows meet before the join, with map-side partial counts: one row
    # per (id, day) on either side
    now = (
        flags.where(F.col("actual"))
        .groupBy(F.col("hadm_id").alias("_h"), F.date_add("timeline", days).alias("_d"))
        .agg(F.count("*").alias("_now"))
    )
    flag = F.col("predicted")
    future = (
        flags.where(F.col("hadm_id").isNotNull())
        .groupBy(F.col("hadm_id").alias("_h"), F.col("timeline").alias("_d"))
        .agg(F.count_if(flag).alias("_yes"), F.count_if(~flag).alias("_no"), F.count_if(flag.isNull()).alias("_open"))
    )
    unmatched = F.when(F.col("_yes").isNull(), 1).otherwise(F.col("_open"))
    by_flag = [(F.lit(True), F.col("_yes")), (F.lit(False), F.col("_no")), (F.lit(None).cast("boolean"), unmatched)]
    # both sides grow with the stay-days: sort-merge, never broadcast
    found = (
        now.join(future.hint("merge"), ["_h", "_d"], "left")
        .select("_d", "_now", F.inline(F.array(*[F.struct(f.alias("predicted"), n.alias("_later")) for f, n in by_flag])))
        .where(F.col("_later") > 0)
        .select(F.date_sub("_d", days).alias("time"), "predicted", (F.col("_now") * F.col("_later")).alias("copies"))
    )
    if counted:
        return found
    return found.select("time", "predicted", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")


def lookahead_daily(lookahead: DataFrame) -> DataFrame:
    """``(time, pn)``: non-null look-ahead flags per day, TRUE and FALSE alike,
    of rows or of counted rows (``copies``)."""
    if "copies" not in lookahead.columns:
        return lookahead.groupBy("time").agg(F.count("predicted").alias("pn"))
    known = F.when(F.col("predicted").isNotNull(), F.col("copies")).otherwise(0)
    return lookahead.groupBy("time").agg(F.sum(known).alias("pn"))


def lookahead_error_histogram(
    lookahead_per_day: DataFrame, actual_daily: DataFrame, inflow: int = 92
) -> DataFrame:
    """Histogram of ``n - (pn + inflow)`` over days present in both.

    ``lookahead_per_day`` is ``(time, pn)``, ``actual_daily`` is
    ``(timeline, n)``; both are calendar-sized, so the inner join on the day
    is small.
    """
    joined = lookahead_per_day.join(
        actual_daily, lookahead_per_day.time == actual_daily.timeline, "inner"
    )
    err = (F.col("n") - (F.col("pn") + F.lit(inflow))).cast("bigint").alias("error")
    return histogram(joined.select(err))
