"""Presence alignment and daily occupancy, literal semantics.

C13 align_presence        distinct (timeline, predicted_hadm_id, actual_hadm_id)
C14 daily_occupancy       per-day non-null id counts of C13
C15 daily_occupancy_by_side  per-side day counts, full outer joined on day
C18 presence_timeline     C13 carrying both admission dates
C19 presence_flags        coalesced id/date plus two presence flags
C21 daily_actual_distinct distinct actual ids per day

The original full outer joins stay-days on (day, id) and then applies
DISTINCT. Here each side is deduplicated *before* the join, which gives the
same distinct result but never emits all pairs of a duplicated id. The dedup
aggregates combine map-side, so a hot key is collapsed before its shuffle.
They hold the days of an id as one set of bits per block of 63 days: a stay is
one or two rows of a shuffle, not one per day, and a set is unfolded into its
days only after the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedcensus.functions.columns import bit_places, block_day, day_bits, holds


def _presence_blocks(days: DataFrame, bits: str) -> DataFrame:
    """Distinct (day, id) of one side, as one set of days per id and block,
    keyed so that NULL ids meet each other.

    ``_k`` / ``_null`` encode the id so a NULL id joins the other side's NULL
    id of the same day: the original's two ``(day, NULL, NULL)`` rows collapse
    under its DISTINCT, and here they meet in the join instead.
    """
    keyed = days.select(
        block_day("day").alias("block_day"),
        F.coalesce(F.col("hadm_id"), F.lit(0).cast("bigint")).alias("_k"),
        F.col("hadm_id").isNull().alias("_null"),
        day_bits("day").alias("_bits"),
    )
    return keyed.groupBy("block_day", "_k", "_null").agg(F.bit_or("_bits").alias(bits))


def align_presence(pred_days: DataFrame, act_days: DataFrame) -> DataFrame:
    """Distinct ``(timeline, predicted_hadm_id, actual_hadm_id)``."""
    p = _presence_blocks(pred_days, "_p")
    a = _presence_blocks(act_days, "_a")
    here = p.join(a, ["block_day", "_k", "_null"], "full_outer").select(
        "block_day",
        F.when(~F.col("_null"), F.col("_k")).alias("hadm_id"),
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("_p", "_a")],
    )
    return unfold_presence(here, "_p", "_a")


def unfold_presence(blocks: DataFrame, p: str, a: str) -> DataFrame:
    """``(timeline, predicted_hadm_id, actual_hadm_id)`` of ``(block_day,
    hadm_id)`` with the sets ``p`` and ``a`` of days present on each side."""
    either = F.col(p).bitwiseOR(F.col(a))
    return (
        blocks.select("block_day", "hadm_id", p, a, F.explode(bit_places(either)).alias("_place"))
        .where(holds(either, "_place"))
        .select(
            F.date_add("block_day", F.col("_place")).alias("timeline"),
            F.when(holds(p, "_place"), F.col("hadm_id")).alias("predicted_hadm_id"),
            F.when(holds(a, "_place"), F.col("hadm_id")).alias("actual_hadm_id"),
        )
    )


def daily_occupancy(aligned: DataFrame) -> DataFrame:
    """C14: ``(timeline, predicted_count, actual_count)``; days without any row
    get no row (no zero fill)."""
    return aligned.groupBy("timeline").agg(
        F.count("predicted_hadm_id").alias("predicted_count"),
        F.count("actual_hadm_id").alias("actual_count"),
    )


def daily_occupancy_by_side(pred_days: DataFrame, act_days: DataFrame) -> DataFrame:
    """Count each side per day (rows, not distinct ids), then full outer
    join on day. A day missing on one side keeps NULL day and count there.

    Both aggregates are calendar-sized after partial aggregation.
    """
    p = pred_days.groupBy("day").agg(F.count("hadm_id").alias("predicted_count")).select(
        F.col("day").alias("predicted_day"), "predicted_count"
    )
    a = act_days.groupBy("day").agg(F.count("hadm_id").alias("actual_count")).select(
        F.col("day").alias("actual_day"), "actual_count"
    )
    return p.join(a, p.predicted_day == a.actual_day, "full_outer").select(
        F.coalesce("predicted_day", "actual_day").alias("timeline"),
        "predicted_day",
        "predicted_count",
        "actual_day",
        "actual_count",
    )


def _timeline_side(days: DataFrame, side: str) -> DataFrame:
    """Per id and block of one side: its admission dates with the set of days
    of each, and the set of all its days.

    Dedup with map-side partial aggregation first: a hot id collapses to one
    row per admission date, block and task before anything is shuffled, so the
    list that follows has at most one entry per admission date.
    """
    keyed = days.select("hadm_id", "admittime", block_day("day").alias("block_day"), day_bits("day").alias("bits"))
    per_date = keyed.groupBy("hadm_id", "admittime", "block_day").agg(F.bit_or("bits").alias("bits"))
    return per_date.groupBy("hadm_id", "block_day").agg(
        F.collect_list(F.struct("admittime", "bits")).alias(f"{side}_dates"), F.bit_or("bits").alias(f"{side}_any")
    )


def presence_timeline(pred_days: DataFrame, act_days: DataFrame) -> DataFrame:
    """Distinct ``(timeline, predicted_admittime, predicted_hadm_id,
    actual_admittime, actual_hadm_id)`` of the full outer join on (day, id).

    NULL ids never match (plain equality), as in the original. The join is on
    (block, id); inside a block each admission date of one side is paired with
    each of the other on the days both hold, and stands alone on the days the
    other side's dates leave free.
    """
    sides = _timeline_side(pred_days, "p").join(_timeline_side(act_days, "a"), ["hadm_id", "block_day"], "full_outer")
    nobody = F.struct(F.lit(None).cast("date").alias("admittime"), F.lit(None).cast("bigint").alias("bits"))

    def dates(side: str) -> Column:
        return F.explode(F.concat(F.array(nobody), F.coalesce(F.col(f"{side}_dates"), F.array())))

    def free(side: str) -> Column:
        return F.bitwise_not(F.coalesce(F.col(f"{side}_any"), F.lit(0).cast("bigint")))

    paired = sides.select("*", dates("p").alias("p")).select("*", dates("a").alias("a"))
    p, a = F.col("p.bits"), F.col("a.bits")
    days = F.coalesce(p.bitwiseAND(a), p.bitwiseAND(free("a")), a.bitwiseAND(free("p")))
    return (
        paired.select("hadm_id", "block_day", "p", "a", days.alias("bits"))
        .where(F.col("bits") > 0)
        .select("*", F.explode(bit_places(F.col("bits"))).alias("_place"))
        .where(holds("bits", "_place"))
        .select(
            F.date_add("block_day", F.col("_place")).alias("timeline"),
            F.col("p.admittime").alias("predicted_admittime"),
            F.when(p.isNotNull(), F.col("hadm_id")).alias("predicted_hadm_id"),
            F.col("a.admittime").alias("actual_admittime"),
            F.when(a.isNotNull(), F.col("hadm_id")).alias("actual_hadm_id"),
        )
    )


def presence_flags(timeline: DataFrame) -> DataFrame:
    """``(timeline, admittime, hadm_id, predicted, actual)``."""
    return timeline.select(
        "timeline",
        F.coalesce("predicted_admittime", "actual_admittime").alias("admittime"),
        F.coalesce("predicted_hadm_id", "actual_hadm_id").alias("hadm_id"),
        F.col("predicted_hadm_id").isNotNull().alias("predicted"),
        F.col("actual_hadm_id").isNotNull().alias("actual"),
    )


def daily_actual_distinct(timeline: DataFrame) -> DataFrame:
    """``(timeline, n)`` distinct actual ids per day (0 on days with only
    predicted presence)."""
    return timeline.groupBy("timeline").agg(F.countDistinct("actual_hadm_id").alias("n"))
