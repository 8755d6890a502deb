"""Prediction adjustments: halve the error (C03) and symmetrise it.

C03 and C06 return the columns of their input with ``predicted_los``
replaced (extra columns ride along), C04 and C05 small lookup tables. All are
narrow maps over ``evaluation`` except for one tiny aggregate: the tail error
histogram has one row per distinct rounded error value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedcensus.functions.columns import los_error, uniform01
from bedcensus.session import broadcast_if_bounded

# A shift table beyond this many rows is joined by shuffle instead of broadcast.
SHIFT_BROADCAST_MAX_ROWS = 1_000_000


def halve_error(ev: DataFrame) -> DataFrame:
    """Move each prediction half-way to the actual length of stay."""
    p, a = F.col("predicted_los"), F.col("actual_los")
    return ev.withColumn("predicted_los", p + (a - p) / F.lit(2.0))


def tail_error_counts(ev: DataFrame, threshold: int = 2) -> DataFrame:
    """``(error, n)`` for rounded errors with ``|error| > threshold``.

    The filter is on the computed error; partial aggregation leaves one row
    per error value and task before the (tiny) shuffle.
    """
    err = los_error().alias("error")
    return (
        ev.select(err)
        .where((F.col("error") < -threshold) | (F.col("error") > threshold))
        .groupBy("error")
        .agg(F.count("error").alias("n"))
    )


def shift_probability(counts: DataFrame, threshold: int = 2) -> DataFrame:
    """``(error, prob)`` for each error ``e > threshold``.

    ``prob = ((n(e) - n(-e)) div 2) / n(e)``: the share of the ``e`` rows that
    must move to ``-e`` for the two counts to meet. The subtraction is halved
    by truncating integer division; a missing ``n(-e)`` counts as 0; a
    negative value means the row never moves. ``n(e) >= 1`` by construction.
    """
    pos = counts.where(F.col("error") > threshold).select(
        F.col("error"), F.col("n").alias("n_pos"), (-F.col("error")).alias("mirror")
    )
    neg = counts.select(F.col("error").alias("mirror"), F.col("n").alias("n_neg"))
    moves = F.expr("(n_pos - coalesce(n_neg, 0L)) div 2")
    return pos.join(neg, "mirror", "left").select(
        "error", (moves.cast("double") / F.col("n_pos").cast("double")).alias("prob")
    )


#: A number that tells fully identical rows apart; null for all other rows.
COPY_COLUMN = "_copy"
# A list of repeated rows beyond this many is joined by shuffle.
COPIES_BROADCAST_MAX_ROWS = 1_000_000


def _row_key() -> list[Column]:
    """The whole row; lengths in millionths, which have one text form."""
    key: list[Column] = [F.col("admittime").cast("timestamp_ntz"), F.col("subject_id"), F.col("hadm_id")]
    return key + [F.floor(F.col(c) * F.lit(1e6)).cast("bigint") for c in ("predicted_los", "actual_los")]


def row_draw(ev: DataFrame) -> Column:
    """One uniform draw per row: a function of the whole row.

    Rows of one id, or without an id, get draws of their own. Fully identical
    rows share a draw unless :func:`number_copies` has told them apart.
    """
    draw = uniform01(*_row_key())
    if COPY_COLUMN not in ev.columns:
        return draw
    return F.when(F.col(COPY_COLUMN).isNull(), draw).otherwise(uniform01(*_row_key(), COPY_COLUMN))


def number_copies(ev: DataFrame, broadcast_max_rows: int = COPIES_BROADCAST_MAX_ROWS) -> DataFrame:
    """``ev`` with ``_copy``, a number for rows that some other row equals.

    The numbers hold only once the result is written. Repeated rows come from
    one map-side combined aggregate over row digests; no task gathers the rows
    of a digest.
    """
    parts = [F.coalesce(c.cast("string"), F.lit("~")) for c in _row_key()]
    keyed = ev.withColumn("_row", F.md5(F.concat_ws("|", *parts)))
    again = keyed.groupBy("_row").count().where(F.col("count") > 1).select("_row", F.lit(True).alias("_again"))
    again = broadcast_if_bounded(again, broadcast_max_rows)
    marked = keyed.join(again, "_row", "left")
    return marked.withColumn(COPY_COLUMN, F.when(F.col("_again"), F.monotonically_increasing_id())).drop("_row", "_again")


def symmetrise(
    ev: DataFrame,
    shift: DataFrame,
    uniform: Column | None = None,
    broadcast_max_rows: int = SHIFT_BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Mirror an error ``e`` to about ``-e`` with probability ``prob(e)``.

    A row whose draw is below ``prob`` gets ``predicted_los + 2 * e``; rows
    without a matching error (or a NULL comparison) keep their prediction.
    The draw defaults to :func:`row_draw`, one per row. The shift table has
    one row per distinct error value; it is broadcast once its size is
    checked against ``broadcast_max_rows``, so ``evaluation`` is not shuffled.
    """
    u = uniform if uniform is not None else row_draw(ev)
    lookup = shift.select(F.col("error").alias("_shift_error"), F.col("prob").alias("_shift_prob"))
    lookup = broadcast_if_bounded(lookup, broadcast_max_rows)
    joined = ev.withColumn("_err", los_error()).join(
        lookup, F.col("_err") == F.col("_shift_error"), "left"
    )
    moved = F.when(
        u < F.col("_shift_prob"), F.col("predicted_los") + F.lit(2) * F.col("_shift_error")
    ).otherwise(F.col("predicted_los"))
    return joined.withColumn("predicted_los", moved).select(*ev.columns)


def symmetric_evaluation(ev: DataFrame, threshold: int = 2, uniform: Column | None = None) -> DataFrame:
    """C04 -> C05 -> C06 on ``ev``."""
    return symmetrise(ev, shift_probability(tail_error_counts(ev, threshold), threshold), uniform)


def adjust_predictions(ev: DataFrame, adjust: str, threshold: int = 2) -> DataFrame:
    """The evaluation table of a variant (``VariantConfig.adjust``)."""
    if adjust == "none":
        return ev
    if adjust == "halve":
        return halve_error(ev)
    if adjust == "symmetric":
        return symmetric_evaluation(ev, threshold)
    if adjust == "symmetric_halve":
        return halve_error(symmetric_evaluation(ev, threshold))
    raise ValueError(f"unknown adjustment {adjust!r}")
