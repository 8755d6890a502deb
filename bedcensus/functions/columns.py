"""Column expressions shared by the operators.

All of them are built-in Spark SQL expressions, so they stay inside
whole-stage codegen; there is no Python UDF anywhere in the library.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_POW_32 = float(2**32)

#: Days of a block: one bit each of a BIGINT, which stays positive.
BLOCK_DAYS = 63


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rounded(col: Column | str) -> Column:
    """Round half away from zero and return BIGINT.

    Spark's ``round`` is HALF_UP on doubles (2.5 -> 3, -2.5 -> -3), the same
    as numeric rounding in the original SQL. The BIGINT cast also turns a
    rounded ``-0.0`` into ``0``.
    """
    return F.round(_c(col)).cast("bigint")


def los_error(actual: Column | str = "actual_los", predicted: Column | str = "predicted_los") -> Column:
    """Rounded length-of-stay error ``round(actual - predicted)`` as BIGINT."""
    return rounded(_c(actual) - _c(predicted))


def discharge_day(admit: Column | str, los: Column | str) -> Column:
    """Last day of a stay: admission date plus the rounded length of stay.

    The original casts the length to an integer before adding it, which
    rounds; ``cast(int)`` in Spark truncates, so round first.
    """
    return F.date_add(F.to_date(_c(admit)), rounded(los).cast("int"))


def clip_start(start: Column, lo: date) -> Column:
    """``max(start, lo)``, NULL when ``start`` is NULL.

    Spark's ``greatest`` / ``least`` skip NULLs, which would turn a stay
    without an end into one reaching the window edge.
    """
    return F.when(start < F.lit(lo), F.lit(lo)).otherwise(start)


def clip_end(end: Column, hi: date) -> Column:
    """``min(end, hi)``, NULL when ``end`` is NULL."""
    return F.when(end > F.lit(hi), F.lit(hi)).otherwise(end)


def day_span(start: Column, end: Column, lo: date, hi: date) -> Column:
    """Array of the days of ``[start, end]`` inside the window ``[lo, hi]``.

    NULL when the clipped span is empty (negative length, or the stay lies
    outside the window) or an end is NULL, so ``explode`` yields no row for
    it. The guard sits in the same expression as ``sequence``: Spark's
    ``sequence`` would descend for ``start > end`` instead of returning
    nothing.
    """
    s = clip_start(start, lo)
    e = clip_end(end, hi)
    return F.when(s <= e, F.sequence(s, e))


def _bit(day: Column | str) -> Column:
    """Place of ``day`` in its block, 0 to ``BLOCK_DAYS - 1``."""
    return F.pmod(F.unix_date(_c(day)), F.lit(BLOCK_DAYS)).cast("int")


def block_day(day: Column | str) -> Column:
    """First day of the block of ``BLOCK_DAYS`` days that holds ``day``."""
    return F.date_sub(_c(day), _bit(day))


def day_bits(day: Column | str) -> Column:
    """``day`` as the set of its block that holds only it; ``bit_or`` of such
    sets is the set of all their days, in eight bytes."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(day))


def bit_places(bits: Column) -> Column:
    """Places from the first to the last day of a set, NULL for an empty one;
    those between that are not in it are left out by :func:`holds`."""
    first = F.bit_count(bits.bitwiseAND(-bits) - 1)
    last = F.length(F.bin(bits)) - 1
    return F.when(bits > 0, F.sequence(first, last))


def holds(bits: Column | str, place: Column | str) -> Column:
    """Whether the day at ``place`` is in the set; NULL for a NULL set."""
    return F.getbit(_c(bits), _c(place)) == 1


def uniform01(*key_cols: Column | str, salt: str = "") -> Column:
    """Reproducible uniform draw in [0, 1) from the row key.

    The first 8 hex digits of ``md5(salt || key)`` read as an unsigned 32-bit
    integer, divided by 2^32. A pure function of the key: the draw does not
    depend on partitioning, task retries or re-evaluation of a lazy plan, and
    the same expression is available in DuckDB for the oracle. Several
    columns are joined by ``|``; a NULL is written as ``~``.
    """
    if not key_cols:
        raise ValueError("uniform01 needs at least one key column")
    parts = [F.coalesce(_c(c).cast("string"), F.lit("~")) for c in key_cols]
    key = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    if salt:
        key = F.concat(F.lit(salt), key)
    hex8 = F.substring(F.md5(key), 1, 8)
    return F.conv(hex8, 16, 10).cast("bigint").cast("double") / F.lit(_TWO_POW_32)
