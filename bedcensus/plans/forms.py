"""Physical forms of the occupancy and look-ahead results.

Every form here returns the same rows as the literal join form in
``bedcensus.operators`` under the condition stated on it:

``daily_sweep``           O(stays): each stay contributes +1/-1 events at the
                          ends of its clipped day spans; events are summed per
                          day (map-side partial aggregation leaves at most one
                          row per day and task), then a running sum over the
                          calendar (window-sized, not data-sized).
                          * C15 per-side row counts: exact for any input.
                          * C14 counts and the C22 look-ahead: exact when the
                            non-null ``hadm_id`` are unique.
``presence_flag_pass``    one explode over the union of both spans with two
                          flags, instead of two explodes, two shuffles and a
                          full outer join. Exact for any input when
                          ``dedupe=True`` (one group-by on (block of days, id)).
``daily_union``           O(stays) for any input: the spans of one id and side
                          are merged to their union (sort, running maximum of
                          the ends, islands), and the islands are the events.
                          * C14, C21 and C23 counts: exact for any input.
``lookahead_counts_by_id``  exact C22 for any input: per (day, id) counts of
                          distinct admission dates per side give the number of
                          look-ahead pairs arithmetically, so the pairs are
                          never materialised.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedcensus.config import DayWindow
from bedcensus.functions.columns import (
    bit_places,
    block_day,
    clip_end,
    clip_start,
    day_bits,
    discharge_day,
    holds,
)
from bedcensus.operators.occupancy import unfold_presence
from bedcensus.session import broadcast_if_bounded

# A list of duplicated ids up to this size (8 bytes each) is broadcast to split
# the stays; beyond it the split joins by shuffle.
DUP_IDS_BROADCAST_MAX = 4_000_000

_COUNTERS = ("p_cnt", "p_any", "a_cnt", "a_any", "u_any", "look")


def stay_spans(ev: DataFrame, pred_window: DayWindow, act_window: DayWindow) -> DataFrame:
    """``(hadm_id, admittime, p_s, p_e, a_s, a_e)``: clipped predicted and actual
    day spans of each stay; a span is empty when its start exceeds its end or
    an end is NULL (a NULL length)."""
    # stays admitted after both windows have empty spans; this bound is on
    # the raw column, so the scan can skip them
    last = max(pred_window.hi, act_window.hi)
    return ev.where(F.col("admittime") < F.lit(last + timedelta(days=1))).select(
        "hadm_id", F.to_date("admittime").alias("admittime"), *_span_columns(F.col("admittime"), pred_window, act_window)
    )


def _span_columns(admit: Column, pred_window: DayWindow, act_window: DayWindow, prefix: str = "") -> list[Column]:
    start = F.to_date(admit)
    return [
        clip_start(start, pred_window.lo).alias(f"{prefix}p_s"),
        clip_end(discharge_day(admit, "predicted_los"), pred_window.hi).alias(f"{prefix}p_e"),
        clip_start(start, act_window.lo).alias(f"{prefix}a_s"),
        clip_end(discharge_day(admit, "actual_los"), act_window.hi).alias(f"{prefix}a_e"),
    ]


def calendar(spark: SparkSession, window: DayWindow) -> DataFrame:
    """One row per day of ``window``; its size is fixed by the window."""
    return spark.range(window.n_days).select(
        F.date_add(F.lit(window.lo), F.col("id").cast("int")).alias("day")
    )


def _cover(a: DayWindow, b: DayWindow) -> DayWindow:
    return DayWindow(min(a.lo, b.lo), max(a.hi, b.hi))


def _max(a: str, b: str) -> str:
    """SQL ``max(a, b)`` that is NULL if either is (``greatest`` skips NULLs)."""
    return f"CASE WHEN {a} >= {b} THEN {a} WHEN {a} < {b} THEN {b} END"


def _min(a: str, b: str) -> str:
    """SQL ``min(a, b)`` that is NULL if either is (``least`` skips NULLs)."""
    return f"CASE WHEN {a} <= {b} THEN {a} WHEN {a} > {b} THEN {b} END"


def _span_events(s: str, e: str, weights: dict[str, str], line: int = 0) -> list[str]:
    """SQL for +w at ``s`` and -w at ``e + 1`` of a non-empty span, else NULL.

    Written as SQL text so the whole event array is one expression: building
    it from Column objects costs thousands of driver round trips.
    """
    def event(day: str, sign: str) -> str:
        fields = ", ".join(
            f"'{c}', CAST({sign}({weights.get(c, '0')}) AS BIGINT)" for c in _COUNTERS
        )
        return f"CASE WHEN {s} <= {e} THEN named_struct('line', {line}, 'day', {day}, {fields}) END"

    return [event(s, ""), event(f"date_add({e}, 1)", "-")]


def daily_sweep(
    ev: DataFrame,
    pred_window: DayWindow,
    act_window: DayWindow,
    lookahead_days: int | None = None,
) -> DataFrame:
    """Per-day counters for every day of the covering window.

    Columns: ``day``; ``p_cnt`` / ``a_cnt`` stays with a non-null id present
    on the predicted / actual side; ``p_any`` / ``a_any`` the same counting
    NULL ids too; ``u_any`` stays present on either side; ``look`` stays
    actually present whose id is present on either side ``lookahead_days``
    later (0 when ``lookahead_days`` is None).
    """
    spans = stay_spans(ev, pred_window, act_window).withColumn("nn", _has_id())
    deltas = _deltas(spans, _sweep_events(lookahead_days), ["day"])
    return daily_from_deltas(deltas, _cover(pred_window, act_window))


def _has_id() -> Column:
    return F.when(F.col("hadm_id").isNotNull(), F.lit(1)).otherwise(F.lit(0))


def _sweep_events(lookahead_days: int | None, prefix: str = "", line: int = 0) -> list[str]:
    """SQL of all events of a stay on one timeline."""
    ps, pe, a_s, ae = (f"{prefix}{c}" for c in ("p_s", "p_e", "a_s", "a_e"))
    events = _span_events(ps, pe, {"p_cnt": "nn", "p_any": "1", "u_any": "1"}, line)
    events += _span_events(a_s, ae, {"a_cnt": "nn", "a_any": "1", "u_any": "1"}, line)
    # union = P + A - (P and A)
    events += _span_events(_max(ps, a_s), _min(pe, ae), {"u_any": "-1"}, line)
    if lookahead_days is not None:
        lag = int(lookahead_days)
        # t in A with t+lag in A:  [a_s, a_e - lag]
        # t in A with t+lag in P:  [max(a_s, p_s - lag), min(a_e, p_e - lag)]
        # both:                    [max(a_s, p_s - lag), min(a_e - lag, p_e - lag)]
        i2s = _max(a_s, f"date_sub({ps}, {lag})")
        events += _span_events(a_s, f"date_sub({ae}, {lag})", {"look": "nn"}, line)
        events += _span_events(i2s, _min(ae, f"date_sub({pe}, {lag})"), {"look": "nn"}, line)
        events += _span_events(i2s, _min(f"date_sub({ae}, {lag})", f"date_sub({pe}, {lag})"), {"look": "-nn"}, line)
    return events


def _deltas(spans: DataFrame, events: list[str], keys: list[str]) -> DataFrame:
    return (
        spans.select(F.expr(f"explode(array({', '.join(events)}))").alias("e"))
        .where(F.col("e").isNotNull())
        .select("e.*")
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in _COUNTERS])
    )


def two_timeline_deltas(
    ev: DataFrame, window: DayWindow, old_pred: DayWindow, old_act: DayWindow, lookahead_days: int
) -> DataFrame:
    """Per-day changes of both timelines from one pass over ``ev``, which
    carries its old admission date (:func:`attach_old_admission`): ``line`` 0
    new (with look-ahead), 1 old."""
    old = F.when(F.col("_old_match"), F.col("_old_admittime"))
    spans = ev.select(
        _has_id().alias("nn"),
        *_span_columns(F.col("admittime"), window, window, "n_"),
        *_span_columns(old, old_pred, old_act, "o_"),
    )
    return _deltas(spans, _sweep_events(lookahead_days, "n_", 0) + _sweep_events(None, "o_", 1), ["line", "day"])


def daily_from_deltas(deltas: DataFrame, cover: DayWindow) -> DataFrame:
    """Running sums of per-day changes over every day of ``cover``."""
    # deltas has at most one row per calendar day (+1 for the day after the
    # window), a bound fixed by the window (a DayWindow of dates, some
    # thousand days), not by the data.
    deltas = F.broadcast(deltas)
    cal = calendar(deltas.sparkSession, cover)
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    daily = cal.join(deltas, "day", "left")
    return daily.select(
        "day", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(run).alias(c) for c in _COUNTERS]
    )


def occupancy_from_sweep(d: DataFrame) -> DataFrame:
    """C14 columns from :func:`daily_sweep` output (unique ids)."""
    return d.where(F.col("u_any") > 0).select(
        F.col("day").alias("timeline"),
        F.col("p_cnt").alias("predicted_count"),
        F.col("a_cnt").alias("actual_count"),
    )


def by_side_from_sweep(d: DataFrame) -> DataFrame:
    """C15 columns from :func:`daily_sweep` output (any ids)."""
    has_p, has_a = F.col("p_any") > 0, F.col("a_any") > 0
    return d.where(has_p | has_a).select(
        F.col("day").alias("timeline"),
        F.when(has_p, F.col("day")).alias("predicted_day"),
        F.when(has_p, F.col("p_cnt")).alias("predicted_count"),
        F.when(has_a, F.col("day")).alias("actual_day"),
        F.when(has_a, F.col("a_cnt")).alias("actual_count"),
    )


def lookahead_from_sweep(d: DataFrame) -> DataFrame:
    """``(time, pn, n)`` from :func:`daily_sweep` output with look-ahead
    counters (unique ids)."""
    return d.where(F.col("a_cnt") > 0).select(
        F.col("day").alias("time"), F.col("look").alias("pn"), F.col("a_cnt").alias("n")
    )


def daily_occupancy_sweep(ev: DataFrame, pred_window: DayWindow, act_window: DayWindow) -> DataFrame:
    """F3 for C14: ``(timeline, predicted_count, actual_count)``.

    Exact when non-null ``hadm_id`` are unique; days nobody occupies on either
    side are dropped (no zero fill), NULL-id stays keep their days.
    """
    return occupancy_from_sweep(daily_sweep(ev, pred_window, act_window))


def daily_occupancy_by_side_sweep(ev: DataFrame, pred_window: DayWindow, act_window: DayWindow) -> DataFrame:
    """C15 by sweep, exact for any input (it counts rows, not ids):
    ``(timeline, predicted_day, predicted_count, actual_day, actual_count)``."""
    return by_side_from_sweep(daily_sweep(ev, pred_window, act_window))


def presence_flag_pass(
    ev: DataFrame, pred_window: DayWindow, act_window: DayWindow, dedupe: bool = True
) -> DataFrame:
    """C13's ``(timeline, predicted_hadm_id, actual_hadm_id)`` from one
    explode over the union of both spans.

    With ``dedupe`` a group-by on (block of days, id) merges duplicate ids (and
    all NULL ids of a day, as the original DISTINCT does) into one set of days
    per side; partial aggregation absorbs hot keys before the shuffle, and a
    stay is one or two groups, not one per day. Without it the result is exact
    only for unique non-null ids, and has no shuffle at all.
    """
    flagged = presence_flag_rows(ev, pred_window, act_window)
    if dedupe:
        sets = [F.bit_or(F.when(F.col(c), day_bits("day")).otherwise(0)).alias(c) for c in ("p", "a")]
        blocks = flagged.withColumn("block_day", block_day("day")).groupBy("block_day", "hadm_id").agg(*sets)
        return unfold_presence(blocks, "p", "a")
    return flagged.select(
        F.col("day").alias("timeline"),
        F.when(F.col("p"), F.col("hadm_id")).alias("predicted_hadm_id"),
        F.when(F.col("a"), F.col("hadm_id")).alias("actual_hadm_id"),
    )


def presence_flag_rows(ev: DataFrame, pred_window: DayWindow, act_window: DayWindow) -> DataFrame:
    """``(day, hadm_id, admittime, p, a)``: one row per stay and day present on
    either side, flags telling which."""
    spans = stay_spans(ev, pred_window, act_window)
    ps, pe, as_, ae = F.col("p_s"), F.col("p_e"), F.col("a_s"), F.col("a_e")
    p_ok, a_ok = ps <= pe, as_ <= ae
    lo = F.when(p_ok & a_ok, F.least(ps, as_)).when(p_ok, ps).otherwise(as_)
    hi = F.when(p_ok & a_ok, F.greatest(pe, ae)).when(p_ok, pe).otherwise(ae)
    days = F.when(p_ok | a_ok, F.sequence(lo, hi))
    d = F.col("day")
    return (
        spans.select("hadm_id", "admittime", "p_s", "p_e", "a_s", "a_e", F.explode(days).alias("day"))
        .select(
            "day",
            "hadm_id",
            "admittime",
            ((ps <= d) & (d <= pe)).alias("p"),
            ((as_ <= d) & (d <= ae)).alias("a"),
        )
        .where(F.col("p") | F.col("a"))
    )


def daily_occupancy_flags(ev: DataFrame, pred_window: DayWindow, act_window: DayWindow) -> DataFrame:
    """C14 for any input: F2 with dedupe, then per-day counts."""
    aligned = presence_flag_pass(ev, pred_window, act_window, dedupe=True)
    return aligned.groupBy("timeline").agg(
        F.count("predicted_hadm_id").alias("predicted_count"),
        F.count("actual_hadm_id").alias("actual_count"),
    )


def interval_union(spans: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """The union of closed day intervals per key: ``keys``, ``start``, ``end`` of
    disjoint intervals that do not touch either.

    ``spans`` holds one interval per row; rows with ``start > end`` or a NULL
    end are empty. NULL keys are a key of their own.

    Two steps, so that a key with very many rows is never in one task whole.
    First only the latest end of each (key, start) is kept: an aggregate that
    combines map-side and is hashed on the start too, which leaves a key at
    most one row per start day. Then a key's rows are sorted by start; a row
    that starts after every earlier end (by more than a day) opens an island,
    and the row before the next such row closes it. Both are found, and paired,
    on the sorted rows as they pass: no aggregate holds the islands of a task.
    """
    latest = spans.where(F.col(start) <= F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    by_key = Window.partitionBy(*keys).orderBy(start)
    earlier = F.max(end).over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(start).over(by_key)
    marked = latest.select("*", earlier.alias("_earlier"), after.alias("_after")).select(
        *keys,
        start,
        F.greatest("_earlier", end).alias("_reach"),
        F.coalesce(F.col(start) > F.date_add("_earlier", 1), F.lit(True)).alias("_opens"),
        F.coalesce(F.col("_after") > F.date_add(F.greatest("_earlier", end), 1), F.lit(True)).alias("_closes"),
    )
    # between its first and last row an island has none here, so the row after
    # one that only opens it closes it
    ends = marked.where(F.col("_opens") | F.col("_closes")).withColumn("_closing", F.lead("_reach").over(by_key))
    return ends.where("_opens").select(*keys, start, F.when(F.col("_closes"), F.col("_reach")).otherwise(F.col("_closing")).alias(end))


def _union_deltas(ev: DataFrame, pred_window: DayWindow, act_window: DayWindow) -> DataFrame:
    """Per-day changes as :func:`_deltas` gives them, ids counted once a day.

    ``p_cnt`` and ``a_cnt`` come from the islands of each id and side; the
    counters that tell whether anyone is there (``*_any``) from the stays.
    """
    spans = stay_spans(ev, pred_window, act_window)
    there = _deltas(spans.withColumn("nn", F.lit(0)), _sweep_events(None), ["day"])
    sides = spans.where(F.col("hadm_id").isNotNull()).select(
        "hadm_id",
        F.expr("stack(2, 0, p_s, p_e, 1, a_s, a_e) as (side, s, e)"),
    )
    islands = interval_union(sides, ["hadm_id", "side"]).selectExpr(
        "s", "e", "IF(side = 0, 1, 0) AS is_p", "IF(side = 1, 1, 0) AS is_a"
    )
    present = _deltas(islands, _span_events("s", "e", {"p_cnt": "is_p", "a_cnt": "is_a"}), ["day"])
    both = there.unionByName(present)
    return both.groupBy("day").agg(*[F.sum(c).alias(c) for c in _COUNTERS])


def daily_union(ev: DataFrame, pred_window: DayWindow, act_window: DayWindow) -> DataFrame:
    """The columns of :func:`daily_sweep` (``look`` is 0) for ids that repeat:
    ``p_cnt`` / ``a_cnt`` count distinct ids, whatever the input."""
    return daily_from_deltas(_union_deltas(ev, pred_window, act_window), _cover(pred_window, act_window))


def add_daily(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counters of two disjoint sets of ids added, day by day (both tables have
    every day of the same calendar)."""
    other = b.select("day", *[F.col(c).alias(f"_b_{c}") for c in _COUNTERS])
    return a.join(F.broadcast(other), "day").select("day", *[(F.col(c) + F.col(f"_b_{c}")).alias(c) for c in _COUNTERS])


def lookahead_counts_by_id(ev: DataFrame, window: DayWindow, lookahead_days: int) -> DataFrame:
    """``(time, pn, n)`` exactly as the literal C18 -> C20 -> C22 chain, for
    any input, without materialising look-ahead pairs.

    For a day t and id h let P and A be the numbers of distinct admission
    dates of h's stays present on t, per side. The literal presence table
    then has ``P*A`` rows for (t, h) when both are positive, else ``P + A``;
    ``A > 0`` of them are "actually present" rows (``P*A`` or ``A``). Each
    present row at (t, h) pairs with every row at (t + lag, h), so
    ``pn(t) = sum_h now(t, h) * rows(t + lag, h)``. Both factors are counted
    from one set of days per (id, admission date, block of days) and side,
    which is one or two rows of a shuffle per stay; the days are unfolded only
    where they are counted. One hot id spreads over its blocks, each with at
    most one entry per admission date.
    """
    lag = int(lookahead_days)
    rows = presence_flag_rows(ev, window, window).where(F.col("hadm_id").isNotNull())
    # a day's presence counts on the day itself (p, a) and, ``lag`` days
    # earlier, as what is found there by looking ahead (lp, la)
    seen = F.explode(F.array(F.struct("day", F.lit(False).alias("ahead")), F.struct(F.date_sub("day", lag).alias("day"), F.lit(True).alias("ahead"))))
    placed = rows.select("hadm_id", "admittime", "p", "a", seen.alias("_seen")).select("hadm_id", "admittime", "p", "a", "_seen.*")
    ahead = F.col("ahead")
    sets = {"p": F.col("p") & ~ahead, "a": F.col("a") & ~ahead, "lp": F.col("p") & ahead, "la": F.col("a") & ahead}
    # partial aggregation first: a hot id becomes one row per admission date,
    # block and task before the shuffle
    per_date = placed.withColumn("block_day", block_day("day")).groupBy("hadm_id", "admittime", "block_day").agg(
        *[F.bit_or(F.when(here, day_bits("day")).otherwise(0)).alias(c) for c, here in sets.items()]
    )
    # an id has at most one entry per admission date in a block
    per_id = per_date.groupBy("hadm_id", "block_day").agg(
        F.collect_list(F.struct(*sets)).alias("dates"), F.bit_or("a").alias("a_any")
    )
    days = per_id.select("block_day", "dates", "a_any", F.explode(bit_places(F.col("a_any"))).alias("_place")).where(
        holds("a_any", "_place")
    )

    def dates(side: str) -> Column:
        return F.size(F.filter("dates", lambda d: holds(d[side], "_place"))).cast("bigint")

    counted = days.select(F.date_add("block_day", F.col("_place")).alias("time"), *[dates(c).alias(c) for c in sets])
    now = F.when(F.col("p") > 0, F.col("p") * F.col("a")).otherwise(F.col("a"))
    both = (F.col("lp") > 0) & (F.col("la") > 0)
    later = F.when(both, F.col("lp") * F.col("la")).otherwise(F.col("lp") + F.col("la"))
    return counted.groupBy("time").agg(F.sum(now * later).alias("pn"), F.count("*").alias("n"))


def duplicate_ids(ev: DataFrame, broadcast_max_ids: int = DUP_IDS_BROADCAST_MAX) -> DataFrame:
    """``hadm_id`` of the ids seen more than once, by one aggregate over the
    ids (map-side partial counts); with a broadcast hint once its size is
    checked."""
    dup = (
        ev.where(F.col("hadm_id").isNotNull())
        .groupBy("hadm_id")
        .count()
        .where(F.col("count") > 1)
        .select("hadm_id")
    )
    return broadcast_if_bounded(dup, broadcast_max_ids)


def split_duplicate_ids(
    ev: DataFrame, broadcast_max_ids: int = DUP_IDS_BROADCAST_MAX, dup: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(rows of ids seen once or NULL, rows of ids seen more than once)``.

    ``dup`` is the list of duplicated ids (:func:`duplicate_ids`), computed
    here when not given. The semi / anti joins broadcast it when it is small
    (so ``ev`` is not shuffled for the split), else join by shuffle, where AQE
    splits a skewed id's partition.
    """
    dup = duplicate_ids(ev, broadcast_max_ids) if dup is None else dup
    return ev.join(dup, "hadm_id", "left_anti"), ev.join(dup, "hadm_id", "left_semi")


def combine_daily(a: DataFrame, b: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Per-day counts of two disjoint id sets added; a day present in either
    keeps its row. Both inputs are calendar-sized."""
    j = a.join(b.select(key, *[F.col(c).alias(f"_b_{c}") for c in counts]), key, "full_outer")
    return j.select(
        key,
        *[(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_b_{c}"), F.lit(0))).alias(c) for c in counts],
    )


def daily_hybrid(
    ev: DataFrame, pred_window: DayWindow, act_window: DayWindow, dup: DataFrame | None = None
) -> DataFrame:
    """Counters of any input at near-sweep cost: stays of ids seen once (and
    NULL ids) by sweep, stays of duplicated ids by the union of their spans."""
    uni, many = split_duplicate_ids(ev, dup=dup)
    return add_daily(daily_sweep(uni, pred_window, act_window), daily_union(many, pred_window, act_window))


def daily_occupancy_hybrid(
    ev: DataFrame, pred_window: DayWindow, act_window: DayWindow, dup: DataFrame | None = None
) -> DataFrame:
    """C14 for any input from :func:`daily_hybrid`."""
    return occupancy_from_sweep(daily_hybrid(ev, pred_window, act_window, dup))


def daily_actual_from_sweep(d: DataFrame) -> DataFrame:
    """``(timeline, n)`` from :func:`daily_sweep` (unique ids) or
    :func:`daily_union` / :func:`daily_hybrid` (any ids) output."""
    return d.where(F.col("u_any") > 0).select(F.col("day").alias("timeline"), F.col("a_cnt").alias("n"))


__all__ = [
    "add_daily",
    "calendar",
    "combine_daily",
    "daily_actual_from_sweep",
    "daily_hybrid",
    "daily_occupancy_by_side_sweep",
    "daily_occupancy_flags",
    "daily_occupancy_hybrid",
    "daily_occupancy_sweep",
    "daily_from_deltas",
    "daily_sweep",
    "daily_union",
    "duplicate_ids",
    "interval_union",
    "lookahead_counts_by_id",
    "presence_flag_pass",
    "presence_flag_rows",
    "split_duplicate_ids",
    "stay_spans",
    "two_timeline_deltas",
]
