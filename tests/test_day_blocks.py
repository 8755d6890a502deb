"""Days held as sets of bits per block of 63 days: the same rows, and no
shuffle or aggregate with a row per stay-day."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta

import pytest

from bedcensus.config import DayWindow, Params, variant_config
from bedcensus.operators import lookahead as L
from bedcensus.operators import occupancy as O
from bedcensus.plans import forms
from bedcensus.plans.variant import Inputs, Variant
from bedcensus.sources.tables import ADMISSIONS_SCHEMA, EVALUATION_SCHEMA
from compare import assert_same, duck_fixture, fixture_oracle

# days before and after 1970, and a look-ahead longer than a block
WINDOW = DayWindow(date(1969, 10, 20), date(1970, 7, 9))
PARAMS = Params(
    new_window=WINDOW,
    old_lo=WINDOW.lo,
    old_hi_actual=WINDOW.hi,
    old_hi_predicted=dict.fromkeys(("normal", "narrow", "symmetric", "symmetric_narrow"), WINDOW.hi),
    year=1970,
    lookahead_days=70,
)


def _rows(n: int = 60, seed: int = 3):
    rnd = random.Random(seed)
    ids = [None, 1, 1, 2, 3, 4]
    lengths = [None, -2.0, 0.0, 0.5, 3.0, 7.25, 62.0, 63.0, 64.0, 130.0]
    return [
        (datetime(1969, 10, 1) + timedelta(days=rnd.randrange(280), hours=13 * (k % 2)), "1970", k % 3, rnd.choice(ids), rnd.choice(lengths), rnd.choice(lengths))
        for k in range(n)
    ]


@pytest.fixture(scope="module")
def stays(spark):
    rows = _rows()
    adm = sorted({(r[2], r[3], r[0].date()) for r in rows if r[3] is not None})
    inputs = Inputs(spark.createDataFrame(rows, EVALUATION_SCHEMA), spark.createDataFrame(adm, ADMISSIONS_SCHEMA))
    return inputs, duck_fixture(rows, adm), fixture_oracle(PARAMS)


def _variant(stays, form):
    return Variant(stays[0], variant_config("normal", PARAMS), form, persist=False)


def _exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("form", ["join", "flags"])
def test_rows_across_blocks(stays, form):
    """Long, empty and unknown stays, ids that repeat or are missing."""
    _, con, sql = stays
    var = _variant(stays, form)
    assert_same(var.occupancy_new(), con, sql["normal_daily_occupancy_new"], "occupancy")
    assert_same(var.lookahead_error(), con, sql["normal_lookahead_error"], "look-ahead")
    if form == "join":
        assert_same(var.timeline_new(), con, sql["presence_timeline"], "timeline")


def test_lookahead_rows_are_counted_not_joined(spark):
    """equal rows meet before the join and are told by their number."""
    day = date(1995, 5, 1)
    flags = spark.createDataFrame(
        [(day + timedelta(days=d), day, 7, k % 2 == 0, True) for d in (0, 3) for k in range(20)],
        "timeline date, admittime date, hadm_id bigint, predicted boolean, actual boolean",
    )
    counted = L.lookahead_presence(flags, 3, counted=True)
    got = {(r["time"], r["predicted"]): r["copies"] for r in counted.collect()}
    later = day + timedelta(days=3)
    assert got == {(day, True): 200, (day, False): 200, (later, None): 20}
    rows = L.lookahead_presence(flags, 3)
    assert rows.columns == ["time", "predicted"] and rows.count() == 420
    per_day = [sorted(map(tuple, L.lookahead_daily(df).collect())) for df in (counted, rows)]
    assert per_day[0] == per_day[1] == [(day, 400), (later, 0)]


def test_timeline_is_shuffled_by_block(stays):
    """the timeline's shuffles have a row per stay and block, not per day."""
    keys = _exchanges(_variant(stays, "join").timeline_new())
    assert keys and all("block_day#" in k for k in keys)


def test_flag_pass_groups_by_block(stays):
    """F2, F8."""
    ev = stays[0].ev
    keys = _exchanges(forms.presence_flag_pass(ev, WINDOW, WINDOW))
    assert len(keys) == 1 and "block_day#" in keys[0]


def test_aligned_sides_are_shuffled_by_block(stays):
    """F3, F4."""
    var = _variant(stays, "join")
    keys = _exchanges(O.align_presence(var.predicted_new(), var.actual_new()))
    assert len(keys) == 2 and all("block_day#" in k for k in keys)


def test_counts_by_id_need_no_join_of_days(stays):
    """F6, F7."""
    df = forms.lookahead_counts_by_id(stays[0].ev, WINDOW, 3)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    keys = _exchanges(df)
    assert keys[0].startswith("time#") and len(keys) == 3 and all("block_day#" in k for k in keys[1:])


def test_islands_are_not_aggregated(spark):
    """only the latest ends are aggregated; islands are found in passing."""
    days = [(1, 0, 2), (1, 1, 1), (1, 3, 5), (1, 7, 6), (1, 8, 8), (1, 10, 20), (1, 11, 12), (1, 21, 21), (None, 4, 4), (2, 9, None)]
    lo = date(1995, 1, 1)
    spans = spark.createDataFrame(
        [(k, lo + timedelta(days=s), None if e is None else lo + timedelta(days=e)) for k, s, e in days], "k int, s date, e date"
    )
    union = forms.interval_union(spans, ["k"])
    plan = union._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"HashAggregate\(", plan)) == 2
    got = {(r["k"], (r["s"] - lo).days, (r["e"] - lo).days) for r in union.collect()}
    assert got == {(1, 0, 5), (1, 8, 8), (1, 10, 21), (None, 4, 4)}
