"""Property test: on random small tables every applicable form equals the
literal DuckDB oracle (unique ids: all forms; duplicated / NULL ids: the
exact forms)."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from bedcensus.config import VARIANTS, DayWindow, Params, variant_config
from bedcensus.plans.variant import Inputs, Variant
from bedcensus.sources.tables import ADMISSIONS_SCHEMA, EVALUATION_SCHEMA
from compare import assert_same, duck_fixture, fixture_oracle

PARAMS = Params(
    new_window=DayWindow(date(1995, 1, 10), date(1995, 2, 20)),
    old_lo=date(1995, 1, 8),
    old_hi_actual=date(1995, 2, 22),
    old_hi_predicted={
        "normal": date(1995, 2, 22),
        "narrow": date(1995, 2, 20),
        "symmetric": date(1995, 2, 18),
        "symmetric_narrow": date(1995, 2, 20),
    },
    year=1995,
)
BASE = datetime(1995, 1, 1)

los = st.one_of(st.integers(min_value=-6, max_value=40).map(lambda k: k / 4.0), st.none())
stay = st.tuples(
    st.integers(min_value=0, max_value=60),  # admission day offset
    st.sampled_from([0, 13]),  # hour
    los,
    los,
    st.integers(min_value=1, max_value=3),  # subject
)


def _rows(stays, ids):
    out = []
    for (off, hour, p, a, subj), h in zip(stays, ids):
        t = BASE + timedelta(days=off, hours=hour)
        out.append((t, str(t.year), subj, h, p, a))
    return out


def _adm(rows, shift_days):
    seen, out = set(), []
    for r in rows:
        if (r[2], r[3]) not in seen:
            seen.add((r[2], r[3]))
            out.append((r[2], r[3], r[0].date() + timedelta(days=shift_days)))
    return out


def _check(spark, rows, forms_to_check, shift_days):
    ev = spark.createDataFrame(rows, EVALUATION_SCHEMA)
    adm_rows = _adm(rows, shift_days)
    adm = spark.createDataFrame(adm_rows, ADMISSIONS_SCHEMA)
    con = duck_fixture(rows, adm_rows)
    sql = fixture_oracle(PARAMS)
    inputs = Inputs(ev, adm)
    for form in forms_to_check:
        for v in ("normal", "symmetric_narrow"):
            var = Variant(inputs, variant_config(v, PARAMS), form)
            assert_same(var.occupancy_new(), con, sql[f"{v}_daily_occupancy_new"], f"{form}/{v}/new")
            assert_same(var.occupancy_old(), con, sql[f"{v}_daily_occupancy_old"], f"{form}/{v}/old")
            if v == "normal" and form in ("union", "hybrid"):
                assert_same(var.daily_actual(), con, sql["daily_actual_distinct"], f"{form}/{v}/actual")
                assert_same(var.bed_occupancy_year(), con, sql["bed_occupancy_year"], f"{form}/{v}/beds")
            assert_same(var.lookahead_error(), con, sql[f"{v}_lookahead_error"], f"{form}/{v}/look")
            var.unpersist()


SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(stays=st.lists(stay, min_size=1, max_size=25), shift=st.integers(min_value=-3, max_value=3))
def test_unique_ids_all_forms(spark, stays, shift):
    rows = _rows(stays, range(100, 100 + len(stays)))
    _check(spark, rows, ["join", "sweep", "flags", "union"], shift)


@SETTINGS
@given(
    stays=st.lists(stay, min_size=1, max_size=25),
    ids=st.lists(st.one_of(st.none(), st.integers(min_value=1, max_value=5)), min_size=25, max_size=25),
    shift=st.integers(min_value=-3, max_value=3),
)
def test_duplicate_ids_exact_forms(spark, stays, ids, shift):
    rows = _rows(stays, ids)
    _check(spark, rows, ["join", "flags", "union", "hybrid"], shift)


assert set(VARIANTS) >= {"normal", "symmetric_narrow"}
