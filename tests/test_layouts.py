"""Stored layouts: co-located joins without a shuffle, months pruned by the window."""

from __future__ import annotations

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bedcensus import operators as O
from bedcensus.config import VARIANTS, DayWindow, Params, variant_config
from bedcensus.operators import stays as S
from bedcensus.plans import Inputs, Variant
from bedcensus.plans.variant import keys_unique
from bedcensus.sources import layout as L
from bedcensus.sources import load_inputs, read_layout
from bedcensus.sources.tables import ADMISSIONS_SCHEMA, EVALUATION_SCHEMA
from compare import assert_same, duck_fixture, fixture_oracle

PARAMS = Params(
    new_window=DayWindow(date(1996, 3, 1), date(1996, 6, 30)),
    old_lo=date(1996, 3, 1),
    old_hi_actual=date(1996, 6, 30),
    old_hi_predicted={v: date(1996, 6, 28) for v in VARIANTS},
    year=1996,
)

ROWS = [
    (datetime(1994, 1, 5), "1994", 1, 1, 2.0, 900.0),  # reaches the window from two years before
    (datetime(1994, 1, 6), "1994", 1, 2, 2.0, 3.0),  # its month is read for the row above
    (datetime(1995, 2, 1), "1995", 2, 3, 2.0, 3.0),  # a month that cannot touch the window
    (datetime(1995, 12, 30, 22), "1995", 2, 4, 0.0, 31.4),  # mirrored: 63 days
    (datetime(1996, 2, 28), "1996", 3, 5, 2.4, 1.6),
    (datetime(1996, 3, 31), "1996", 3, 6, None, 40.0),
    (datetime(1996, 6, 30), "1996", 4, 7, 0.0, 0.0),
    (datetime(1996, 7, 1), "1996", 4, 8, 9.0, 9.0),  # after the window
    (datetime(1996, 8, 1), "1996", 5, 9, -3.0, None),
    (None, None, 5, 10, 4.0, 4.0),
    (datetime(1990, 5, 1), "1990", 6, None, 1.0, 1e7),  # too long to track: its month is always read
]


def _adm(rows):
    return [(r[2], r[3], r[0].date() if r[0] else None) for r in rows if r[3] is not None]


def _frames(spark, rows=ROWS):
    return spark.createDataFrame(rows, EVALUATION_SCHEMA), spark.createDataFrame(_adm(rows), ADMISSIONS_SCHEMA)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _stored(spark, folder):
    return Inputs(*load_inputs(spark, folder), layout=read_layout(spark, folder))


def test_bucketed_join_has_no_exchange(spark, tmp_path):
    ev, adm = _frames(spark)
    big = spark.range(4000).selectExpr(
        "timestamp_ntz'1996-03-01 00:00:00' as admittime", "'1996' as anchor_year_group", "id % 900 as subject_id", "id + 1000 as hadm_id",
        "cast(id % 9 as double) as predicted_los", "cast(id % 7 as double) as actual_los",
    )
    ev = ev.union(big)
    adm = adm.union(big.select("subject_id", "hadm_id", F.to_date("admittime")))
    assert L.write_bucketed(ev, adm, f"{tmp_path}", 8) == {"buckets": 8}
    stored = _stored(spark, f"{tmp_path}")
    for joined, plain in (
        (S.rebase_admissions(stored.ev, stored.adm), S.rebase_admissions(ev, adm)),
        (S.attach_old_admission(stored.ev, stored.adm), S.attach_old_admission(ev, adm)),
    ):
        plan = _plan(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        assert sorted(map(repr, joined.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
    ids = stored.adm.groupBy("subject_id", "hadm_id").count()
    assert "Exchange" not in _plan(ids)
    assert keys_unique(stored.adm, ["subject_id", "hadm_id"])
    # written again with other buckets: readers follow the layout
    L.write_bucketed(ev, adm, f"{tmp_path}", 3)
    again = _stored(spark, f"{tmp_path}")
    assert again.layout == {"buckets": 3} and again.ev.count() == ev.count()
    assert "Exchange" not in _plan(S.rebase_admissions(again.ev, again.adm))


def test_a_hot_key_is_stored_plain(spark, tmp_path):
    hot = spark.range(3000).selectExpr(
        "timestamp_ntz'1996-03-01 00:00:00' as admittime", "'1996' as anchor_year_group", "1L as subject_id", "if(id < 1500, 7, id) as hadm_id",
        "1.0D as predicted_los", "2.0D as actual_los",
    )
    adm = spark.createDataFrame([(1, 7, date(1996, 3, 1))], ADMISSIONS_SCHEMA)
    assert L.write_bucketed(hot, adm, f"{tmp_path}", 16, skew_min_rows=100) == {"buckets": 0}
    stored = _stored(spark, f"{tmp_path}")
    assert S.rebase_admissions(stored.ev, stored.adm).count() == 1500


@pytest.mark.parametrize("variant", list(VARIANTS))
def test_dated_results_equal_the_oracle(spark, tmp_path, variant):
    ev, adm = _frames(spark)
    L.write_dated(ev, adm, f"{tmp_path}")
    stored = _stored(spark, f"{tmp_path}")
    con, sql = duck_fixture(ROWS, _adm(ROWS)), fixture_oracle(PARAMS)
    for form in ("sweep", "flags", "union"):
        var = Variant(stored, variant_config(variant, PARAMS), form, persist=False)
        assert_same(var.occupancy_new(), con, sql[f"{variant}_daily_occupancy_new"], f"{form}/new")
        assert_same(var.los_error(), con, sql[f"{variant}_los_error"], f"{form}/los")
    assert set(var.evaluation().columns) == set(EVALUATION_SCHEMA.names)
    if variant == "normal":
        assert_same(var.predicted_new(), con, sql["predicted_stay_days"], "predicted")
        assert_same(Variant(stored, variant_config("normal", PARAMS), "flags", persist=False).bed_occupancy_year(), con, sql["bed_occupancy_year"], "beds")


def test_the_window_prunes_months(spark, tmp_path):
    ev, adm = _frames(spark)
    layout = L.write_dated(ev, adm, f"{tmp_path}")
    assert L.months_within(layout, PARAMS.new_window) == [199005, 199401, 199512, 199602, 199603, 199606]
    stored = _stored(spark, f"{tmp_path}")
    assert stored.ev.count() == len(ROWS)  # without a window nothing is left out
    for variant in ("normal", "symmetric"):
        plan = _plan(Variant(stored, variant_config(variant, PARAMS), "union", persist=False).occupancy_new())
        scans = [s for s in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "admit_month" in s]
        assert scans and all("199512" in s and "199502" not in s for s in scans)
    read = {f.split("admit_month=")[1].split("/")[0] for f in L.within(stored.ev, layout, PARAMS.new_window).inputFiles() if "admit_month=" in f}
    assert "199607" in read or len(read) >= 6  # inputFiles lists the table; the pruning is in the plan
    assert L.within(ev, layout, PARAMS.new_window) is ev  # a plain table has no months


def test_reach_bounds_every_variant(spark):
    """No rounded length of any variant passes the stored last day."""
    pairs = [(p / 4, a / 4) for p in range(-20, 60, 3) for a in range(-8, 60, 3)]
    rows = [(datetime(1996, 3, 1, 23), "x", 1, i, p, a) for i, (p, a) in enumerate(pairs)]
    ev = spark.createDataFrame(rows, EVALUATION_SCHEMA)
    error = F.round(F.col("actual_los") - F.col("predicted_los"))
    mirrored = ev.withColumn("predicted_los", F.col("predicted_los") + 2 * error)
    for table in (ev, mirrored, O.halve_error(ev), O.halve_error(mirrored)):
        reach = ev.select("hadm_id", L.last_reach().alias("last")).join(table, "hadm_id")
        for los in ("predicted_los", "actual_los"):
            late = reach.where(F.date_add(F.to_date("admittime"), F.round(los).cast("int")) > F.col("last"))
            assert late.count() == 0


def test_a_large_month_is_dealt_into_files(spark, tmp_path):
    ev = spark.range(2000).selectExpr(
        "timestamp_ntz'1996-03-01 00:00:00' as admittime", "'1996' as anchor_year_group", "1L as subject_id", "id as hadm_id",
        "1.0D as predicted_los", "2.0D as actual_los",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these partitions are tiny
    try:
        L.write_dated(ev, spark.createDataFrame([], ADMISSIONS_SCHEMA), f"{tmp_path}", rows_per_file=300)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = _stored(spark, f"{tmp_path}")
    assert stored.ev.count() == 2000 and len(stored.ev.inputFiles()) >= 4
    L.write_dated(ev.limit(0), spark.createDataFrame([], ADMISSIONS_SCHEMA), f"{tmp_path}/none")
    empty = _stored(spark, f"{tmp_path}/none")
    assert Variant(empty, variant_config("normal", PARAMS), "sweep", persist=False).occupancy_new().count() == 0
