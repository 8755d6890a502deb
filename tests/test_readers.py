"""The readers: columns by name, dates from timestamps, nothing lost silently;
the job's default dates and its clean-up; the constants of the parameter sets."""

from __future__ import annotations

import os
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bedcensus.config import FIXTURE, REFERENCE, variant_config
from bedcensus.functions.columns import los_error
from bedcensus.operators import adjust as A
from bedcensus.plans.job import prepare_inputs, run
from bedcensus.plans.variant import Inputs, Variant
from bedcensus.session import scratch_paths
from bedcensus.sources import load_inputs, read_admissions, read_evaluation

EV = "admittime timestamp_ntz, anchor_year_group string, subject_id bigint, hadm_id bigint, predicted_los double, actual_los double"


def stays(spark, n=40, year=1972):
    return spark.range(n).select(
        F.expr(f"timestamp_ntz '{year}-03-01 10:30:00' + make_dt_interval(cast(id % 20 as int))").alias("admittime"),
        F.lit("1970 - 1975").alias("anchor_year_group"),
        (F.col("id") % 7).alias("subject_id"),
        F.col("id").alias("hadm_id"),
        (F.col("id") % 9 / 2).alias("predicted_los"),
        (F.col("id") % 5 / 1).alias("actual_los"),
    )


def admissions(ev):
    return ev.select("subject_id", "hadm_id", F.expr("admittime + make_ym_interval(160)").alias("admittime"))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "string"])
def test_admissions_parquet_types(spark, tmp_path, kind):
    adm = admissions(stays(spark)).withColumn("admittime", F.col("admittime").cast(kind))
    adm.write.parquet(f"{tmp_path}/a.parquet")
    got = read_admissions(spark, f"{tmp_path}/a.parquet")
    assert got.schema["admittime"].dataType.simpleString() == "date"
    assert got.where("admittime is null").count() == 0
    assert got.agg(F.min("admittime")).first()[0] == date(2132, 3, 1)


def test_csv_with_time_of_day_reordered_and_extra_columns(spark, tmp_path):
    path = f"{tmp_path}/a.csv"
    with open(path, "w") as f:
        f.write("deathtime,HADM_ID,admittime,subject_id\n,11,2150-01-02 23:59:00,5\nx,12,2150-01-03,\n,13,,6\n")
    rows = {r.hadm_id: (r.subject_id, r.admittime) for r in read_admissions(spark, path, "csv").collect()}
    assert rows == {11: (5, date(2150, 1, 2)), 12: (None, date(2150, 1, 3)), 13: (6, None)}


def test_missing_column_and_bad_value_raise(spark, tmp_path):
    with open(f"{tmp_path}/m.csv", "w") as f:
        f.write("subject_id,admittime\n1,2150-01-01\n")
    with pytest.raises(ValueError, match="missing column.*hadm_id"):
        read_admissions(spark, f"{tmp_path}/m.csv", "csv")
    with open(f"{tmp_path}/b.csv", "w") as f:
        f.write("subject_id,hadm_id,admittime\n1,2,first of May\n")
    with pytest.raises(PySparkException, match="cannot read as"):
        read_admissions(spark, f"{tmp_path}/b.csv", "csv").collect()
    stays(spark).drop("actual_los").write.parquet(f"{tmp_path}/e.parquet")
    with pytest.raises(ValueError, match="actual_los"):
        read_evaluation(spark, f"{tmp_path}/e.parquet")


def test_one_prepared_table_or_two_formats_raise(spark, tmp_path):
    ev = stays(spark)
    ev.write.parquet(f"{tmp_path}/evaluation.parquet")
    with pytest.raises(ValueError, match="both needed"):
        load_inputs(spark, str(tmp_path))
    admissions(ev).write.option("header", True).csv(f"{tmp_path}/admissions.csv")
    with pytest.raises(ValueError, match="both needed"):
        load_inputs(spark, str(tmp_path))


def persisted(spark):
    return set(spark.sparkContext._jsc.getPersistentRDDs().keySet())


def test_job_defaults_to_the_study_for_prepared_tables_and_cleans_up(spark, tmp_path, capsys):
    ev = stays(spark)
    ev.write.parquet(f"{tmp_path}/in/evaluation.parquet")
    admissions(ev).write.parquet(f"{tmp_path}/in/admissions.parquet")
    before, held = set(scratch_paths()), persisted(spark)
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    for name in ("occ", "occupied_error_diff_new", "occupied_error_within_year_new"):
        assert spark.read.csv(f"{tmp_path}/out/normal/{name}.csv").count() > 0, name
    assert spark.read.csv(f"{tmp_path}/out/extra/bed_occupancy.csv").count() > 0
    assert set(scratch_paths()) == before
    assert persisted(spark) <= held  # what other tests hold may go meanwhile
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out2", FIXTURE)
    assert "40 of 40 stays are admitted outside" in capsys.readouterr().err


def test_scratch_folder_is_empty_after_a_run(spark, tmp_path):
    ev = stays(spark)
    ev.union(ev).write.parquet(f"{tmp_path}/in/evaluation.parquet")  # repeated ids take every path
    admissions(ev).write.parquet(f"{tmp_path}/in/admissions.parquet")
    base = os.path.dirname(scratch_paths()[-1]).removeprefix("file:") if scratch_paths() else None
    held = set(os.listdir(base)) if base else set()
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    if base:
        assert set(os.listdir(base)) <= held


def test_sweep_is_refused_on_repeated_ids(spark):
    ev = stays(spark)
    twice = Inputs(ev.union(ev), admissions(ev))
    with pytest.raises(ValueError, match="hadm_id repeats"):
        Variant(twice, variant_config("normal", REFERENCE), "sweep").occupancy_new()


@pytest.mark.parametrize("key", ["hadm_id", "null"])
def test_draws_of_one_id_or_none_are_one_per_row(spark, key):
    n = 4000
    ev = spark.range(n).select(
        F.expr("timestamp_ntz '1972-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("admittime"),
        F.lit("g").alias("anchor_year_group"),
        F.lit(1).cast("bigint").alias("subject_id"),
        (F.lit(7) if key == "hadm_id" else F.lit(None)).cast("bigint").alias("hadm_id"),
        F.lit(1.0).alias("predicted_los"),
        F.lit(5.0).alias("actual_los"),
    )
    shift = spark.createDataFrame([(4, 0.5)], "error bigint, prob double")
    moved = A.symmetrise(ev, shift).where(los_error() == -4).count()
    assert abs(moved / n - 0.5) < 0.05
    same = A.number_copies(ev.withColumn("admittime", F.lit(None).cast("timestamp_ntz")))
    assert abs(A.symmetrise(same, shift).where(los_error() == -4).count() / n - 0.5) < 0.05


def test_identical_rows_are_numbered_in_the_job(spark, tmp_path):
    ev = stays(spark)
    ev.union(ev.where("hadm_id < 10")).write.parquet(f"{tmp_path}/evaluation.parquet")
    admissions(ev).write.parquet(f"{tmp_path}/admissions.parquet")
    base = prepare_inputs(spark, str(tmp_path)).ev
    numbered = base.where(f"{A.COPY_COLUMN} is not null").select("hadm_id", A.COPY_COLUMN).collect()
    assert len(numbered) == len({r[1] for r in numbered}) == 20 and {r[0] for r in numbered} == set(range(10))
    assert base.count() == 50


def test_study_constants():
    """Values of SURVEY 2.1.1, written out here a second time."""
    assert (REFERENCE.new_window.lo, REFERENCE.new_window.hi) == (date(1970, 1, 1), date(1982, 1, 1))
    assert REFERENCE.old_lo == date(2110, 1, 11) and REFERENCE.old_hi_actual == date(2212, 4, 12)
    days = {v: REFERENCE.old_hi_predicted[v].day for v in REFERENCE.old_hi_predicted}
    assert days == {"normal": 12, "narrow": 10, "symmetric": 8, "symmetric_narrow": 10}
    assert {(d.year, d.month) for d in REFERENCE.old_hi_predicted.values()} == {(2212, 4)}
    for params in (REFERENCE, FIXTURE):
        cfgs = {v: variant_config(v, params) for v in days}
        assert {c.lookahead_days for c in cfgs.values()} == {3} and {c.inflow for c in cfgs.values()} == {92}
        assert {c.error_threshold for c in cfgs.values()} == {2}
        assert [v for v, c in cfgs.items() if c.old_shape == "by_side"] == ["normal"]
    assert REFERENCE.year == 1972
