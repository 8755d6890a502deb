"""Column helpers: rounding (half away from zero, no -0), guarded day spans,
and the md5 uniform draw, which must equal DuckDB's expression."""

from __future__ import annotations

from datetime import date, datetime

import duckdb
from pyspark.sql import functions as F

from bedcensus.functions.columns import day_span, discharge_day, rounded, uniform01
from bedcensus.operators.adjust import row_draw
from bedcensus.oracle import UNIFORM_SQL


def test_rounded_half_away_from_zero(spark):
    vals = [2.5, -2.5, 0.5, -0.5, -0.3, 1.49, 7.125]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.r for r in df.select(rounded("x").alias("r")).collect()]
    assert got == [3, -3, 1, -1, 0, 1, 7]
    assert dict(df.select(rounded("x").alias("r")).dtypes)["r"] == "bigint"


def test_discharge_day_rounds_before_adding(spark):
    df = spark.createDataFrame([(date(1996, 2, 27), 1.5), (date(1996, 2, 27), -2.5)], "a date, los double")
    got = [r.d for r in df.select(discharge_day("a", "los").alias("d")).collect()]
    assert got == [date(1996, 2, 29), date(1996, 2, 24)]


def test_day_span_guard(spark):
    df = spark.createDataFrame(
        [(date(2000, 1, 5), date(2000, 1, 3)), (date(1999, 12, 30), date(2000, 1, 2)), (date(2000, 1, 9), date(2000, 1, 20))],
        "s date, e date",
    )
    spans = [r.d for r in df.select(day_span(F.col("s"), F.col("e"), date(2000, 1, 1), date(2000, 1, 10)).alias("d")).collect()]
    assert spans[0] is None  # start after end: no days, not a descending list
    assert spans[1] == [date(2000, 1, 1), date(2000, 1, 2)]  # clipped low
    assert spans[2] == [date(2000, 1, 9), date(2000, 1, 10)]  # clipped high


def test_row_draw_matches_duckdb(spark):
    rows = [
        (1, 1, datetime(1996, 1, 2), 12.125, 3.25),
        (2, 1, datetime(1996, 1, 2, 10, 30), 0.0, 12.0),
        (3, None, None, -1.5, None),
        (None, 10**9 + 7, datetime(2001, 8, 5), None, 0.5),
    ]
    schema = "hadm_id long, subject_id long, admittime timestamp_ntz, predicted_los double, actual_los double"
    df = spark.createDataFrame(rows, schema)
    got = {r.hadm_id: r.u for r in df.select("hadm_id", row_draw(df).alias("u")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE e (hadm_id BIGINT, subject_id BIGINT, admittime TIMESTAMP, predicted_los DOUBLE, actual_los DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", rows)
    want = dict(con.execute(f"SELECT e.hadm_id, {UNIFORM_SQL} AS u FROM e").fetchall())
    assert got == want and len(set(got.values())) == 4
    assert all(0.0 <= u < 1.0 for u in got.values())


def test_uniform_salt_changes_draw(spark):
    df = spark.createDataFrame([(7,)], "hadm_id long")
    a = df.select(uniform01("hadm_id").alias("u")).first().u
    b = df.select(uniform01("hadm_id", salt="s1").alias("u")).first().u
    assert a != b


def test_uniform_writes_nulls_out(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None)], "a bigint, b bigint")
    got = [r.u for r in df.select(uniform01("a", "b").alias("u")).collect()]
    assert None not in got and len(set(got)) == 3
