"""The batch job: all 22 result files, read back with their schemas, equal
the oracle; the job takes the old timeline from the attached admission date."""

from __future__ import annotations

import tempfile

from pyspark.sql import types as T

from bedcensus.config import FIXTURE, VARIANTS
from bedcensus.plans.job import prepare_inputs, run
from bedcensus.sources import read_result
from compare import assert_same
from conftest import SF_SMALL
from oracle_check import duck
import __spark_entry__ as E

HIST = T.StructType([T.StructField("error", T.LongType()), T.StructField("n", T.LongType())])
YEAR = T.StructType(
    [T.StructField("rn", T.LongType()), T.StructField("timeline", T.DateType()), T.StructField("error", T.LongType())]
)
BED = T.StructType(
    [T.StructField("rn", T.LongType()), T.StructField("day", T.DateType()), T.StructField("n", T.LongType())]
)
LEVEL = T.StructType(
    [T.StructField("rn", T.LongType()), T.StructField("actual_count", T.LongType()), T.StructField("n", T.LongType())]
)


# result file -> (registered query, schema to read it back with)
SUFFIXES = {
    "los_error_diff": ("los_error", HIST),
    "occ": ("lookahead_error", HIST),
    "occupied_error_diff_new": ("occupancy_error_new", HIST),
    "occupied_error_diff_old": ("occupancy_error_old", HIST),
    "occupied_error_within_year_new": ("occupancy_error_year", YEAR),
}
EXTRAS = {"bed_occupancy": ("bed_occupancy_year", BED), "occupancy": ("occupancy_level_frequency", LEVEL)}


def _expected() -> dict[str, tuple[str, T.StructType]]:
    out = dict(EXTRAS)
    for v in VARIANTS:
        prefix = "" if v == "normal" else f"{v}_"
        for suffix, (query, schema) in SUFFIXES.items():
            out[prefix + suffix] = (f"{v}_{query}", schema)
    return out


def test_job_writes_all_results(spark):
    out = tempfile.mkdtemp(prefix="bedcensus-job-")
    written = run(spark, SF_SMALL, out, FIXTURE, "auto")
    expected = _expected()
    assert set(written) == set(expected) and len(written) == 22
    con = duck(SF_SMALL)
    sql = E.oracle_sql()
    for name, path in written.items():
        key, schema = expected[name]
        df = read_result(spark, path, schema)
        assert_same(df, con, sql[key], name)


def test_attached_rebase(spark):
    inputs = prepare_inputs(spark, SF_SMALL)
    assert "_old_match" in inputs.ev.columns
    con = duck(SF_SMALL)
    from bedcensus.config import variant_config
    from bedcensus.plans.variant import Variant

    var = Variant(inputs, variant_config("normal", FIXTURE), "join", ev=inputs.ev)
    assert_same(var.rebased(), con, E.oracle_sql()["rebase_admissions"], "attached rebase")
    var.unpersist()


def test_job_on_prepared_tables(spark):
    """A folder holding ``evaluation`` and ``admissions`` parquet (no orders or
    lineitem) is read as it is, and gives the same results."""
    from bedcensus.sources import load_inputs

    prepared = tempfile.mkdtemp(prefix="bedcensus-prepared-")
    ev, adm = load_inputs(spark, SF_SMALL)
    ev.write.parquet(f"{prepared}/evaluation.parquet")
    adm.write.parquet(f"{prepared}/admissions.parquet")
    out = tempfile.mkdtemp(prefix="bedcensus-job-")
    written = run(spark, prepared, out, FIXTURE, "auto")
    con = duck(SF_SMALL)
    sql = E.oracle_sql()
    for name, (key, schema) in _expected().items():
        assert_same(read_result(spark, written[name], schema), con, sql[key], name)


def test_job_on_prepared_csv(spark):
    """The same tables exported as headered CSV (as a database export would
    be) give the same results."""
    from pyspark.sql import functions as F

    from bedcensus.sources import load_inputs

    prepared = tempfile.mkdtemp(prefix="bedcensus-prepared-csv-")
    ev, adm = load_inputs(spark, SF_SMALL)
    ev.withColumn("admittime", F.date_format("admittime", "yyyy-MM-dd HH:mm:ss")).write.option(
        "header", True
    ).csv(f"{prepared}/evaluation.csv")
    adm.write.option("header", True).csv(f"{prepared}/admissions.csv")
    out = tempfile.mkdtemp(prefix="bedcensus-job-")
    written = run(spark, prepared, out, FIXTURE, "auto")
    con = duck(SF_SMALL)
    sql = E.oracle_sql()
    for name, (key, schema) in _expected().items():
        assert_same(read_result(spark, written[name], schema), con, sql[key], name)


def _run_prepared(spark, ev_rows, adm_rows, params):
    from bedcensus.sources.tables import ADMISSIONS_SCHEMA, EVALUATION_SCHEMA
    from compare import duck_fixture, fixture_oracle

    prepared = tempfile.mkdtemp(prefix="bedcensus-prepared-dup-")
    spark.createDataFrame(ev_rows, EVALUATION_SCHEMA).write.parquet(f"{prepared}/evaluation.parquet")
    spark.createDataFrame(adm_rows, ADMISSIONS_SCHEMA).write.parquet(f"{prepared}/admissions.parquet")
    out = tempfile.mkdtemp(prefix="bedcensus-job-")
    written = run(spark, prepared, out, params, "auto")
    con, sql = duck_fixture(ev_rows, adm_rows), fixture_oracle(params)
    for name, (key, schema) in _expected().items():
        assert_same(read_result(spark, written[name], schema), con, sql[key], name)


def test_job_duplicate_ids_unique_admission_keys(spark):
    """Duplicated stay ids, one admissions row per key: the attach stays."""
    from test_forms_fixtures import DUP_PARAMS, DUP_ROWS, _adm_rows

    _run_prepared(spark, DUP_ROWS, _adm_rows(DUP_ROWS), DUP_PARAMS)


def test_job_repeated_admission_keys(spark):
    """An admissions key given twice: the rebase join repeats those stays,
    so the job falls back to joining per variant."""
    from datetime import date

    from test_forms_fixtures import DUP_PARAMS, DUP_ROWS, _adm_rows

    adm = _adm_rows(DUP_ROWS) + [(2, 11, date(1995, 1, 5))]
    _run_prepared(spark, DUP_ROWS, adm, DUP_PARAMS)


def test_prepare_inputs_branches(spark):
    from datetime import date

    from bedcensus.sources.tables import ADMISSIONS_SCHEMA, EVALUATION_SCHEMA
    from test_forms_fixtures import DUP_ROWS, EDGE_ROWS, _adm_rows

    def prepared(ev_rows, adm_rows):
        d = tempfile.mkdtemp(prefix="bedcensus-prepared-")
        spark.createDataFrame(ev_rows, EVALUATION_SCHEMA).write.parquet(f"{d}/evaluation.parquet")
        spark.createDataFrame(adm_rows, ADMISSIONS_SCHEMA).write.parquet(f"{d}/admissions.parquet")
        return prepare_inputs(spark, d)

    unique = prepared(EDGE_ROWS, _adm_rows(EDGE_ROWS))
    assert "_old_match" in unique.ev.columns and unique.ids_unique() and unique.rebased_ids_unique()
    dup = prepared(DUP_ROWS, _adm_rows(DUP_ROWS))
    assert "_old_match" in dup.ev.columns and not dup.ids_unique()
    repeated = prepared(DUP_ROWS, _adm_rows(DUP_ROWS) + [(2, 11, date(1995, 1, 5))])
    assert "_old_match" not in repeated.ev.columns and not repeated.rebased_ids_unique()
