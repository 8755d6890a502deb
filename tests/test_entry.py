"""The driver contract: entry, the query registry and the oracle SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from bedcensus import catalog
from bedcensus.oracle import oracle_queries
from compare import assert_same
from conftest import SF_SMALL
from oracle_check import duck


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["rn", "timeline", "error"]
    rows = df.collect()
    assert len(rows) == 366


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracle_queries())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_query_names_are_plain():
    for name in E.queries():
        assert name.replace("_", "").isalnum()


@pytest.mark.parametrize(
    "name",
    [
        "normal_los_error",
        "symmetric_occupancy_error_new",
        "narrow_occupancy_error_old",
        "normal_daily_occupancy_old",
        "symmetric_narrow_lookahead_error",
        "occupancy_level_frequency",
        "bed_occupancy_year",
        "csv_roundtrip",
        "lookahead_error_by_id_counts",
    ],
)
def test_registered_query_matches_oracle_small(spark, name):
    con = duck(SF_SMALL)
    df = E.queries()[name](spark, SF_SMALL)
    assert_same(df, con, E.oracle_sql()[name], name)


def test_fixture_sizes(spark):
    """Sizes stated for sf0.001 in FIXTURES.md."""
    q = E.queries()
    assert q["predicted_stay_days"](spark, SF_SMALL).count() == 10221
    assert q["actual_stay_days"](spark, SF_SMALL).count() == 15934
    assert q["normal_daily_occupancy_new"](spark, SF_SMALL).count() == 2406
    assert q["normal_daily_occupancy_old"](spark, SF_SMALL).count() == 13445
    assert os.path.isdir(SF_SMALL)
