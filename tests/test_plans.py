"""Physical-plan properties: no nested-loop or cartesian joins anywhere, the
sweep shuffles only calendar-sized data, filters and column pruning reach the
scans, and the shift table is broadcast instead of shuffling evaluation."""

from __future__ import annotations

import re
from functools import lru_cache

import pytest

from bedcensus import catalog
from bedcensus.config import FIXTURE, variant_config
from bedcensus.plans.variant import Inputs, Variant
from bedcensus.sources import admissions_from_evaluation, evaluation_from_orders
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning\([^)]*\))", plan)


@pytest.fixture(scope="module")
def queries():
    """The registered queries over one written base table a source, to save time."""
    with pytest.MonkeyPatch.context() as m:
        for name in ("_inputs", "_repeated_inputs"):
            m.setattr(catalog, name, lru_cache(getattr(catalog, name)))
        yield catalog.queries()


def test_no_nested_loop_or_cartesian(spark, queries):
    for name, fn in queries.items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_sweep_shuffles_only_days(spark, queries):
    plan = _plan(queries["daily_occupancy_sweep"](spark, SF_SMALL))
    for ex in _exchanges(plan):
        # the per-day deltas (day) and the calendar-sized running-sum window
        assert ex == "SinglePartition" or re.match(r"hashpartitioning\(day#", ex), ex
    assert "Generate" in plan and "SortMergeJoin" not in plan


def test_derivation_shuffles_once_by_order_key(spark):
    plan = _plan(evaluation_from_orders(spark, SF_SMALL))
    assert all("orderkey" in ex for ex in _exchanges(plan))
    assert plan.count("SortMergeJoin") == 1
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    read = re.search(r"ReadSchema: struct<([^>]*)>", orders).group(1)
    assert {c.split(":")[0] for c in read.split(",")} <= {"o_orderkey", "o_orderdate", "o_custkey"}
    lineitem = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    read = re.search(r"ReadSchema: struct<([^>]*)>", lineitem).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"l_orderkey", "l_quantity"}


def test_stay_filter_and_pruning_reach_the_scan(spark, queries):
    plan = _plan(queries["normal_occupancy_error_new"](spark, SF_SMALL))
    scan = next(line for line in plan.splitlines() if "Scan parquet" in line)
    assert "LessThan(admittime" in scan
    read = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"admittime", "hadm_id", "predicted_los", "actual_los"}


def _base(spark):
    ev = evaluation_from_orders(spark, SF_SMALL)
    return Inputs(ev, admissions_from_evaluation(ev)).declare_unique()


def test_bed_occupancy_from_the_sweep_or_one_year(spark):
    """With unique ids no stay becomes its days; otherwise the focus year bounds the scan."""
    cfg = variant_config("normal", FIXTURE)
    sweep = _plan(Variant(_base(spark), cfg, persist=False).bed_occupancy_year())
    assert "sequence" not in sweep
    other = _plan(Variant(_base(spark), cfg, "flags", persist=False).bed_occupancy_year())
    assert f"{FIXTURE.year + 1}-01-01" in next(line for line in other.splitlines() if "orders.parquet" in line)


def test_size_check_has_no_single_partition_exchange(spark):
    """Counting a written table leaves one partial count per task; no rows meet."""
    from bedcensus.session import broadcast_if_bounded

    kept = broadcast_if_bounded(spark.range(1000).select("id"), 10)
    plan = _plan(kept)
    assert not _exchanges(plan) and "Limit" not in plan


def test_shift_table_is_broadcast(spark, queries):
    plan = _plan(queries["symmetrise"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan
    # evaluation is never shuffled on the error key
    assert not any("_err" in ex for ex in _exchanges(plan))


def test_flag_pass_has_no_join_on_stay_days(spark, queries):
    """One explode and one shuffle for the group-by on (day, id): no join."""
    plan = _plan(queries["daily_occupancy_flag_pass"](spark, SF_SMALL))
    assert "SortMergeJoin" not in plan
    for ex in _exchanges(plan):
        assert "timeline#" in ex or ("day#" in ex and "hadm_id#" in ex), ex


@pytest.mark.parametrize("name", ["repeated_occupancy_auto", "repeated_occupancy_old_auto", "repeated_bed_occupancy", "repeated_daily_actual_distinct"])
def test_repeated_ids_expand_no_stay_into_days(spark, queries, name):
    """Only span events are generated, and the spans of an id are shuffled by
    (id, side, start) before (id, side), so a hot id is spread over its days."""
    plan = _plan(queries[name](spark, SF_SMALL))
    assert "sequence(" not in plan
    by_id = [ex for ex in _exchanges(plan) if "side#" in ex]
    assert any(re.search(r"hadm_id#\d+L?, side#\d+, s#", ex) for ex in by_id) and len(by_id) == 2


def test_one_hot_id_is_spread_and_merged(spark):
    """An id with nearly all rows: at most one row per side and start day meets in a task."""
    from bedcensus.plans import forms

    spans = spark.range(200_000).selectExpr(
        "if(id % 50 = 0, id, 7) as hadm_id", "date_add(date'2000-01-01', cast(id * 37 % 400 as int)) as s", "date_add(date'2000-01-01', cast(id * 37 % 400 + id % 3 - 1 as int)) as e"
    )
    union = forms.interval_union(spans, ["hadm_id"])
    hot = [(str(r["s"]), str(r["e"])) for r in union.where("hadm_id = 7").collect()]
    assert hot == [("2000-01-02", "2001-02-04")]  # days 1 to 400
    lone = union.where("hadm_id <> 7")
    assert lone.count() == spans.where("hadm_id <> 7 and s <= e").select("hadm_id").distinct().count()
