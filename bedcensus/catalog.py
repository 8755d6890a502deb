"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the test tables of ``sf_dir`` (``orders`` and ``lineitem``
through :func:`bedcensus.sources.load_inputs`) and runs over all of them.
Per-variant results use the automatic form choice; the ``*_form`` /
``*_sweep`` / ``*_flag_pass`` / ``*_counts`` entries force one physical form
so that each is checked against the same oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedcensus.config import FIXTURE, VARIANTS, variant_config
from bedcensus.operators import adjust as A
from bedcensus.operators import lookahead as L
from bedcensus.operators import occupancy as O
from bedcensus.operators.stays import rebase_admissions
from bedcensus.oracle import JOB_HISTOGRAMS, short_predictions
from bedcensus.plans import forms
from bedcensus.plans.job import run
from bedcensus.plans.variant import Inputs, Variant
from bedcensus.session import materialize, scratch_path
from bedcensus.sources import (
    admissions_from_evaluation,
    evaluation_from_orders,
    load_inputs,
    read_layout,
    read_result,
    write_bucketed,
    write_dated,
    write_result,
)
from bedcensus.sources.tables import evaluation_from_lineitem

Query = Callable[[SparkSession, str], DataFrame]

PARAMS = FIXTURE


def _inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """One written base table per query: key checks, the shift table and the
    result read it instead of deriving it again."""
    ev = materialize(evaluation_from_orders(spark, sf_dir), "evaluation")
    return Inputs(ev, admissions_from_evaluation(ev))


def _repeated_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """Line items as stays: a supplier's id repeats, one in five is missing."""
    ev = materialize(evaluation_from_lineitem(spark, sf_dir), "evaluation_repeated")
    return Inputs(ev, admissions_from_evaluation(ev))


def _variant(spark: SparkSession, sf_dir: str, name: str, form: str = "auto", params=PARAMS, inputs=None) -> Variant:
    # one result per query: nothing to share, so nothing is persisted
    return Variant((inputs or _inputs)(spark, sf_dir), variant_config(name, params), form, persist=False)


def _per_variant(name: str) -> dict[str, Query]:
    return {
        f"{name}_los_error": lambda s, d: _variant(s, d, name).los_error(),
        f"{name}_daily_occupancy_new": lambda s, d: _variant(s, d, name).occupancy_new(),
        f"{name}_daily_occupancy_old": lambda s, d: _variant(s, d, name).occupancy_old(),
        f"{name}_occupancy_error_new": lambda s, d: _variant(s, d, name).occupancy_error_new(),
        f"{name}_occupancy_error_old": lambda s, d: _variant(s, d, name).occupancy_error_old(),
        f"{name}_occupancy_error_year": lambda s, d: _variant(s, d, name).occupancy_error_year(),
        f"{name}_lookahead_error": lambda s, d: _variant(s, d, name).lookahead_error(),
    }


def _normal(s: SparkSession, d: str, form: str = "auto") -> Variant:
    return _variant(s, d, "normal", form)


def _tail_counts(s: SparkSession, d: str) -> DataFrame:
    return A.tail_error_counts(_inputs(s, d).ev)


def _shift(s: SparkSession, d: str) -> DataFrame:
    return A.shift_probability(A.tail_error_counts(_inputs(s, d).ev))


def _symmetrise(s: SparkSession, d: str) -> DataFrame:
    return A.symmetric_evaluation(_inputs(s, d).ev)


def _csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """C26 + C24: write the normal LOS histogram as headerless CSV under the
    checkpoint folder and read it back with its schema."""
    df = _normal(s, d).los_error()
    path = scratch_path(s, "los_error_diff.csv")
    write_result(df, path, ["error"])
    return read_result(s, path, df.schema)


def _csv_roundtrip_null(s: SparkSession, d: str) -> DataFrame:
    """C26 with a NULL error: the old occupancy error where predictions end
    half-way."""
    df = _variant(s, d, "normal", params=short_predictions(PARAMS)).occupancy_error_old()
    path = scratch_path(s, "occupied_error_diff_old.csv")
    write_result(df, path, ["error"])
    return read_result(s, path, df.schema)


def _prepared_roundtrip(s: SparkSession, d: str, fmt: str) -> DataFrame:
    """The derived tables written in the prepared layout
    (admissions with a time of day, columns in another order), read back."""
    base = _inputs(s, d)
    folder = scratch_path(s, "prepared")
    adm = base.adm.select(
        F.expr("cast(admittime as timestamp_ntz) + interval '13:45' hour to minute").alias("admittime"), "hadm_id", "subject_id"
    )
    for name, df in (("evaluation", base.ev.select(*reversed(base.ev.columns))), ("admissions", adm)):
        path = f"{folder}/{name}.{fmt}"
        df.write.parquet(path) if fmt == "parquet" else df.write.option("header", True).csv(path)
    ev, adm = load_inputs(s, folder)
    return rebase_admissions(ev, adm)


#: Buckets of the bucketed test layout.
TEST_BUCKETS = 8


def _bucketed_inputs(s: SparkSession, d: str) -> Inputs:
    """The derived tables stored bucketed by the join keys and read back."""
    base = _inputs(s, d)
    folder = scratch_path(s, "bucketed")
    write_bucketed(base.ev, base.adm, folder, TEST_BUCKETS)
    return Inputs(*load_inputs(s, folder), layout=read_layout(s, folder))


def _dated_inputs(s: SparkSession, d: str) -> Inputs:
    """The derived tables stored by admission month and read back."""
    base = _inputs(s, d)
    folder = scratch_path(s, "dated")
    write_dated(base.ev, base.adm, folder)
    return Inputs(*load_inputs(s, folder), layout=read_layout(s, folder))


def _bucketed_rebase(s: SparkSession, d: str) -> DataFrame:
    stored = _bucketed_inputs(s, d)
    return rebase_admissions(stored.ev, stored.adm)


def _job_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Run the whole job, read the histograms it wrote back."""
    out = scratch_path(s, "job")
    paths = run(s, d, out, PARAMS)
    files = {"los_error": "los_error_diff", "occupancy_error_new": "occupied_error_diff_new"}
    files |= {"occupancy_error_old": "occupied_error_diff_old", "lookahead_error": "occ"}
    schema = T.StructType([T.StructField("error", T.LongType()), T.StructField("n", T.LongType())])
    tables = [
        read_result(s, paths[files[r] if v == "normal" else f"{v}_{files[r]}"], schema).select(
            F.lit(f"{v}_{r}").alias("result"), "error", "n"
        )
        for v in VARIANTS
        for r in JOB_HISTOGRAMS
    ]
    return reduce(DataFrame.union, tables)


def _repeated_queries() -> dict[str, Query]:
    def variant(s, d, form="auto", name="normal"):
        return _variant(s, d, name, form, inputs=_repeated_inputs)

    q: dict[str, Query] = {
        "repeated_occupancy_by_side": lambda s, d: variant(s, d).occupancy_old(),
        "repeated_symmetrise": lambda s, d: A.symmetric_evaluation(_repeated_inputs(s, d).ev),
        "repeated_bed_occupancy": lambda s, d: variant(s, d).bed_occupancy_year(),
        "repeated_daily_actual_distinct": lambda s, d: variant(s, d).daily_actual(),
    }
    for form in ("auto", "flags", "join"):  # "auto" is "hybrid" here
        q[f"repeated_occupancy_{form}"] = lambda s, d, f=form: variant(s, d, f).occupancy_new()
        q[f"repeated_occupancy_old_{form}"] = lambda s, d, f=form: variant(s, d, f, "narrow").occupancy_old()
        q[f"repeated_lookahead_{form}"] = lambda s, d, f=form: variant(s, d, f).lookahead_error()
    return q


def _align(s: SparkSession, d: str) -> DataFrame:
    v = _normal(s, d, "join")
    return O.align_presence(v.predicted_new(), v.actual_new())


def _timeline(s: SparkSession, d: str) -> DataFrame:
    return _normal(s, d, "join").timeline_new()


def _lookahead_join(s: SparkSession, d: str) -> DataFrame:
    return _normal(s, d, "join").lookahead_error()


def _window():
    return variant_config("normal", PARAMS).new_window


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for v in VARIANTS:
        q.update(_per_variant(v))
    q.update(
        {
            "halve_error": lambda s, d: A.halve_error(_inputs(s, d).ev),
            "tail_error_counts": _tail_counts,
            "shift_probability": _shift,
            "symmetrise": _symmetrise,
            "symmetric_halve": lambda s, d: A.halve_error(_symmetrise(s, d)),
            "predicted_stay_days": lambda s, d: _normal(s, d).predicted_new(),
            "actual_stay_days": lambda s, d: _normal(s, d).actual_new(),
            "rebase_admissions": lambda s, d: _normal(s, d).rebased(),
            "predicted_stay_days_old": lambda s, d: _normal(s, d).predicted_old(),
            "actual_stay_days_old": lambda s, d: _normal(s, d).actual_old(),
            "align_presence": _align,
            "presence_timeline": _timeline,
            "presence_flags": lambda s, d: O.presence_flags(_timeline(s, d)),
            "lookahead_presence": lambda s, d: L.lookahead_presence(
                O.presence_flags(_timeline(s, d)), PARAMS.lookahead_days
            ),
            "daily_actual_distinct": lambda s, d: O.daily_actual_distinct(_timeline(s, d)),
            "bed_occupancy_year": lambda s, d: _normal(s, d).bed_occupancy_year(),
            "occupancy_level_frequency": lambda s, d: _normal(s, d).occupancy_level_frequency(),
            "csv_roundtrip": _csv_roundtrip,
            "csv_roundtrip_null": _csv_roundtrip_null,
            "prepared_inputs_roundtrip": lambda s, d: _prepared_roundtrip(s, d, "parquet"),
            "prepared_csv_roundtrip": lambda s, d: _prepared_roundtrip(s, d, "csv"),
            "job_roundtrip": _job_roundtrip,
            # stored layouts
            "bucketed_rebase": _bucketed_rebase,
            "dated_predicted_stay_days": lambda s, d: _variant(s, d, "normal", inputs=_dated_inputs).predicted_new(),
            "dated_bed_occupancy_year": lambda s, d: _variant(s, d, "normal", "flags", inputs=_dated_inputs).bed_occupancy_year(),
            "dated_symmetric_occupancy": lambda s, d: _variant(s, d, "symmetric", inputs=_dated_inputs).occupancy_new(),
            # forced physical forms
            "daily_occupancy_join_form": lambda s, d: _normal(s, d, "join").occupancy_new(),
            "daily_occupancy_sweep": lambda s, d: _normal(s, d, "sweep").occupancy_new(),
            "daily_occupancy_flag_pass": lambda s, d: _normal(s, d, "flags").occupancy_new(),
            "presence_flag_pass": lambda s, d: forms.presence_flag_pass(
                _inputs(s, d).ev, _window(), _window(), dedupe=False
            ),
            "daily_occupancy_old_join_form": lambda s, d: _variant(s, d, "narrow", "join").occupancy_old(),
            "daily_occupancy_by_side_join_form": lambda s, d: _normal(s, d, "join").occupancy_old(),
            "lookahead_error_join_form": _lookahead_join,
            "lookahead_arithmetic": lambda s, d: _normal(s, d, "sweep").lookahead_error(),
            "lookahead_error_by_id_counts": lambda s, d: _normal(s, d, "flags").lookahead_error(),
            "daily_occupancy_union": lambda s, d: _normal(s, d, "union").occupancy_new(),
            "daily_actual_distinct_sweep": lambda s, d: _normal(s, d).daily_actual(),
            "daily_occupancy_hybrid": lambda s, d: _normal(s, d, "hybrid").occupancy_new(),
            "daily_occupancy_old_hybrid": lambda s, d: _variant(s, d, "narrow", "hybrid").occupancy_old(),
            "lookahead_error_hybrid": lambda s, d: _normal(s, d, "hybrid").lookahead_error(),
        }
    )
    q.update(_repeated_queries())
    return q


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily occupancy error of the normal variant inside the focus year."""
    return _normal(spark, sf_dir).occupancy_error_year()


__all__ = ["queries", "flagship"]
