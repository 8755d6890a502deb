"""The batch job. Runs the four variants and the two extras and writes
every result as a headerless CSV (C26) under one output folder.

The base ``evaluation`` (a lineitem aggregate joined with orders when derived
from the test tables), with the admissions start date attached, is written
once as parquet under the cluster's checkpoint folder and read back: later
stages re-read files instead of recomputing the joins, and a lost executor
costs a file re-read, not a recomputation.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedcensus.config import FIXTURE, REFERENCE, VARIANTS, Params, variant_config
from bedcensus.operators import adjust as A
from bedcensus.operators.stays import attach_old_admission
from bedcensus.plans.variant import FORMS, Inputs, Variant, keys_unique
from bedcensus.session import drop_scratch, get_session, materialize, scratch_paths
from bedcensus.sources import admissions_from_evaluation, load_inputs, read_layout, write_result
from bedcensus.sources.tables import derive_old_admission, has_prepared_inputs

SORT_KEYS = {
    "los_error_diff": ["error"],
    "occ": ["error"],
    "occupied_error_diff_new": ["error"],
    "occupied_error_diff_old": ["error"],
    "occupied_error_within_year_new": ["rn"],
    "bed_occupancy": ["rn"],
    "occupancy": ["rn"],
}


def _sort_key(name: str) -> list[str]:
    for suffix, keys in SORT_KEYS.items():
        if name == suffix or name.endswith("_" + suffix):
            return keys
    raise KeyError(name)


def prepare_inputs(
    spark: SparkSession, sf_dir: str, persist: bool = True, assume_unique_keys: bool = False
) -> Inputs:
    """Load (or derive) the inputs and write the base evaluation table once,
    with the admissions start date attached by one left join.

    One id check on the written table then settles both questions the forms
    ask: if ``hadm_id`` is unique there, evaluation ids are unique and no
    admissions key duplicated a row (the attach is valid and the rebased ids
    are unique). Otherwise the admissions keys are checked; only if they
    repeat is the attach dropped and the plain evaluation written instead.
    """
    ev, adm = load_inputs(spark, sf_dir)
    if not persist:
        inputs = Inputs(ev, adm, layout=read_layout(spark, sf_dir))
        return inputs.declare_unique() if assume_unique_keys else inputs
    derived = not has_prepared_inputs(spark, sf_dir)
    # derived admissions are a function of the evaluation row: no join to attach them
    rebased = derive_old_admission(ev) if derived else attach_old_admission(ev, adm)
    attached = materialize(rebased, "evaluation_rebased")
    if derived:
        adm = admissions_from_evaluation(attached)
    if assume_unique_keys:
        return Inputs(attached, adm).declare_unique()
    if keys_unique(attached, ["hadm_id"]):
        return Inputs(attached, adm).declare_unique(ids=True, admission_keys=True)
    # ids repeat, so rows may be identical: number those for their draws
    if keys_unique(adm, ["subject_id", "hadm_id"]):
        numbered = materialize(A.number_copies(attached), "evaluation_numbered")
        return Inputs(numbered, adm).declare_unique(ids=False, admission_keys=True)
    # repeated admissions keys duplicated evaluation rows in the attach
    ev = materialize(A.number_copies(materialize(ev, "evaluation")), "evaluation_numbered")
    return Inputs(ev, adm).declare_unique(ids=keys_unique(ev, ["hadm_id"]), admission_keys=False)


def build_variants(inputs: Inputs, params: Params, form: str = "auto") -> dict[str, Variant]:
    """All four variants; the symmetrised predictions, which two of them read,
    are computed once and written to the shared folder."""
    sym = materialize(A.symmetric_evaluation(inputs.ev), "evaluation_symmetric")
    tables = {
        "normal": inputs.ev,
        "narrow": A.halve_error(inputs.ev),
        "symmetric": sym,
        "symmetric_narrow": A.halve_error(sym),
    }
    return {
        name: Variant(inputs, variant_config(name, params), form, ev=tables[name]) for name in VARIANTS
    }


def release(variants: dict[str, Variant]) -> None:
    """Drop every persisted (calendar-sized) table of the variants. What was
    written is dropped by :func:`bedcensus.session.drop_scratch`."""
    for variant in variants.values():
        variant.unpersist()


def result_builders(variants: dict[str, Variant]) -> list[tuple[str, str, Callable[[], DataFrame]]]:
    """``(folder, name, builder)`` of all 22 result tables."""
    out = []
    for variant in variants.values():
        for name, build in variant.result_builders().items():
            out.append((variant.cfg.name, name, build))
    normal = variants["normal"]
    out.append(("extra", "bed_occupancy", normal.bed_occupancy_year))
    out.append(("extra", "occupancy", normal.occupancy_level_frequency))
    return out


def result_tables(variants: dict[str, Variant]) -> list[tuple[str, str, DataFrame]]:
    """``(folder, name, DataFrame)`` of all 22 result tables."""
    return [(folder, name, build()) for folder, name, build in result_builders(variants)]


def run_concurrently(actions: list[tuple[str, Callable[[], None]]], parallelism: int) -> dict[str, float]:
    """Run independent Spark actions from ``parallelism`` driver threads.

    The result tables are independent and mostly small, so submitting them
    together keeps the cluster busy instead of paying each job's fixed
    latency (and the driver's planning of each) in turn. Returns each
    action's own elapsed seconds.
    """
    def timed(item):
        name, action = item
        t = time.perf_counter()
        action()
        return name, time.perf_counter() - t

    if parallelism <= 1:
        return dict(timed(a) for a in actions)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return dict(pool.map(timed, actions))


def run(
    spark: SparkSession,
    sf_dir: str,
    out_dir: str,
    params: Params | None = None,
    form: str = "auto",
    assume_unique_keys: bool = False,
    parallelism: int = 8,
) -> dict[str, str]:
    """Write all 22 result tables; returns name -> path.

    ``params`` default to the study's dates for prepared tables and to the
    test-table dates for derived ones. What the run wrote for itself is
    deleted at its end.
    """
    if params is None:
        params = REFERENCE if has_prepared_inputs(spark, sf_dir) else FIXTURE
    before = set(scratch_paths())
    try:
        return _run(spark, sf_dir, out_dir, params, form, assume_unique_keys, parallelism)
    finally:
        drop_scratch(spark, [p for p in scratch_paths() if p not in before])


def stays_outside(inputs: Inputs, params: Params) -> tuple[int, int]:
    """(stays, stays admitted outside the new window)."""
    w = params.new_window
    day = F.to_date("admittime")
    outside = F.when((day < F.lit(w.lo)) | (day > F.lit(w.hi)), 1)
    row = inputs.ev.agg(F.count("*").alias("n"), F.count(outside).alias("out")).first()
    return row["n"], row["out"]


def _run(spark, sf_dir, out_dir, params, form, assume_unique_keys, parallelism) -> dict[str, str]:
    inputs = prepare_inputs(spark, sf_dir, assume_unique_keys=assume_unique_keys)
    n, out = stays_outside(inputs, params)
    if out:
        w = params.new_window
        print(f"{out} of {n} stays are admitted outside the window {w.lo} to {w.hi}", file=sys.stderr)
    variants = build_variants(inputs, params, form)
    written: dict[str, str] = {}
    actions = []
    for folder, name, build in result_builders(variants):
        path = os.path.join(out_dir, folder, f"{name}.csv")
        written[name] = path
        actions.append(
            (name, lambda build=build, path=path, name=name: write_result(build(), path, _sort_key(name)))
        )
    run_concurrently(actions, parallelism)
    release(variants)
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="stay-occupancy variants job")
    ap.add_argument("sf_dir")
    ap.add_argument("out_dir")
    ap.add_argument(
        "--params",
        choices=["fixture", "reference"],
        default=None,
        help="dates of the test tables or of the study (default: the study's for prepared tables)",
    )
    ap.add_argument("--form", choices=FORMS, default="auto")
    ap.add_argument("--master", default=None)
    ap.add_argument("--parallelism", type=int, default=8, help="result tables written at once")
    ap.add_argument(
        "--assume-unique-keys",
        action="store_true",
        help="hadm_id and admissions (subject_id, hadm_id) are known keys: skip their checks",
    )
    args = ap.parse_args(argv)
    spark = get_session(master=args.master)
    params = {"fixture": FIXTURE, "reference": REFERENCE, None: None}[args.params]
    written = run(
        spark, args.sf_dir, args.out_dir, params, args.form, args.assume_unique_keys, args.parallelism
    )
    for name, path in sorted(written.items()):
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
