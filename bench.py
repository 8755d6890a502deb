"""Benchmark: the whole variants job (22 result tables) at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--forms auto,flags,join] [--sequential]

Prints ONE JSON line. ``value`` is the wall time of the job in the default
("auto") form as the job runs it: inputs prepared once, then the 22 result
tables submitted from 8 driver threads, each executed to completion with a
no-op write (nothing collected). ``queries`` holds each result's own elapsed
time inside that run (they overlap). ``--sequential`` adds a pass with fresh
inputs that runs the results one at a time (``sequential`` in the output);
``--forms`` times other physical forms the same way (``by_form``).

Before timing, the whole job runs once on the smallest test folder
(``BENCH_WARMUP_DIR``, default the sibling ``sf0.001``; empty string to skip)
so JIT compilation and class loading are not billed to the first result.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from bedcensus.config import FIXTURE  # noqa: E402
from bedcensus.plans.job import build_variants, prepare_inputs, release, result_builders, run_concurrently  # noqa: E402
from bedcensus.session import drop_scratch, get_session  # noqa: E402

PARALLELISM = 8


def _noop(build):
    return lambda: build().write.format("noop").mode("overwrite").save()


def time_job(spark, sf_dir: str, form: str, parallelism: int) -> tuple[float, dict[str, float]]:
    t0 = time.perf_counter()
    inputs = prepare_inputs(spark, sf_dir)
    variants = build_variants(inputs, FIXTURE, form)
    if form in ("auto", "hybrid"):
        inputs.ids_unique()
        inputs.rebased_ids_unique()
    times = {"prepare_inputs": time.perf_counter() - t0}
    actions = [(name, _noop(build)) for _, name, build in result_builders(variants)]
    times.update(run_concurrently(actions, parallelism))
    total = time.perf_counter() - t0
    release(variants)
    drop_scratch(spark)
    return total, times


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--forms", default="auto")
    ap.add_argument("--sequential", action="store_true")
    args = ap.parse_args()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(
        master=f"local[{cpus}]",
        shuffle_partitions=max(cpus, 1),
        conf={"spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)},
    )
    warm_dir = os.environ.get(
        "BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    )
    warmed = bool(warm_dir) and os.path.isdir(warm_dir)
    if warmed:
        time_job(spark, warm_dir, "auto", PARALLELISM)
    forms = [f.strip() for f in args.forms.split(",") if f.strip()]
    main_form = "auto" if "auto" in forms else forms[0]
    by_form = {f: time_job(spark, sf_dir, f, PARALLELISM) for f in forms}
    total, queries = by_form[main_form]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "variants_job_wall_time",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in queries.items()},
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "form": main_form,
        "cpus": cpus,
        "parallelism": PARALLELISM,
        "warmup": warm_dir if warmed else None,
    }
    if len(by_form) > 1:
        out["by_form"] = {f: round(v[0], 3) for f, v in by_form.items()}
    if args.sequential:
        seq_total, seq = time_job(spark, sf_dir, main_form, 1)
        out["sequential"] = {"total": round(seq_total, 3), "queries": {k: round(v, 3) for k, v in seq.items()}}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
