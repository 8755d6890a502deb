"""Shuffle volume of the variants job per physical form, from Spark's event log.

    python tests/shuffle_profile.py SF_DIR [form ...]

Runs the whole job (all 22 results, no-op sink) once per form, each in a
fresh local session whose event log goes to a new scratch folder, then sums
the shuffle bytes and records written over all tasks (SparkListenerTaskEnd).
Prints one JSON line per form.
"""

from __future__ import annotations

import glob
import json
import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CHILD = r"""
import sys
sys.path.insert(0, {root!r})
from bedcensus.config import FIXTURE
from bedcensus.plans.job import build_variants, prepare_inputs, result_tables, run_concurrently
from bedcensus.session import get_session
spark = get_session(master="local[8]", shuffle_partitions=8, conf={{
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": {logdir!r}, "spark.eventLog.compress": "false"}})
inputs = prepare_inputs(spark, {sf_dir!r})
variants = build_variants(inputs, FIXTURE, {form!r})
actions = [(n, (lambda df=df: df.write.format("noop").mode("overwrite").save())) for _, n, df in result_tables(variants)]
run_concurrently(actions, 4)
spark.stop()
"""


def shuffle_totals(logdir: str) -> dict[str, int]:
    out = {"shuffle_bytes_written": 0, "shuffle_records_written": 0, "tasks": 0}
    # Spark 4 writes a rolling event log: a folder of event files
    for path in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                if '"SparkListenerTaskEnd"' not in line:
                    continue
                ev = json.loads(line)
                m = ev.get("Task Metrics") or {}
                w = m.get("Shuffle Write Metrics") or {}
                out["shuffle_bytes_written"] += int(w.get("Shuffle Bytes Written", 0))
                out["shuffle_records_written"] += int(w.get("Shuffle Records Written", 0))
                out["tasks"] += 1
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    forms = argv[1:] or ["auto", "hybrid", "flags", "join"]
    for form in forms:
        logdir = tempfile.mkdtemp(prefix=f"bedcensus-events-{form}-")
        code = CHILD.format(root=ROOT, logdir=logdir, sf_dir=sf_dir, form=form)
        subprocess.run([sys.executable, "-c", code], check=True, stderr=subprocess.DEVNULL)
        print(json.dumps({"sf_dir": sf_dir, "form": form, **shuffle_totals(logdir)}), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
