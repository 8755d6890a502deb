"""Session settings, the shared checkpoint folder, and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. Dates are computed in UTC; AQE re-plans joins
# and coalesces shuffle partitions at run time and splits skewed join
# partitions; the UI (an HTTP server) stays off.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(
    master: str | None = None,
    app_name: str = "bedcensus",
    shuffle_partitions: int | None = None,
    conf: dict | None = None,
) -> SparkSession:
    """Create or reuse a session with :data:`DEFAULT_CONF` applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Taken from ``spark.checkpoint.dir`` (or an already set checkpoint dir).
    Only a local-mode session without one (tests, benchmarks) gets a fresh
    scratch folder; on a cluster a machine-local folder would be wrong, so a
    missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="bedcensus-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def scratch_paths() -> list[str]:
    """Paths given out so far and not dropped."""
    return list(_scratch)


def drop_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete written tables (all of this session's, or ``paths``).

    For use once no DataFrame that reads them is needed any more.
    """
    jvm = spark._jvm
    for path in scratch_paths() if paths is None else paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _scratch:
            _scratch.remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Cuts the lineage (an executor lost later re-reads the files instead of
    recomputing the inputs) and keeps column pruning on re-reads, which an
    RDD checkpoint would not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for ``df`` only when it has at most ``max_rows`` rows.

    ``df`` is written to the shared folder and counted there (partial counts
    only, no row meets another), so what follows reads what the check computed.
    Above the bound the written table is returned unhinted: the planner keeps a
    shuffle join.
    """
    kept = materialize(df, "bounded")
    return F.broadcast(kept) if kept.count() <= max_rows else kept
