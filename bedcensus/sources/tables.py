"""Input tables: ``evaluation`` (one row per scored stay) and ``admissions``.

``read_evaluation`` / ``read_admissions`` load prepared tables by column name
into an explicit schema; a missing column, and a value that cannot be read as
its type, is an error. ``evaluation_from_orders`` / ``admissions_from_evaluation`` derive the
same shapes from the TPC-H-like test tables (``orders`` + ``lineitem``), with
the formulas fixed by FIXTURES.md, so every query grows with those tables.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedcensus.sources.layout import read_bucketed_table, read_dated_table, read_layout

EVALUATION_SCHEMA = T.StructType(
    [
        T.StructField("admittime", T.TimestampNTZType()),
        T.StructField("anchor_year_group", T.StringType()),
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("predicted_los", T.DoubleType()),
        T.StructField("actual_los", T.DoubleType()),
    ]
)
EVALUATION_COLUMNS = [f.name for f in EVALUATION_SCHEMA.fields]

ADMISSIONS_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("admittime", T.DateType()),
    ]
)

# Fixed values of the test-table derivation (FIXTURES.md):
#   predicted_los = ((sum(l_quantity) * 7 + o_orderkey * 13) % 97) / 8
#   actual_los    = max(l_quantity) / 4
#   old admittime = date(admittime) + 41610 + ((subject_id * 37) % 100) * 365 days
PRED_QTY_MULT, PRED_KEY_MULT, PRED_MOD, PRED_DIV = 7, 13, 97, 8.0
ACTUAL_DIV = 4.0
OLD_SHIFT_DAYS, OLD_SUBJECT_MULT, OLD_SUBJECT_MOD, OLD_YEAR_DAYS = 41610, 37, 100, 365


def table_path(sf_dir: str, name: str, fmt: str = "parquet") -> str:
    return os.path.join(sf_dir, f"{name}.{fmt}")


def _as(name: str, source: T.DataType, target: T.DataType) -> Column:
    """Column ``name`` as ``target``; a value that does not convert raises.

    Dates are taken from any timestamp the source holds, so a date column may
    carry a time of day.
    """
    if source == target:
        return F.col(f"`{name}`")  # as it is, so filters reach the scan
    value = F.trim(F.col(f"`{name}`")) if isinstance(source, T.StringType) else F.col(f"`{name}`")
    if isinstance(target, T.DateType) and not isinstance(source, T.DateType):
        read = F.to_date(value.try_cast("timestamp_ntz"))
    else:
        read = value.try_cast(target)
    message = F.concat(F.lit(f"column {name}: cannot read as {target.simpleString()}: "), value.cast("string"))
    return F.when(value.isNotNull() & read.isNull(), F.raise_error(message).cast(target)).otherwise(read)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    elif fmt == "csv":
        # a database export with a header line; NULL as an empty field
        raw = spark.read.option("header", True).option("nullValue", "").option("inferSchema", False).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    # by name, whatever the order and case; other columns of an export are left out
    found = {f.name.strip().lower(): f for f in raw.schema}
    missing = [f.name for f in schema if f.name not in found]
    if missing:
        raise ValueError(f"{path}: missing column(s) {', '.join(missing)}; it has {', '.join(raw.columns)}")
    return raw.select(*[_as(found[f.name].name, found[f.name].dataType, f.dataType).alias(f.name) for f in schema])


def read_evaluation(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The predictions table, one row per stay (parquet, or CSV with a
    header), columns by name."""
    return _read(spark, path, EVALUATION_SCHEMA, fmt)


def read_admissions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The admissions table carrying the "old" timeline start dates
    (``admittime`` as a date or a timestamp)."""
    return _read(spark, path, ADMISSIONS_SCHEMA, fmt)


def evaluation_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``evaluation`` derived from ``orders`` and ``lineitem``.

    One shuffle of ``lineitem`` on ``l_orderkey`` with map-side partial
    aggregation (sum/max are combinable), then an equi-join with ``orders``
    on the same key: the aggregate's hash partitioning satisfies the join, so
    only ``orders`` is shuffled for it. Only five columns are read.
    """
    items = (
        spark.read.parquet(table_path(sf_dir, "lineitem"))
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("sq"), F.max("l_quantity").alias("mq"))
    )
    orders = spark.read.parquet(table_path(sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderdate"
    )
    # both sides grow with the data: sort-merge (the aggregate is already
    # hashed on the key), never a broadcast chosen from size estimates
    joined = orders.join(items.hint("merge"), orders.o_orderkey == items.l_orderkey, "inner")
    pred = (
        (F.col("sq").cast("bigint") * PRED_QTY_MULT + F.col("o_orderkey") * PRED_KEY_MULT) % PRED_MOD
    ).cast("double") / F.lit(PRED_DIV)
    return joined.select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("admittime"),
        F.year("o_orderdate").cast("string").alias("anchor_year_group"),
        F.col("o_custkey").cast("bigint").alias("subject_id"),
        F.col("o_orderkey").cast("bigint").alias("hadm_id"),
        pred.alias("predicted_los"),
        (F.col("mq") / F.lit(ACTUAL_DIV)).alias("actual_los"),
    )


def evaluation_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``evaluation`` at line-item grain: the supplier is the id, so ids
    repeat, and every fifth line number has none (a test of repeated and
    missing ids over the given tables)."""
    q = F.col("l_quantity")
    pred = (q.cast("bigint") * PRED_QTY_MULT + F.col("l_orderkey") * PRED_KEY_MULT) % PRED_MOD
    return spark.read.parquet(table_path(sf_dir, "lineitem")).select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("admittime"),
        F.year("l_shipdate").cast("string").alias("anchor_year_group"),
        F.col("l_partkey").cast("bigint").alias("subject_id"),
        F.when(F.col("l_linenumber") % 5 != 4, F.col("l_suppkey")).cast("bigint").alias("hadm_id"),
        (pred.cast("double") / F.lit(PRED_DIV)).alias("predicted_los"),
        (q.cast("double") / F.lit(ACTUAL_DIV)).alias("actual_los"),
    )


def admissions_from_evaluation(ev: DataFrame) -> DataFrame:
    """``admissions`` derived from ``evaluation``: a narrow map, no shuffle."""
    return ev.select("subject_id", "hadm_id", _old_date().alias("admittime"))


def _old_date() -> Column:
    shift = F.lit(OLD_SHIFT_DAYS) + (F.col("subject_id") * OLD_SUBJECT_MULT % OLD_SUBJECT_MOD) * OLD_YEAR_DAYS
    return F.date_add(F.to_date("admittime"), shift.cast("int"))


def derive_old_admission(ev: DataFrame) -> DataFrame:
    """``ev`` with its own derived admissions date attached: what the left join
    with :func:`admissions_from_evaluation` gives where the keys are unique."""
    match = F.col("subject_id").isNotNull() & F.col("hadm_id").isNotNull()
    return ev.select("*", F.when(match, _old_date()).alias("_old_admittime"), F.when(match, F.lit(True)).alias("_old_match"))


def table_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` exists on its file system (any one Spark's Hadoop
    configuration knows: local, HDFS, object stores)."""
    jvm = getattr(spark, "_jvm", None)
    jsc = getattr(spark, "_jsc", None)
    if jvm is not None and jsc is not None:
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        return bool(hpath.getFileSystem(jsc.hadoopConfiguration()).exists(hpath))
    try:  # no JVM handle (remote session): probe with a read
        spark.read.format("text").load(path).schema
        return True
    except AnalysisException:
        return False


def prepared_format(spark: SparkSession, sf_dir: str) -> str | None:
    """``"parquet"`` or ``"csv"`` when the folder holds both prepared tables
    (``evaluation.<fmt>`` and ``admissions.<fmt>``), None when it holds neither.
    One of them alone, or two formats, is an error."""
    names = ("evaluation", "admissions")
    found = {(n, fmt) for n in names for fmt in ("parquet", "csv") if table_exists(spark, table_path(sf_dir, n, fmt))}
    for fmt in ("parquet", "csv"):
        if all((n, fmt) in found for n in names):
            return fmt
    if found:
        raise ValueError(
            f"{sf_dir} holds {', '.join(sorted(f'{n}.{fmt}' for n, fmt in found))}: "
            "evaluation and admissions are both needed, in one format"
        )
    return None


def has_prepared_inputs(spark: SparkSession, sf_dir: str) -> bool:
    return prepared_format(spark, sf_dir) is not None


def load_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(evaluation, admissions) for a folder.

    If the folder holds prepared ``evaluation`` and ``admissions`` tables
    (parquet, or CSV with a header) they are read as they are, by their layout
    if the folder states one; otherwise both are derived from ``orders`` and
    ``lineitem``.
    """
    fmt = prepared_format(spark, sf_dir)
    layout = read_layout(spark, sf_dir) if fmt == "parquet" else None
    if layout and layout.get("buckets"):
        return (
            read_bucketed_table(spark, table_path(sf_dir, "evaluation"), EVALUATION_SCHEMA, layout["buckets"]),
            read_bucketed_table(spark, table_path(sf_dir, "admissions"), ADMISSIONS_SCHEMA, layout["buckets"]),
        )
    if layout and "months" in layout:
        return (
            read_dated_table(spark, table_path(sf_dir, "evaluation"), EVALUATION_SCHEMA),
            read_admissions(spark, table_path(sf_dir, "admissions")),
        )
    if fmt is not None:
        return (
            read_evaluation(spark, table_path(sf_dir, "evaluation", fmt), fmt),
            read_admissions(spark, table_path(sf_dir, "admissions", fmt), fmt),
        )
    ev = evaluation_from_orders(spark, sf_dir)
    return ev, admissions_from_evaluation(ev)
