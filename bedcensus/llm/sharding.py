"""Two-pass external shuffle into shards (operator 10).

DataFrame functions only.  Pass 1 scatters the rows uniformly into buckets of
about ``BUCKET_BYTES`` by a seeded hash of id and text.  Rows that repeat one id
and text more than ``MANY_COPIES`` times would all hash to one bucket: those are
written aside with a number each, and the number is hashed with them.  Pass 2
gathers each bucket in one task and permutes it with Spark's seeded
``shuffle``, a Fisher-Yates shuffle of the array.  The
buckets in a row are a random order of all rows; that order is cut into shards
whose row counts differ by one at most (law ``rows``).  Only the bucket counts
are prefix-summed (one row per bucket).

A task that is run again sorts its bucket by the seeded hash before it
shuffles, so it repeats the same permutation, and nothing is dealt out again
after the shuffle: what a lost executor held is rebuilt as it was.

Edge cases: a null or empty text has size 1; a null doc_id is hashed like any
other value; a few rows with equal id and text share a bucket, more are spread,
and they are interchangeable; with fewer rows than shards the rows get different shards; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, scratch_path
from .common import clean_text, read_table, without, written

SHARDS = 16
SEED = 20240229
#: UTF-8 bytes of text in one bucket.
BUCKET_BYTES = 16 * 1024 * 1024
#: At least so many buckets a shard, so that small inputs use many tasks too.
MIN_BUCKETS_PER_SHARD = 4
#: Rows of one id and text up to this many may share a bucket.
MANY_COPIES = 1000
#: Such ids and texts up to this many (8 bytes each) are broadcast.
MAX_COPIED_BROADCAST = 1_000_000


def record_size() -> F.Column:
    return F.octet_length(clean_text()).cast("bigint") + 1


def _numbered_copies(docs: DataFrame) -> DataFrame:
    """``_row`` (all columns) and ``_copy``: 0, or the number of a row that has very many copies.

    The numbered rows are written (identical ones, so the files stay small): a
    task that is run again then finds the same numbers.
    """
    key = F.xxhash64(F.col("doc_id"), clean_text())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    many = docs.groupBy(key.alias("_key")).agg(F.count("*").alias("n")).where(F.col("n") > MANY_COPIES).select("_key")
    many = broadcast_if_bounded(many, MAX_COPIED_BROADCAST)
    if many.isEmpty():
        return rows.select("_row", F.lit(0).cast("bigint").alias("_copy"))
    copied = rows.join(many, "_key", "left_semi").select("_row", (F.monotonically_increasing_id() + 1).alias("_copy"))
    rest = rows.join(many, "_key", "left_anti").select("_row", F.lit(0).cast("bigint").alias("_copy"))
    return rest.union(written(copied, "copies"))


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    docs = without(docs, ["shard", "slot"])
    total = docs.agg(F.count("*").alias("n"), F.sum(record_size()).alias("size")).first()
    rows = total["n"]
    buckets = max(MIN_BUCKETS_PER_SHARD * shards, -(-(total["size"] or 0) // bucket_bytes))

    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    key = [F.col("_row.doc_id"), text, F.col("_copy")]
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int")
    numbered = _numbered_copies(docs).withColumn("_bucket", bucket)
    # pass 1: scatter; the order inside a bucket is a seeded one, so that reruns agree
    scattered = (
        numbered.withColumn("_order", F.xxhash64(F.lit(seed + 1), *key))
        .select("_bucket", "_row", "_order")
        .repartition(buckets, "_bucket")
        .sortWithinPartitions("_bucket", "_order")
    )
    # pass 2: Fisher-Yates in each bucket
    shuffled = scattered.groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    shuffled = shuffled.withColumn("_rows", F.shuffle("_rows", F.lit(seed + 2)))

    sizes = numbered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))

    placed = shuffled.hint("merge").join(starts, "_bucket").select("_start", F.posexplode("_rows").alias("_at", "_row"))
    rank = F.col("_start") + F.col("_at")
    shard = F.expr(f"cast((_start + _at) * {shards} div {max(rows, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("_row.*", "shard", (rank - first).alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order inside each file."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_external_shuffle(spark, sf_dir):
    path = scratch_path(spark, "llm-shards")
    write_shards(shuffle_into_shards(read_table(spark, sf_dir, "documents")), path)
    shards = spark.read.parquet(path)
    return shards.select(
        "doc_id",
        record_size().alias("size"),
        F.crc32(clean_text().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
