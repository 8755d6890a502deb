"""The external shuffle: the row law, gapless slots, whole rows, randomness."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from bedcensus.llm import sharding as S
from bedcensus.session import scratch_path

SF = "/root/testdata/sf0.01"


def check_law(places, shards):
    by = Counter(s for s, _ in places)
    assert set(by) <= set(range(shards))
    counts = [by.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert sorted(places) == [(s, i) for s in range(shards) for i in range(counts[s])]


def test_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = S.op10_external_shuffle(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    check_law([(r["shard"], r["slot"]) for r in rows], 16)


def order_of(spark, n, seed, buckets_of=64):
    df = spark.range(n).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = S.shuffle_into_shards(df, shards=4, seed=seed, bucket_bytes=buckets_of).collect()
    check_law([(r["shard"], r["slot"]) for r in rows], 4)
    return [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]


def test_same_seed_same_order_and_orders_look_random(spark):
    a, b, c = order_of(spark, 2000, 1), order_of(spark, 2000, 1), order_of(spark, 2000, 2)
    assert a == b and a != c
    # positions of neighbours are unrelated: about a third of the length apart
    gaps = [abs(x - y) for x, y in zip(a, a[1:])]
    assert 600 < sum(gaps) / len(gaps) < 735
    # rising runs of a random permutation have length 2 on average
    runs = 1 + sum(x > y for x, y in zip(a, a[1:]))
    assert 900 < runs < 1100


def test_files_hold_rows_in_slot_order(spark):
    path = scratch_path(spark, "t-shards")
    df = spark.range(300).selectExpr("id as doc_id", "repeat('x', cast(id as int)) as text")
    S.write_shards(S.shuffle_into_shards(df, shards=4, bucket_bytes=5000), path)
    back = spark.read.parquet(path)
    assert back.count() == 300 and set(back.columns) == {"doc_id", "text", "shard", "slot"}
    for rows in back.rdd.mapPartitions(lambda rs: [[(r["shard"], r["slot"]) for r in rs]]).collect():
        for s in range(4):
            slots = [k for x, k in rows if x == s]
            assert len(slots) == len(set(slots))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "é", 9), (3, "same", 9), (3, "same", 9)], "doc_id bigint, text string, SHARD int")
    out = S.shuffle_into_shards(docs)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "shard", "slot"] and len(rows) == 5
    check_law([(r["shard"], r["slot"]) for r in rows], 16)
    copies = spark.range(4000).selectExpr("id as doc_id", "'one text' as text")
    check_law([(r["shard"], r["slot"]) for r in S.shuffle_into_shards(copies, bucket_bytes=500).collect()], 16)
    assert S.shuffle_into_shards(docs.limit(0)).count() == 0


def test_copies_of_one_row_are_spread_over_tasks(spark):
    """300,000 rows of one id and text: no task gathers them."""
    docs = spark.range(300_000).selectExpr("7 as doc_id", "'one text' as text").union(spark.range(500).selectExpr("id", "cast(id as string)"))
    out = S.shuffle_into_shards(docs)
    tasks = Counter(dict(out.where("doc_id = 7 and text = 'one text'").groupBy(F.spark_partition_id().alias("p")).count().collect()))
    assert len(tasks) >= 16 and max(tasks.values()) < 3 * 300_000 / len(tasks)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(counts) == 300_500 and max(counts) - min(counts) <= 1
    slots = out.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("top")).collect()
    assert all(r["n"] == r["top"] + 1 for r in slots)
