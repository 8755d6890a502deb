"""Centroid clustering with scalar lookup tables (operator 13).

Vectors are integers, ``floor(64 * entry)``, and so are the centroids, so every
result is exact and the same whatever the partitioning.  For a batch of
vectors a table of squared differences is made for each dimension: one row for
each integer that occurs there, one column for each centroid.  A vector's
distances are then table rows gathered and summed over the dimensions; no
multiplication is left to do per vector.

A round is one pass over the vectors: each task sends a count and a sum per
centroid and dimension, Spark adds them, and the new centroids (k vectors)
reach the driver.

Edge cases: vectors that are null, have another number of entries, or hold a
null, NaN or infinite entry are left out.  Equal distances go to the smaller
number.  The start is by the hash of the id; equal hashes (repeated ids) are
ordered by the vector, and a null id comes last.  With fewer vectors than
centroids there are as many centroids as vectors.  ``64 * entry`` is kept
within 2^50; distances are compared exactly, and a distance or inertia beyond a
long is returned as the largest long.  Extra columns are not looked at.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, bounded_batches, read_table, without, written
from .vectors import by_length, floored, is_finite, saturated

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = 1
LIMIT = 2**50
#: Vectors and centroids within this bound take int64 tables (dimensions * (2 * SMALL)^2 < 2^62).
SMALL = 2**27
LONG_MAX = 2**63 - 1


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``x`` to every centroid, by table lookups."""
    exact = object if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > SMALL else np.int64
    out = np.zeros((len(x), len(centroids)), exact)
    for d in range(x.shape[1]):
        values, at = np.unique(x[:, d], return_inverse=True)
        table = (values.astype(exact)[:, None] - centroids[:, d].astype(exact)[None, :]) ** 2
        out += table[at]
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (the smaller of equals) and the squared distance."""
    table = distances(x, centroids)
    cluster = table.argmin(axis=1)
    return cluster, table[np.arange(len(x)), cluster]


def integer_vectors(df: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows whose vector has ``dimensions`` finite entries, with its integers as ``x``."""
    fits = is_finite(column) & (F.size(column) == dimensions)
    return without(df, ["x"]).where(fits).withColumn("x", floored(column, SCALE, LIMIT))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The x of the k rows with the smallest SHA-256 of ``seed:vec_id``."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["x"]) if rows else 0)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign every vector, replace non-empty centroids by the floor of the mean."""
    bounded_batches(vectors.sparkSession)
    exact = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, object)
        for b in batches:
            for _, x in by_length(b, "x"):
                cluster, _ = nearest(x, centroids)
                for c in np.unique(cluster):
                    mine = x[cluster == c]
                    count[c] += len(mine)
                    total[c] += mine.sum(axis=0).astype(object)  # 512 * 2^50 < 2^63
        rows = [(int(c), d, int(count[c]), Decimal(int(s))) for c in np.flatnonzero(count) for d, s in enumerate(total[c])]
        cols = list(zip(*rows)) or [()] * 4
        types = [pa.int32(), pa.int32(), pa.int64(), exact]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["c", "d", "n", "s"])

    parts = vectors.select("x").mapInArrow(run, "c int, d int, n bigint, s decimal(38,0)")
    out = centroids.copy()
    for r in parts.groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # k * dimensions rows
        out[r["c"], r["d"]] = int(r["s"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster`` and ``distance`` to rows with ``x``."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, x in by_length(batch, "x"):
                cluster[rows], far = nearest(x, centroids)
                distance[rows] = saturated(far) if far.dtype == object else far
            return [pa.array(cluster), pa.array(distance)]

        return work

    return append_columns(vectors, make, [("cluster", "int"), ("distance", "bigint")])


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Assign ``vectors`` (vec_id, x) after ``rounds`` rounds; the final centroids."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return assigned(vectors, centroids), centroids


def op13_centroid_clustering(spark, sf_dir):
    vectors = written(integer_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "x"), "integers")
    found, centroids = cluster(vectors)
    found = written(found.select("vec_id", "cluster", "distance"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    whole = min(sum(inertia.values()), LONG_MAX)
    told = [
        (c, min(s, LONG_MAX), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for c, s in inertia.items()
    ]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def clustering_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same clustering for DuckDB, one row per entry, rounds written out."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""pair_{r} as (
  select e.row_no, c.c, cast(sum((e.x - c.x) * (e.x - c.x)) as bigint) as far
  from entry e join centroid_{r} c on e.d = c.d group by e.row_no, c.c),
near_{r} as (
  select row_no, c, far from (
    select row_no, c, far, row_number() over (partition by row_no order by far, c) as place from pair_{r}) where place = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""mean_{r} as (
  select n.c, e.d, cast(sum(e.x) as bigint) as s, count(*) as n from near_{r} n join entry e on n.row_no = e.row_no group by n.c, e.d),
centroid_{r + 1} as (
  select o.c, o.d, case when m.c is null then o.x else cast((m.s - ((m.s % m.n) + m.n) % m.n) // m.n as bigint) end as x
  from centroid_{r} o left join mean_{r} m on o.c = m.c and o.d = m.d)"""
            )
    return f"""with kept as (
  select row_number() over () as row_no, vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(embedding) = {dimensions}
    and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
entry as (
  select row_no, vec_id, d, cast(floor({scale} * v[d]) as bigint) as x
  from kept, (select unnest(range(1, {dimensions + 1})) as d)),
first as (
  select row_no, row_number() over (order by sha256('{seed}:' || cast(vec_id as varchar))) - 1 as c from kept
  qualify c < {k}),
centroid_0 as (select f.c, e.d, e.x from first f join entry e on f.row_no = e.row_no),
{', '.join(steps)},
told as (
  select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as digest from centroid_{rounds} group by c)
select k.vec_id, cast(n.c as integer) as cluster, n.far as distance,
  cast(sum(n.far) over (partition by n.c) as bigint) as cluster_inertia,
  cast(sum(n.far) over () as bigint) as inertia, t.digest as centroid_sha256
from near_{rounds} n join kept k on n.row_no = k.row_no join told t on n.c = t.c"""


OP13_SQL = clustering_sql()
