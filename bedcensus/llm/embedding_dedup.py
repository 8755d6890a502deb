"""Near-duplicate embeddings by spherical-cap filters (operator 12).

A filter is a direction; a vector belongs to every filter whose direction it
exceeds a cosine with (a spherical cap).  The directions are random product
codes (Becker, Ducas, Gama, Laarhoven 2016): after a seeded random rotation
(signs and Walsh-Hadamard transforms) the vector is cut into ``BLOCKS`` blocks,
each block has a random code, and any choice of one codeword a block is a
direction.  So each vector finds all its filters by list decoding, one block
after the other, without trying the other directions.  Several codes with
rotations of their own (``TABLES``) even out vectors that lie badly in one.

Vectors are joined on filters and every pair of a filter is verified by its
cosine in doubles, in a matrix product a filter.  A pair that meets in several
filters counts in the smallest one both belong to, so links are counted where
they are found and no pair leaves a task: out come, per vector and filter, its
number of links and the least vector it hangs together with.  Equal vectors
take part once, weighted by their number.

Plan: the cap is chosen so that a filter holds about ``FILTER_VECTORS`` vectors
without near duplicates, whatever the number of vectors, and the codes so large
that a pair at the threshold shares ``SHARED_FILTERS`` filters on average; a
pair is missed if it shares none (one in ten thousand at cosine 0.95 exactly,
fewer above).  A filter with more than ``BLOCK`` vectors is dealt into blocks,
and all pairs of blocks are verified, each by a task of its own.

Edge cases: a vector that is null, empty, zero or holds a null, NaN or infinite
entry links with nothing, nor do vectors of different lengths.  Such a row and
one without links are their own component.  Rows that repeat an id are vectors
of their own and share its verdict; a component's id is its least id that is
not null (null if it has none).  Extra columns are not looked at.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded
from .common import append_columns, bounded_batches, read_table, written
from .components import connected_components
from .vectors import by_length, doubles, is_finite

THRESHOLD = 0.95
TABLES = 20
BLOCKS = 2
SEED = 7
#: Filters that a pair at the threshold shares on average.
SHARED_FILTERS = 20.0
#: Vectors of one filter when none are near duplicates.
FILTER_VECTORS = 32
#: Vectors of one filter that one task compares.
BLOCK = 512
#: Least length that vectors are filled up to (with zeros; a power of two).
LEAST_LENGTH = 16
#: Filters with more than BLOCK vectors that may be broadcast.
MAX_LARGE_FILTERS = 1_000_000


@dataclass(frozen=True)
class Plan:
    """Filters of one vector length: cap cosine and codewords a block."""

    length: int  # filled up
    cap: float
    words: int


@cache
def _sphere(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines between random directions and their probabilities, on a grid."""
    t = np.linspace(-1, 1, 100_001)[1:-1]
    weight = (1 - t * t) ** ((length - 3) / 2)
    return t, weight / weight.sum()


def cap_share(length: int, cap: np.ndarray | float) -> np.ndarray:
    """Share of the directions with a cosine of at least ``cap`` to a given one."""
    t, p = _sphere(length)
    return np.interp(cap, t, np.cumsum(p[::-1])[::-1], left=1.0, right=0.0)


def shared_share(length: int, cap: float, cosine: float) -> float:
    """Share of the directions within the caps of both vectors of a pair at ``cosine``."""
    t, p = _sphere(length)
    t, p = t[t >= cap], p[t >= cap]
    need = (cap - cosine * t) / np.sqrt((1 - cosine * cosine) * (1 - t * t))
    return float((p * cap_share(length - 1, need)).sum())


def plan_filters(n: int, length: int, threshold: float = THRESHOLD) -> Plan:
    """Cap and code size for ``n`` different vectors of ``length`` entries."""
    filled = LEAST_LENGTH
    while filled < length:
        filled *= 2
    share = min(FILTER_VECTORS / max(n, 1), 0.01)
    t, p = _sphere(filled)
    cap = float(t[np.searchsorted(np.cumsum(p), 1 - share)])
    both = shared_share(filled, cap, min(threshold, 1 - 1e-9))
    words = int(np.ceil((SHARED_FILTERS / TABLES / both) ** (1 / BLOCKS)))
    return Plan(filled, cap, max(words, 2))


def _hadamard(y: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows (length a power of two)."""
    n, d = y.shape
    h = 1
    while h < d:
        y = y.reshape(n, d // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return y / np.sqrt(d)


@cache
def _codes(plan: Plan) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each table: three rows of signs, and the code of each block."""
    out = []
    for table in range(TABLES):
        rng = np.random.default_rng([SEED, table, plan.length])
        signs = rng.choice([-1.0, 1.0], (3, plan.length))
        codes = []
        for part in np.array_split(np.arange(plan.length), BLOCKS):
            c = rng.standard_normal((plan.words, len(part)))
            codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(BLOCKS))
        out.append((signs, codes))
    return out


def list_decode(scores: list[np.ndarray], cap: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row, filter) whose block scores add up to at least ``cap``.

    ``scores`` holds one matrix a block (row, codeword).  Partial choices are
    kept while the best codewords of the blocks to come can still lift them to
    the cap; each block's codewords are tried from the best down until one fails.
    """
    order = [np.argsort(-s, axis=1, kind="stable") for s in scores]
    ranked = [np.take_along_axis(s, o, axis=1) for s, o in zip(scores, order)]
    to_come = np.zeros((len(scores) + 1, len(scores[0])))
    for k in reversed(range(len(scores))):
        to_come[k] = to_come[k + 1] + ranked[k][:, 0]
    row = np.arange(len(scores[0]))
    have = np.zeros(len(row))
    chosen = np.zeros(len(row), np.int64)
    for k, (s, o) in enumerate(zip(ranked, order)):
        need = cap - to_come[k + 1][row] - have
        live = np.arange(len(row))
        parts = []
        for j in range(s.shape[1]):
            live = live[s[row[live], j] >= need[live]]
            if not len(live):
                break
            r = row[live]
            parts.append((r, have[live] + s[r, j], chosen[live] * s.shape[1] + o[r, j]))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, have, chosen = (np.concatenate(x) for x in zip(*parts))
    return row, chosen


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in doubles (scaled first, so that no square overflows)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def filters_of(x: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """For each row of ``x`` its filters, ascending."""
    y = np.zeros((len(x), plan.length))
    y[:, : x.shape[1]] = unit(x)
    rows, names = [], []
    for table, (signs, codes) in enumerate(_codes(plan)):
        z = y
        for s in signs:
            z = _hadamard(z * s)
        parts = np.array_split(z, BLOCKS, axis=1)
        row, name = list_decode([p @ c.T for p, c in zip(parts, codes)], plan.cap)
        rows.append(row)
        names.append(name + table * plan.words**BLOCKS)
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return np.split(name[order], np.searchsorted(row[order], np.arange(1, len(x))))


def _different(df: DataFrame, column: str) -> DataFrame:
    """Each different linkable vector once: digest, vector, copies, least_id, key."""
    linkable = df.where(F.col("_digest").isNotNull())
    found = linkable.groupBy("_digest", column).agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    return written(found.withColumn("key", F.monotonically_increasing_id()), "vectors")


def _with_digest(df: DataFrame, column: str) -> DataFrame:
    """vec_id, vector and its digest, which is null for a vector that links with nothing."""
    some = F.exists(doubles(column), lambda c: c != 0)
    digest = F.sha2(F.array_join(F.col(column).cast("array<string>"), ",").cast("binary"), 256)
    return df.select("vec_id", column, F.when(is_finite(column) & some, digest).alias("_digest"))


def _members(different: DataFrame, column: str, threshold: float) -> DataFrame:
    """One row per vector and filter: filter, block pair, block, and what the verification needs."""
    lengths = different.groupBy(F.size(column).alias("d")).count().collect()  # a row a vector length
    plans = {r["d"]: plan_filters(r["count"], r["d"], threshold) for r in lengths}

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out: list = [None] * batch.num_rows
            for rows, x in by_length(batch, "vector"):
                d = x.shape[1]
                for r, f in zip(rows, filters_of(x, plans[d])):
                    out[r] = f + (d << 40)
            return [pa.array(out, pa.list_(pa.int64()))]

        return work

    vectors = different.select("key", "copies", F.col(column).alias("vector"))
    decoded = written(append_columns(vectors, make, [("filters", "array<bigint>")]), "filters")
    one = decoded.select("key", "copies", "vector", "filters", F.explode("filters").alias("filter"))
    sizes = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("n"))
    large = broadcast_if_bounded(sizes.where(F.col("n") > BLOCK).select("filter", F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("blocks")), MAX_LARGE_FILTERS)
    dealt = one.join(large, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("block", "other").cast("bigint") * F.col("blocks") + F.greatest("block", "other")
    return dealt.select("filter", pair.alias("pair"), "block", "key", "copies", "vector", "filters")


def _before(filters: list[np.ndarray], here: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the vectors i and j share a filter below ``here`` (pair by pair)."""
    used = np.unique(np.concatenate([i, j]))
    below = [filters[k][: np.searchsorted(filters[k], here)] for k in used]
    names, column = np.unique(np.concatenate(below), return_inverse=True)
    if not len(names):
        return np.zeros(len(i), bool)
    has = np.zeros((len(used), len(names)), np.float32)
    has[np.repeat(np.arange(len(used)), [len(b) for b in below]), column] = 1
    return (has @ has.T)[np.searchsorted(used, i), np.searchsorted(used, j)] > 0


def _linked(x: np.ndarray, block: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows at ``threshold`` or above; of two blocks only the pairs across."""
    u = unit(x)
    close = np.triu(u @ u.T >= threshold, 1)
    if block.min() != block.max():
        close &= block[:, None] != block[None, :]
    return np.nonzero(close)


def _least_reached(n: int, i: np.ndarray, j: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each of n nodes the least key of its component."""
    least = key.copy()
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        if (least == before).all():
            return least


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """key, links, root: a vector's links that count in one filter, and the least key it reaches there."""
    bounded_batches(members.sparkSession)
    dealt = members.repartition("filter", "pair").sortWithinPartitions("filter", "pair")
    names = dealt.columns

    def group(part: pa.Table) -> tuple | None:
        if part.num_rows < 2:
            return None
        column = part.column("vector").combine_chunks()
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        i, j = _linked(x, part.column("block").to_numpy(), threshold)
        if not len(i):
            return None
        lists = part.column("filters").combine_chunks()
        ends, values = lists.value_lengths().to_numpy().cumsum(), lists.flatten().to_numpy()
        first = ~_before(np.split(values, ends[:-1]), part.column("filter")[0].as_py(), i, j)
        key, copies = part.column("key").to_numpy(), part.column("copies").to_numpy()
        links = np.zeros(len(key), np.int64)
        np.add.at(links, i[first], copies[j[first]])
        np.add.at(links, j[first], copies[i[first]])
        least = _least_reached(len(key), i, j, key)
        told = np.flatnonzero((links > 0) | (least < key))
        return key[told], links[told], least[told]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def finished(table: pa.Table, last: bool):
            """Groups that are complete in ``table``; what is not stays held."""
            nonlocal held
            f, p = table.column("filter").to_numpy(), table.column("pair").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (p[1:] != p[:-1])]))
            ends = np.concatenate([starts[1:], [len(f)]])
            held = None if last else table.slice(starts[-1])
            for a, b in list(zip(starts, ends))[: None if last else -1]:
                if found := group(table.slice(a, b - a)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["key", "links", "root"])

        for b in batches:
            if b.num_rows:
                new = pa.Table.from_batches([b]).select(names)
                yield from finished(new if held is None else pa.concat_tables([held, new]), False)
        if held is not None:
            yield from finished(held, True)

    return dealt.mapInArrow(run, "key bigint, links bigint, root bigint")


def near_duplicate_vectors(df: DataFrame, column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``df``."""
    rows = _with_digest(df, column)
    different = _different(rows, column)
    found = written(_verified(_members(different, column, threshold), threshold), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    pairs = found.where(F.col("root") < F.col("key")).select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()
    roots = connected_components(pairs).select(F.col("node").alias("key"), "root")
    known = different.select("_digest", "key", "copies", "least_id")
    known = known.hint("merge").join(links.hint("merge"), "key", "left").hint("merge").join(roots.hint("merge"), "key", "left")
    known = known.select(
        "_digest",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "key").alias("root"),
        "least_id",
    )
    known = written(known, "classes")
    # written, so that the join below is a plain one, whose hot roots are split
    least = written(known.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    known = known.hint("merge").join(least.hint("merge"), "root").select("_digest", "n_links", "component_id")
    out = rows.select("vec_id", "_digest").hint("merge").join(known.hint("merge"), "_digest", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op12_embedding_near_dedup(spark, sf_dir):
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""with rows_ as (
  select row_number() over () as r, vec_id,
    case when embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0
      and len([c for c in embedding if c <> 0]) > 0 then cast(embedding as double[]) end as v
  from embeddings),
link as (
  select a.r as a, b.r as b, b.vec_id from rows_ a join rows_ b on a.r <> b.r and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reached as (
  with recursive reach(r, s) as (
    select distinct a, a from link union select reach.r, link.b from reach join link on reach.s = link.a)
  select reach.r, min(rows_.vec_id) as least from reach join rows_ on reach.s = rows_.r group by reach.r)
select o.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, coalesce(c.least, o.vec_id) as component_id,
  coalesce(c.least, o.vec_id) = o.vec_id as kept
from rows_ o left join (select a, count(*) as n from link group by a) n on o.r = n.a
left join reached c on o.r = c.r"""
