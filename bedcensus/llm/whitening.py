"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi (operator 11).

Entries become integers ``x = floor(64 * c)`` (a constant added to all of them
would change no result below).  The fit list holds each distinct x vector once.  Two passes over it sum what its covariance needs,
in exact integers: first the sums S of each dimension, then the products of
``z = x - round(S / n)`` (centred before multiplying; the rest of the mean,
at most a half, is taken out exactly afterwards).  Every task sends its sums,
Spark adds them up, and one d x d matrix a vector length reaches the driver.

There the centred scatter is factored by pivoted Cholesky, ``V = L L'``, and
one-sided Jacobi rotations make the columns of L orthogonal without ever
forming ``L' L``: the squared norms of the rotated columns are the eigenvalues,
the normalised columns the components.  That keeps small eigenvalues to full
relative precision.

Edge cases: a null vector and one with a null, NaN or infinite entry are left
out; an empty vector has no components and so no rows.  Vectors of different
lengths cannot share a covariance: each length is whitened by itself.  A
component without variance (fewer distinct vectors than dimensions, a constant
dimension) is not returned, so a single distinct vector has no rows.  Repeated
rows and null ids are rows like any other.  ``64 * c`` is kept within 2^50, and
a ``deviation`` beyond a long is the largest long.  An input column called like
an added one is replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, bounded_batches, read_table, without, written
from .vectors import by_length, floored, is_finite, saturated

SCALE = 64
COMPONENTS = 16
#: Bound of an entry's integer.
LIMIT = 2**50
#: Below this bound on |z| a batch's products and their sums are exact in doubles.
SMALL = 2**20
SWEEPS = 60


@dataclass(frozen=True)
class Fit:
    """The whitening of one vector length."""

    n: int
    sums: np.ndarray  # of each dimension, Python integers
    components: np.ndarray  # one column each
    eigenvalues: np.ndarray
    trace: float

    @property
    def origin(self) -> np.ndarray:
        """The mean, rounded to integers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        origin = self.origin
        rest = np.array([(s - self.n * int(o)) / self.n for s, o in zip(self.sums, origin)])
        return ((x - origin) - rest) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n x - S)^2, exact."""
        origin = self.origin
        rest = np.array([s - self.n * int(o) for s, o in zip(self.sums, origin)], object)  # n * origin + rest = S
        z = x - origin
        big = (np.abs(z).max(axis=1).astype(float) + 1) * self.n >= np.sqrt(2.0**62 / x.shape[1])
        out = np.zeros(len(x), np.int64)
        if not big.all():
            out[~big] = ((self.n * z[~big] - rest.astype(np.int64)) ** 2).sum(axis=1)
        if big.any():
            out[big] = saturated(((self.n * z[big].astype(object) - rest) ** 2).sum(axis=1))
        return out


def with_integers(df: DataFrame, column: str) -> DataFrame:
    """Rows with a finite vector, and its integers as ``x``."""
    return without(df, ["x"]).where(is_finite(column)).withColumn("x", floored(column, SCALE, LIMIT))


def _per_task(df: DataFrame, start, schema: str) -> DataFrame:
    """Rows that each task makes of all its batches: ``start()`` gives (add(x matrix), rows())."""
    bounded_batches(df.sparkSession)
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "decimal(38,0)": pa.decimal128(38, 0)}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, rows = start()
        for b in batches:
            for _, x in by_length(b, "x"):
                add(x)
        cols = list(zip(*rows())) or [()] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    return df.select("x").mapInArrow(run, schema)


def _plain(v):
    """An exact value as pyarrow takes it for a decimal."""
    from decimal import Decimal

    return Decimal(int(v))


def sums_by_length(fit_list: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each vector length: the number of vectors, the sum of each dimension (Python integers)."""

    def start():
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}

        def add(x):
            d = x.shape[1]
            n[d] = n.get(d, 0) + len(x)
            sums[d] = sums.get(d, 0) + x.sum(axis=0).astype(object)  # |x| < 2^51, at most 512 rows

        def rows():
            return [(d, i, n[d], _plain(s)) for d in n for i, s in enumerate(sums[d])]

        return add, rows

    added = _per_task(fit_list, start, "d int, i int, n bigint, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in added.collect():  # a number a dimension
        out.setdefault(r["d"], (r["n"], np.zeros(r["d"], object)))[1][r["i"]] = int(r["s"])
    return out


def _products(z: np.ndarray) -> np.ndarray:
    """``z' z`` in Python integers."""
    small = np.abs(z).max(axis=1) <= SMALL
    f = z[small].astype(np.float64)
    out = (f.T @ f).astype(np.int64).astype(object)  # 512 * 2^40 < 2^53: every sum is exact
    if not small.all():
        o = z[~small].astype(object)
        out = out + o.T.dot(o)
    return out


def covariance_by_length(fit_list: DataFrame, sums: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each vector length: the covariance (divisor n), every entry correctly rounded."""
    origins = {d: np.array([(2 * s + n) // (2 * n) for s in total], np.int64) for d, (n, total) in sums.items()}

    def start():
        seen: dict[int, np.ndarray] = {}

        def add(x):
            d = x.shape[1]
            seen[d] = seen.get(d, 0) + _products(x - origins[d])

        def rows():
            return [(d, i, j, _plain(m[i, j])) for d, m in seen.items() for i in range(d) for j in range(i, d)]

        return add, rows

    added = _per_task(fit_list, start, "d int, i int, j int, p decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("p").alias("p"))
    out = {d: np.zeros((d, d)) for d in sums}
    for r in added.toLocalIterator():  # d * (d + 1) / 2 numbers a length
        d, i, j = r["d"], r["i"], r["j"]
        n, total = sums[d]
        rest = [total[k] - n * int(origins[d][k]) for k in (i, j)]
        out[d][i, j] = out[d][j, i] = (n * int(r["p"]) - rest[0] * rest[1]) / (n * n)
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of ``a = L L'`` for a positive semidefinite ``a``, columns in order of the pivots.

    The rows stay where they are (L is triangular once they are put in the
    order of the pivots).  It has one column for each pivot above the rounding
    of its own diagonal entry, so dimensions of very different scale all count.
    """
    left = a.astype(np.float64)
    out = []
    least = len(a) * np.finfo(float).eps * left.diagonal().copy()
    for _ in range(len(a)):
        above = np.where(left.diagonal() > least, left.diagonal(), 0.0)
        p = int(np.argmax(above))
        if above[p] <= 0:
            break
        column = left[:, p] / np.sqrt(left[p, p])
        left = left - np.outer(column, column)
        left[p, :] = left[:, p] = 0.0
        out.append(column)
    return np.array(out).T.reshape(len(a), len(out))


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """Rotate the columns of ``factor`` until any two are orthogonal to double precision.

    A sweep meets every pair once; the pairs of one turn (a round-robin) share
    no column and are rotated together.
    """
    r = factor.shape[1]
    m = np.hstack([factor, np.zeros((len(factor), r % 2))])
    k = m.shape[1]
    seats = np.arange(k)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(k - 1):
            p, q = seats[: k // 2], seats[k // 2 :][::-1]
            u, v = m[:, p], m[:, q]
            a, b, g = (u * u).sum(0), (v * v).sum(0), (u * v).sum(0)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(g), size, out=np.zeros_like(g), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > np.finfo(float).eps
            z = np.divide(b - a, 2 * g, out=np.zeros_like(g), where=turn)
            t = np.where(turn, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
            c = 1 / np.hypot(1.0, t)
            m[:, p], m[:, q] = c * u - c * t * v, c * t * u + c * v
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if worst <= 4 * len(factor) * np.finfo(float).eps:
            break
    return m


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` components (columns) and eigenvalues, falling."""
    rotated = one_sided_jacobi(pivoted_cholesky(covariance))
    e = (rotated * rotated).sum(axis=0)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > 0]
    return rotated[:, order] / np.sqrt(e[order]), e[order]


def distinct_integers(df: DataFrame, column: str) -> DataFrame:
    """The fit list: each distinct ``x`` once, as a written table."""
    return written(with_integers(df, column).select("x").distinct(), "fit-list")


def fit_whitening(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The whitening of each vector length in ``fit_list`` (column x)."""
    sums = sums_by_length(fit_list)
    out = {}
    for d, v in covariance_by_length(fit_list, sums).items():
        out[d] = Fit(*sums[d], *principal(v, components), float(np.trace(v)))
    return out


def identity_errors(fit_list: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For each length: largest absolute entry of (covariance of the whitened fit list - identity)."""

    def start():
        seen: dict[int, np.ndarray] = {}

        def add(x):
            d = x.shape[1]
            w = np.hstack([np.ones((len(x), 1)), fits[d].whiten(x)])
            seen[d] = seen.get(d, 0) + w.T @ w

        def rows():
            return [(d, i, j, float(m[i, j])) for d, m in seen.items() for i in range(len(m)) for j in range(i, len(m))]

        return add, rows

    added = _per_task(fit_list, start, "d int, i int, j int, p double").groupBy("d", "i", "j").agg(F.sum("p").alias("p"))
    moments = {d: np.zeros((len(f.eigenvalues) + 1,) * 2) for d, f in fits.items()}
    for r in added.collect():  # (components + 1)^2 / 2 numbers a length
        moments[r["d"]][r["i"], r["j"]] = moments[r["d"]][r["j"], r["i"]] = r["p"]
    out = {}
    for d, m in moments.items():
        mean = m[0, 1:] / fits[d].n
        cov = m[1:, 1:] / fits[d].n - np.outer(mean, mean)
        out[d] = float(np.abs(cov - np.eye(len(cov))).max(initial=0.0))
    return out


def whiten(df: DataFrame, column: str, fits: dict[int, Fit]) -> DataFrame:
    """Rows with a finite vector and its ``whitened`` entries and ``deviation``.

    A vector of a length that was not fitted is left out.
    """

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            white, far = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for rows, x in by_length(batch, "x"):
                fit = fits[x.shape[1]]
                far[rows] = fit.deviation(x)
                for r, w in zip(rows, fit.whiten(x)):
                    white[r] = w
            return [pa.array(white, pa.list_(pa.float64())), pa.array(far)]

        return work

    known = with_integers(df, column).where(F.size("x").isin([*fits]))
    return append_columns(known, make, [("whitened", "array<double>"), ("deviation", "bigint")]).drop("x")


def op11_embedding_whitening(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fit_list = distinct_integers(vectors, "embedding")
    fits = fit_whitening(fit_list)
    errors = identity_errors(fit_list, fits)
    schema = "d int, component int, n bigint, explained double, identity_error double"
    told = [(d, k, f.n, float(e / f.trace), errors[d]) for d, f in fits.items() for k, e in enumerate(f.eigenvalues, 1)]
    facts = spark.createDataFrame(told, schema)  # 16 rows a vector length
    rows = whiten(vectors, "embedding", fits).select(
        "vec_id", F.size("embedding").alias("d"), "deviation", F.posexplode("whitened").alias("at", "whitened")
    )
    rows = rows.withColumn("component", F.col("at") + 1).join(F.broadcast(facts), ["d", "component"])
    return rows.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
