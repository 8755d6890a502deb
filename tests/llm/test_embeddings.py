"""Whitening, vector near duplicates and clustering against brute force in numpy."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from bedcensus.llm import clustering as C
from bedcensus.llm import embedding_dedup as E
from bedcensus.llm import whitening as W
from compare import assert_same
from oracle_check import duck

SF = "/root/testdata/sf0.01"
ODD = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0]]


def table(spark, rows, kind="float", extra=""):
    schema = f"vec_id bigint, embedding array<{kind}>, label int"
    return spark.createDataFrame([(i, v, 0) for i, v in rows], schema)


# -- whitening ---------------------------------------------------------------


def integers(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def brute_whitening(vectors):
    """n, S, covariance, falling eigenvalues and components of the distinct integer vectors."""
    x = np.array(sorted({tuple(integers(v)) for v in vectors}))
    z = x - x.mean(axis=0)
    cov = z.T @ z / len(x)
    e, u = np.linalg.eigh(cov)
    return len(x), x.sum(axis=0), cov, e[::-1], u[:, ::-1]


def check_whitening(rows, vectors, most=16):
    n, s, cov, e, u = brute_whitening([v for _, v in vectors])
    k = min(most, len(e))
    assert {(r["vec_id"], r["component"]) for r in rows} == {(i, c) for i, _ in vectors for c in range(1, k + 1)}
    assert len(rows) == len(vectors) * k
    by = {(r["vec_id"], r["component"]): r for r in rows}
    white = np.array([[by[i, c]["whitened"] for c in range(1, k + 1)] for i, _ in vectors])
    x = np.array([integers(v) for _, v in vectors])
    want = (x - s / n) @ u[:, :k] / np.sqrt(e[:k])
    sign = np.sign((white * want).sum(axis=0))
    np.testing.assert_allclose(white, want * sign, atol=1e-7)
    far = [min(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)), 2**63 - 1) for row in x]
    assert [by[i, 1]["deviation"] for i, _ in vectors] == far
    for c in range(k):
        assert abs(by[vectors[0][0], c + 1]["explained"] / (e[c] / np.trace(cov)) - 1) < 1e-5
    assert {r["n"] for r in rows} == {n}
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-6


def test_whitening_of_the_whole_table(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(W.op11_embedding_whitening(spark, SF).collect(), vectors)


def run_whitening(spark, tmp_path, rows, kind="double"):
    table(spark, rows, kind).write.parquet(f"{tmp_path}/embeddings.parquet")
    return W.op11_embedding_whitening(spark, str(tmp_path)).collect()


def test_whitening_with_copies_odd_vectors_and_large_entries(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(200)]
    good += [(1000 + i, good[0][1]) for i in range(90)]
    good.append((2000, [3e6, -2e6, 0.0, 1.0, 2.0]))  # beyond the exact batches in doubles
    rows = run_whitening(spark, tmp_path, good + [(3000 + k, v) for k, v in enumerate(ODD)])
    check_whitening(rows, good)


def test_whitening_without_variance_and_by_length(spark, tmp_path):
    rows = [(i, [float(i), 2.0, float(i * i)]) for i in range(10)] + [(20, [1.0]), (21, [3.0]), (22, [1.0]), (30, [1.0] * 7), (31, None)]
    out = run_whitening(spark, tmp_path, rows)
    assert {r["vec_id"] for r in out} == {*range(10), 20, 21, 22}  # one distinct vector of length 7
    assert {r["component"] for r in out if r["vec_id"] < 10} == {1, 2}  # the constant dimension has none
    assert sorted(abs(round(r["whitened"], 9)) for r in out if r["vec_id"] >= 20) == [1.0, 1.0, 1.0]
    assert {r["explained"] for r in out if r["vec_id"] >= 20} == {1.0}


def test_whitening_of_no_rows(spark, tmp_path):
    assert run_whitening(spark, tmp_path, [(1, None)]) == []


def test_deviation_beyond_a_long_is_the_largest_long():
    fit = W.Fit(10**9, np.array([0, 0], object), np.eye(2), np.ones(2), 2.0)
    assert fit.deviation(np.array([[10**6, 1], [3, 4]])).tolist() == [2**63 - 1, 2**63 - 1]
    fit = W.Fit(10**4, np.array([5, 7], object), np.eye(2), np.ones(2), 2.0)
    assert fit.deviation(np.array([[3, 4]])).tolist() == [(30000 - 5) ** 2 + (40000 - 7) ** 2]


def test_factor_and_rotation_keep_small_eigenvalues():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    scale = 10.0 ** -np.arange(9)
    a = np.diag(scale) @ (q @ np.diag(np.linspace(1, 2, 9)) @ q.T) @ np.diag(scale)  # graded: condition 1e16
    factor = W.pivoted_cholesky(a)
    np.testing.assert_allclose(factor @ factor.T, a, rtol=1e-6, atol=1e-30)
    e = np.sort((W.one_sided_jacobi(factor) ** 2).sum(axis=0))
    from fractions import Fraction

    # the product of the eigenvalues is the determinant, exactly
    m, det = [[Fraction(float(c)) for c in row] for row in (a + a.T) / 2], Fraction(1)
    for k in range(9):
        det *= m[k][k]
        for i in range(k + 1, 9):
            f = m[i][k] / m[k][k]
            m[i] = [x - f * y for x, y in zip(m[i], m[k])]
    assert abs(float(np.prod(e[-9:])) / float(det) - 1) < 1e-9


# -- near duplicates ---------------------------------------------------------


def brute_links(rows, threshold=0.95):
    """(n_links, component, kept) of each row, over all pairs."""
    def usable(v):
        return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    near = {k: set() for k in range(len(rows))}
    for d in {len(v) for _, v in rows if usable(v)}:
        at = [k for k, (_, v) in enumerate(rows) if usable(v) and len(v) == d]
        x = np.array([rows[k][1] for k in at], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, j in zip(*np.nonzero(x @ x.T >= threshold)):
            if i != j:
                near[at[i]].add(at[j])
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()] - group:
                group.add(m)
                todo.append(m)
        seen |= group
        least = min((rows[m][0] for m in group if rows[m][0] is not None), default=None)
        for m in group:
            out[m] = (rows[m][0], len(near[m]), least, rows[m][0] == least)
    return sorted(out, key=repr)


def found_links(spark, rows, kind="double"):
    out = E.near_duplicate_vectors(table(spark, rows, kind))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def families(rng, d, sizes, spread):
    rows = []
    for s in sizes:
        base = rng.normal(size=d)
        for _ in range(s):
            v = base + spread * rng.normal(size=d)
            rows.append((len(rows), [float(c) for c in v]))
    return rows


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = families(rng, 64, [1] * 600 + [2] * 150 + [7] * 20 + [90], 0.15)
    rows += [(5000 + i, rows[700][1]) for i in range(60)] + [(6000 + k, v) for k, v in enumerate(ODD)]
    rows += [(7000, [0.0] * 64), (7001, [c * 1e300 for c in rows[700][1]]), (7002, [c * 1e-300 for c in rows[3][1]])]
    assert found_links(spark, rows) == brute_links(rows[:-2] + [(7001, rows[700][1]), (7002, rows[3][1])])


@pytest.mark.parametrize("d", [1, 2, 5, 100])
def test_other_lengths_equal_brute_force(spark, d):
    rng = np.random.default_rng(d)
    rows = families(rng, d, [1] * 60 + [5] * 8, 0.05) + [(900, [1.0] * 3), (901, [1.0] * 3), (902, [1.0] * 4)]
    assert found_links(spark, rows) == brute_links(rows)


def test_a_filter_dealt_into_blocks_counts_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 40)
    rng = np.random.default_rng(9)
    rows = families(rng, 32, [1] * 100 + [260, 130], 0.2)
    assert found_links(spark, rows, "float") == brute_links([(i, np.float32(v).tolist()) for i, v in rows])


def test_list_decoding_finds_exactly_the_exceeding_filters():
    rng = np.random.default_rng(10)
    scores = [rng.normal(size=(30, 9)) for _ in range(3)]
    row, name = E.list_decode(scores, 2.5)
    total = scores[0][:, :, None, None] + scores[1][:, None, :, None] + scores[2][:, None, None, :]
    want = {(r, (a * 9 + b) * 9 + c) for r, a, b, c in zip(*np.nonzero(total >= 2.5))}
    assert set(zip(row.tolist(), name.tolist())) == want and len(row) == len(want)


def test_recall_of_pairs_at_the_threshold():
    """Pairs at cosine 0.95 exactly, the hardest that count, share a filter."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * g / np.linalg.norm(g, axis=1)[:, None]
    plan = E.plan_filters(51_282, 64)
    missed = sum(not np.intersect1d(a, b).size for a, b in zip(E.filters_of(x, plan), E.filters_of(y, plan)))
    assert missed <= 4


def test_plans_follow_the_number_of_vectors():
    small, large = E.plan_filters(10_000, 64), E.plan_filters(10_000_000, 64)
    assert small.cap < large.cap and small.words < large.words
    for n, plan in ((10_000, small), (10_000_000, large)):
        assert abs(E.cap_share(64, plan.cap) * n / E.FILTER_VECTORS - 1) < 0.1


def test_ids_null_and_repeated(spark):
    v, w = [1.0, 0.0, 2.0], [-3.0, 1.0, 0.0]
    rows = [(None, v), (4, v), (4, v), (2, w), (None, None), (None, [9.0, 9.0, -9.0])]
    want = [(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (2, 0, 2, True), (None, 0, None, True), (None, 0, None, True)]
    assert found_links(spark, rows) == sorted(want, key=repr)
    assert E.near_duplicate_vectors(table(spark, rows).limit(0)).count() == 0


# -- clustering --------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3, d=64):
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [list(x) for _, x in start]

    def nearest(x):
        far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        at = [nearest(x)[0] for _, x in kept]
        centroids = [
            [sum(col) // len(mine) for col in zip(*mine)] if (mine := [x for (_, x), a in zip(kept, at) if a == c]) else old
            for c, old in enumerate(centroids)
        ]
    out = [(i, *nearest(x)) for i, x in kept]
    total = {}
    for _, c, far in out:
        total[c] = total.get(c, 0) + far
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    clip = lambda v: min(v, 2**63 - 1)
    return sorted(((i, c, clip(far), clip(total[c]), clip(sum(total.values())), digest[c]) for i, c, far in out), key=repr)


def run_clusters(spark, tmp_path, rows):
    table(spark, rows, "double").write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in C.op13_centroid_clustering(spark, str(tmp_path)).collect()), key=repr)


def test_clusters_of_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in C.op13_centroid_clustering(spark, SF).collect()), key=repr) == brute_clusters(rows)


def test_clusters_with_odd_vectors_ties_and_copies(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(i, [float(c) for c in rng.integers(-1, 2, 64) / 64]) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(300)] + [(5, rows[9][1]), (None, rows[8][1])]
    rows += [(900 + k, v) for k, v in enumerate([*ODD, [1.0] * 63, [float("nan")] * 64])]
    assert run_clusters(spark, tmp_path, rows) == brute_clusters(rows)


def test_clusters_of_large_entries_are_exact(spark, tmp_path):
    rng = np.random.default_rng(13)
    rows = [(i, [float(c) for c in rng.normal(size=64) * 10.0**8]) for i in range(30)]
    assert run_clusters(spark, tmp_path, rows) == brute_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, tmp_path, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert run_clusters(spark, tmp_path, rows) == brute_clusters(rows)


def test_queries_equal_their_sql(spark):
    assert_same(E.op12_embedding_near_dedup(spark, SF), duck(SF), E.OP12_SQL, "op12")
    assert_same(C.op13_centroid_clustering(spark, SF), duck(SF), C.OP13_SQL, "op13")


def test_sql_equals_brute_force_where_there_are_links():
    rng = np.random.default_rng(14)
    rows = families(rng, 64, [1] * 50 + [2] * 20 + [7] * 5 + [30], 0.15) + [(900, None), (901, []), (902, [0.0] * 64), (903, [None] + [1.0] * 63)]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64()))}))
    assert sorted(con.execute(E.OP12_SQL).fetchall(), key=repr) == brute_links(rows)
    assert sorted(con.execute(C.OP13_SQL).fetchall(), key=repr) == brute_clusters(rows)
