"""Near-duplicate classes against brute force over all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedcensus.llm import near_dedup as N
from bedcensus.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def union_find(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_links(texts, threshold):
    """Weighted Jaccard of all pairs, from word tuples."""

    def grams(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        ws = [w for w in low.split(" ") if w]
        return Counter(tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))) if ws else Counter()

    counts = [grams(t) for t in texts]
    df = Counter(g for c in counts for g in c)
    bound = max(2, -(-sum(len(c) for c in counts) // N.MAX_FREQUENT))
    n = max(len(texts), 2)
    idf = lambda g: 1 + N.IDF_STRENGTH * (min(max(math.log(n / df[g]) / math.log(max(n / bound, 2)), 0), 1) if df[g] >= bound else 1)
    ws = [{g: (1 + math.log(k)) * idf(g) for g, k in c.items()} for c in counts]
    posting = {}
    for i, w in enumerate(ws):
        for g in w:
            posting.setdefault(g, []).append(i)
    sums = [sum(w.values()) for w in ws]
    out, close = [], []
    for i, w in enumerate(ws):
        common = Counter()
        for g, x in w.items():
            for j in posting[g]:
                if j > i:
                    common[j] += min(x, ws[j][g])
        for j, c in common.items():
            s = c / (sums[i] + sums[j] - c)
            if s >= threshold:
                out.append((i, j))
    return out


def test_classes_equal_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    roots = union_find(len(docs), brute_links([t for _, t in docs], N.THRESHOLD))
    want = {docs[i][0]: docs[r][0] for i, r in enumerate(roots)}
    rows = N.op1_minhash_near_dedup(spark, SF).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert got == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in rows)
    assert max(sizes.values()) > 2


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    kinds = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    a, b = 1 + rng.random(len(kinds)), 1 + rng.random(len(kinds))
    half = len(kinds) // 4
    sim = np.minimum(a, b)[half:-half].sum() / (a[:half].sum() + b[-half:].sum() + np.maximum(a, b)[half:-half].sum())
    agree = []
    for k in range(60):
        moved = N.mix(kinds + np.uint64(k))
        order = np.argsort(moved)
        x, y = order[order < len(kinds) - half], order[order >= half]
        keys = N.band_keys([moved[x], moved[y]], [a[x], b[y]])
        agree.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(agree) - sim**N.ROWS) < 0.04


def test_same_text_same_keys_whatever_the_batch():
    texts = ["a b c d e f g", "x", "", "Ä b\tc d  E f"]
    alone = [N.shingles([t])[0] for t in texts]
    for one, many in zip(alone, N.shingles(texts)):
        assert (one == many).all()
    assert (N.shingles(["A B c d e f g"])[0] == alone[0]).all() and len(alone[2]) == 0


def test_blocks_lose_no_pair(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        ws = list(base)
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = {r["doc_id"]: r["class_id"] for r in N.near_duplicate_classes(docs).collect()}
    many = {r["doc_id"]: r["class_id"] for r in N.near_duplicate_classes(docs, block=7).collect()}
    roots = union_find(90, brute_links([t for _, t in rows], N.THRESHOLD))
    assert one == many == dict(enumerate(roots))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i + 100, i + 101) for i in range(30)]
    rows = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    roots = union_find(140, links)
    assert {r["node"]: r["root"] for r in rows} == {i: r for i, r in enumerate(roots) if i != r}


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "one two", 1), (5, "ONE  two", 1), (5, "ONE  two", 1), (None, "one two", 1), (None, "p q r s t u", 1), (7, long, 1), (8, long + " x", 1), (9, "", 1)],
        "doc_id bigint, text string, Class_Id int",
    )
    got = sorted(N.near_duplicate_classes(docs).select("doc_id", "class_id", "class_size").collect(), key=str)
    classes = {(r["doc_id"], r["class_id"], r["class_size"]) for r in got}
    assert len(got) == 11
    assert classes == {(1, 1, 1), (2, 2, 1), (3, 3, 1), (9, 9, 1), (4, 4, 4), (5, 4, 4), (None, 4, 4), (None, None, 1), (7, 7, 2), (8, 7, 2)}
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "9", "4", "None", "7"])
    assert N.near_duplicate_classes(docs.limit(0)).count() == 0
    assert N.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(8))
def test_batches_of_few_words(n):
    words = [f"w{i}" for i in range(n)]
    long = [f"x{i}" for i in range(9)]
    got = N.shingles([" ".join(words)])[0]
    assert len(got) == (max(n - N.SHINGLE_WORDS + 1, 1) if n else 0)
    assert (got == N.shingles([" ".join(words), " ".join(long)])[0]).all()
    assert [len(g) for g in N.shingles(words)] == [1] * n


def family(n, words, share, seed):
    """n different texts of one template, each with its own few words."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        ws = list(base)
        at = rng.randrange(words)
        for k in range(rng.randrange(share)):
            ws[(at + k) % words] = f"x{rng.randrange(10**7)}"
        rows.append((i, " ".join(ws) + f" end{i}"))
    return rows


def test_rows_to_verify_grow_with_a_family(spark):
    """One family: the rows of the groups are in proportion to it."""
    made = {}
    for n in (1500, 6000):
        docs = spark.createDataFrame(family(n, 90, 4, 3), "doc_id bigint, text string")
        keyed = docs.withColumn("node", F.xxhash64("text"))
        sketches = N.written(N._sketches(keyed, N.Weights(keyed)), "t-sketches")
        inside = N.written(N.shared_buckets(sketches), "t-inside")
        largest = inside.agg(F.max("n")).first()[0]
        assert largest > n // 4
        groups = N.first_groups(inside, 200)
        made[n] = (groups.count() / inside.count(), groups.groupBy("bucket", "g").count().agg(F.max("count")).first()[0])
    assert all(per < 1.5 for per, _ in made.values())
    assert all(most <= 400 for _, most in made.values())
    classes = {r["class_id"] for r in N.near_duplicate_classes(spark.createDataFrame(family(1500, 90, 4, 3), "doc_id bigint, text string"), block=200).collect()}
    assert classes == {0}


@pytest.mark.parametrize("seed", range(2))
def test_loose_families_in_large_buckets_equal_brute_force(spark, seed, monkeypatch):
    """Families whose members are partly too far apart, few pivots, small blocks."""
    monkeypatch.setattr(N, "PIVOTS", 2)
    rows = family(70, 60, 12, seed) + [(100 + i, t) for i, t in family(60, 40, 9, seed + 10)]
    rows += [(200 + i, f"{t} and a tail of other words to make it differ a bit {i}") for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    roots = union_find(len(rows), brute_links([t for _, t in rows], N.THRESHOLD))
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicate_classes(docs, block=6).collect()}
    assert got == {rows[i][0]: rows[r][0] for i, r in enumerate(roots)}


def test_recall_on_planted_near_copies(spark):
    """Copies of long texts with a few words changed, all at 0.8 or above: each is found."""
    rng = random.Random(6)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r["text"] and len(r["text"].split()) > 80][:150]
    planted = []
    for i, t in docs:
        ws = t.split()
        for _ in range(max(1, len(ws) // 60)):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
        planted.append((10**6 + i, " ".join(ws)))
    rows = docs + planted
    roots = union_find(len(rows), brute_links([t for _, t in rows], N.THRESHOLD))
    near = [k for k in range(len(docs)) if roots[k] == roots[len(docs) + k]]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = sum(got[docs[k][0]] == got[planted[k][0]] for k in near)
    assert len(near) >= 100 and found == len(near)
