"""Line-window deduplication against SQL and a sequential scan."""

from __future__ import annotations

import random

from bedcensus.llm import line_dedup as L
from compare import assert_same
from oracle_check import duck

SF = "/root/testdata/sf0.01"


def sequential(docs, k=3):
    """Texts in doc order; windows seen before cover lines to remove."""
    seen, out = set(), {}
    for i, text in docs:
        lines = text.split("\n")
        full = [n for n, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for a in range(len(full) - k + 1):
            w = tuple(lines[n] for n in full[a : a + k])
            if w in seen:
                gone.update(full[a : a + k])
            seen.add(w)
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_query_equals_sql(spark):
    assert_same(L.op4_line_dedup(spark, SF), duck(SF), L.OP4_SQL, "op4")


def test_random_lines_equal_a_sequential_scan(spark):
    rng = random.Random(7)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c d", "", " ", "é"]) for _ in range(rng.randrange(14)))) for i in range(60)]
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == sequential(docs)


def test_a_window_in_many_documents_stays_once(spark):
    hot = "one\ntwo\nthree"
    docs = spark.createDataFrame([(i, f"{hot}\nown {i}") for i in range(500)], "doc_id bigint, text string")
    rows = L.dedup_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {i: (f"{hot}\nown {i}" if i == 0 else f"own {i}") for i in range(500)}


def test_edges(spark):
    three = "a\nb\nc"
    long = "\n".join(f"line {i}" for i in range(20_000))
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "x\ny", 1), (4, "x\ny", 1), (5, three, 1), (5, three, 1), (None, three, 1), (6, f"{three}\n\n{three}", 1), (7, long, 1), (8, long, 1)],
        "doc_id bigint, text string, N_Lines int",
    )
    out = L.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else 0, r["text"], r["n_removed"]) for r in out.collect()), key=str)
    got = {}
    for i, t, n in rows:
        got.setdefault(i, []).append((t, n))
    assert got[1] == [(None, 0)] and got[2] == [("", 0)]
    assert got[3] == got[4] == [("x\ny", 0)]
    # the null doc_id comes first and keeps the lines; repeated rows count as one document
    assert got[0] == [(three, 0)] and got[5] == [("", 3), ("", 3)]
    assert got[6] == [("", 6)]
    assert got[7] == [(long, 0)] and got[8] == [("", 20_000)]
    assert L.dedup_lines(docs.limit(0)).count() == 0
