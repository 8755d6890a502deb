"""Suffix-automaton decontamination against DuckDB and a brute-force scan."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from bedcensus.llm import decontaminate as D
from compare import assert_same
from oracle_check import duck

SF = "/root/testdata/sf0.01"


def brute(words, items, window):
    hit, found = set(), set()
    for item, ws in items:
        m = min(len(ws), window)
        grams = {tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)} if ws else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i : i + m]) in grams:
                hit.update(range(i, i + m))
                found.add(item)
    return hit, found


_seq = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(_seq, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"z"]), max_size=40))
def test_automaton_equals_brute_force(items, words):
    items = [(str(i), ws) for i, ws in enumerate(items)]
    spans, found = D.ItemAutomaton(items, 4).scan(words)
    hit, want = brute(words, items, 4)
    assert {p for a, b in spans for p in range(a, b)} == hit
    assert found == want


def test_query_equals_sql(spark):
    assert_same(D.op7_decontaminate(spark, SF), duck(SF), D.OP7_SQL, "op7")


def test_blocks_give_the_same_hits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = D.judged(D.find_contamination(docs, bench)).drop("text")
    many = D.judged(D.find_contamination(docs, bench, max_block_words=600)).drop("text")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_edges_and_cutting(spark):
    gram = " ".join(f"w{i}" for i in range(13))
    bench = spark.createDataFrame([(1, gram), (1, gram), (2, None), (3, "--"), (None, "Short Item")], "item_id bigint, text string")
    filler = " ".join(f"f{i}" for i in range(400))
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, f"{filler}, {gram.upper()}! end", 1), (4, gram, 1), (4, gram, 1), (None, "a short, ITEM", 1), (6, "short items", 1)],
        "doc_id bigint, text string, N_WORDS int",
    )
    rows = D.judged(D.find_contamination(docs, bench)).collect()
    got = {(r["doc_id"], (r["text"] or "")[:8]): (r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"]) for r in rows}
    assert len(rows) == 7
    assert got[1, ""] == (0, 0, [], False)
    assert got[3, "f0 f1 f2"] == (414, 13, ["1"], False)
    assert got[4, "w0 w1 w2"] == (13, 13, ["1"], True)
    assert got[None, "a short,"] == (3, 2, ["null"], True)
    assert got[6, "short it"][1] == 0
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(by) == {1, 2, 3, 6}
    assert by[1] is None and by[3] == f"{filler}, ! end"
    assert D.decontaminate(docs, bench.limit(0)).count() == 7
    assert D.decontaminate(docs.limit(0), bench).count() == 0
