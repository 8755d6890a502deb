"""Best-fit packing against whole-text tokenization and the packing rules."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bedcensus.llm import packing as P

SF = "/root/testdata/sf0.01"


def check_sequences(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        here = 0
        for offset, length in sorted(parts):
            assert offset == here
            here += length
        assert here <= capacity
    return len(bins)


def whole_text_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_tokenizer())
    return [e.ids + [P.EOS] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_query_equals_whole_text_tokenization(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, ids in zip(docs, whole_text_ids([d["text"] or "" for d in docs])):
        for k, a in enumerate(range(0, len(ids), P.CAPACITY)):
            part = np.asarray(ids[a : a + P.CAPACITY], "<u4")
            want[d["doc_id"], k] = (a, len(part), zlib.crc32(part.tobytes()))
    rows = P.op8_best_fit_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    n = check_sequences(rows, P.CAPACITY)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // P.CAPACITY) + 2


def test_word_cache_is_the_whole_text(spark):
    odd = ["a  b\t c\r\nd", "Ünï code é x", "it's don't 12345", "", " ", "\n\n", "x" * 5000, "a b\x1cc", "<|endoftext|> x"]
    odd += ["ÀÉß Straße ÿ ñÑ", "e\u0301 E\u0301", "ΑΣ Σ", "İi ǅ ªµº", "½ ² ٣", "a\x00b \x7f \x85 \xad \xa0x", "co-op's IT'S we'LL o'dd 's", "日本 語", "<|endoftext|>x<|startoftext|>", "\u2028 \ufeff a\x0bb"]
    tok = P.WordTokenizer(P.default_tokenizer())
    for _ in range(2):  # new, then remembered
        ids, starts = tok.encode(pa.array(odd))
        assert [ids[a:b].tolist() + [P.EOS] for a, b in zip(starts, starts[1:])] == whole_text_ids(odd)


def test_cache_stays_within_its_bound(monkeypatch):
    monkeypatch.setattr(P, "CACHE_PARTS", 50)
    texts = [" ".join(f"wörd{chr(97 + (i * j) % 26)}{chr(97 + j % 26)} 日{i * j}" for j in range(20)) for i in range(40)]
    tok = P.WordTokenizer(P.default_tokenizer())
    got = []
    for a in range(0, 40, 4):
        ids, starts = tok.encode(pa.array(texts[a : a + 4]))
        got += [ids[x:y].tolist() + [P.EOS] for x, y in zip(starts, starts[1:])]
        assert len(tok.young) <= 50 and len(tok.old) <= 50
    assert got == whole_text_ids(texts)


def test_slices_cover_all_rows(monkeypatch):
    monkeypatch.setattr(P, "SLICE_BYTES", 10)
    column = ["", "x" * 4, "x" * 6, "x", "x" * 30, "", "é" * 5, "", "xx"]
    for step in (1, 2, 9):
        batches = [pa.RecordBatch.from_pydict({"text": column[a : a + step]}) for a in range(0, 9, step)]
        runs = [b.column(0).to_pylist() for b in P._slices(iter(batches))]
        assert [t for r in runs for t in r] == column and all(runs)
        assert all(len(r) == 1 or sum(len(t.encode()) for t in r) <= 10 or r[0] == "x" * 30 for r in runs)
    assert list(P._slices(iter([pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]))) == []


def test_ids_survive_the_binary_form(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b " * 5000)], "doc_id bigint, text string")
    )
    rows = docs.collect()
    want = dict(zip([r["doc_id"] for r in rows], whole_text_ids([r["text"] or "" for r in rows])))
    packed = P.pack_documents(docs, with_ids=True)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = {}
    for r in sorted(packed.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == want
    values = pa.array([b"\1\0\0\0\2\0\0\0", b"", b"\3\0\0\0"])
    assert P.unpacked(values).to_pylist() == [[1, 2], [], [3]]
    assert P.unpacked(values.slice(1)).to_pylist() == [[], [3]] and P.unpacked(values.slice(3)).to_pylist() == []


def test_pieces_of_one_copied_text_are_ranked_in_many_buckets(spark):
    """Copies under one id and text have numbers of their own."""
    docs = spark.range(3000).selectExpr("1 as doc_id", "'same words' as text")
    rows = P.pack_documents(docs).collect()
    assert len(rows) == 3000 and check_sequences(rows, P.CAPACITY) == -(-3000 * rows[0]["length"] // P.CAPACITY)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_places_every_rank_once(counts):
    cap = 60
    plan, bins = P.packing_plan(dict(counts), cap)
    seen, fill, large = {}, {}, {}
    for length, rank, n, per, first, offset in plan:
        for j in range(n):
            assert (length, rank + j) not in seen
            seen[length, rank + j] = 1
            b = first + j // per
            fill.setdefault(b, []).append((offset + (j % per) * length, length))
            large[b] = large.get(b, 0) + (3 * length > cap)
    assert len(seen) == sum(counts.values())
    assert len(fill) == bins and max(large.values(), default=0) <= 2
    for parts in fill.values():
        here = 0
        for o, n in sorted(parts):
            assert o == here
            here += n
        assert here <= cap


def first_fit_decreasing(lengths, cap):
    room = []
    for n in sorted(lengths, reverse=True):
        for i, r in enumerate(room):
            if r >= n:
                room[i] -= n
                break
        else:
            room.append(cap - n)
    return len(room)


def test_plan_is_no_worse_than_first_fit_decreasing():
    rng = random.Random(3)
    for _ in range(20):
        lengths = [min(100, 1 + int(rng.expovariate(1 / 30))) for _ in range(400)]
        counts = {k: lengths.count(k) for k in set(lengths)}
        assert P.packing_plan(counts, 100)[1] <= first_fit_decreasing(lengths, 100) + 1


def test_edges(spark):
    long = "word " * 9000
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, "x y", 5), (None, "x y", 5), (3, "same", 5), (3, "same", 5), (4, long, 5)],
        "doc_id bigint, text string, length int",
    )
    rows = P.pack_documents(docs).collect()
    assert len(rows) == 6 + -(-9001 // P.CAPACITY)
    check_sequences(rows, P.CAPACITY)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    with_ids = P.pack_documents(docs, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)
    assert P.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("buckets", [1, 7])
def test_ranks_do_not_depend_on_bucket_size(spark, buckets):
    pieces = spark.range(500).selectExpr("id as doc_id", "0 as piece", "cast(0 as bigint) start", "cast(1 + id % 3 as bigint) length", "id as ids_crc32")
    rows = P.pack(pieces, 10, buckets).collect()
    assert len(rows) == 500
    check_sequences(rows, 10)
