"""The pipeline's stages against brute force on the stage before."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from bedcensus.llm import decontaminate as D
from bedcensus.llm import line_dedup, quality
from bedcensus.llm import near_dedup as N
from bedcensus.llm import packing as P
from oracle_check import duck
from test_decontaminate import brute
from test_near_dedup import brute_links, union_find
from test_packing import check_sequences, whole_text_ids

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in C.STAGES:
        out.append(C.written(stage(spark, out[-1], SF), f"t-{name}"))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert df.where("n_chars <> length(text)").count() == 0


def test_quality_stage_equals_sql(stages):
    want = duck(SF).execute(f"with {quality.quality_sql()} select doc_id from judged where kept").fetchall()
    assert set(by_id(stages[1])) == {r[0] for r in want}


def test_line_stage_equals_sql(stages):
    con = duck(SF)
    con.register("kept_docs", stages[1].toPandas())
    want = con.execute(
        f"with {line_dedup.line_dedup_sql('kept_docs')} select doc_id, text from left_over where n_lines = 0 or n_removed < n_lines"
    ).fetchall()
    assert {i: r["text"] for i, r in by_id(stages[2]).items()} == dict(want)


def test_near_stage_keeps_the_first_of_each_class(stages):
    docs = sorted((i, r["text"]) for i, r in by_id(stages[2]).items())
    roots = union_find(len(docs), brute_links([t for _, t in docs], N.THRESHOLD))
    assert set(by_id(stages[3])) == {docs[r][0] for r in roots}


def test_decontamination_stage_equals_brute_force(spark, stages):
    items = [(str(r["item_id"]), D.normalised_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for i, r in by_id(stages[3]).items():
        words = D.normalised_words(r["text"])
        hit, _ = brute(words, items, D.WINDOW)
        if not hit or 20 * len(hit) < len(words):
            want[i] = [w for k, w in enumerate(words) if k not in hit]
    got = by_id(stages[4])
    assert {i: D.normalised_words(r["text"]) for i, r in got.items()} == want
    clean = by_id(stages[3])
    assert all(r["text"] == clean[i]["text"] for i, r in got.items() if len(want[i]) == len(D.normalised_words(clean[i]["text"])))


def test_packing_stage_holds_every_token(stages):
    docs = sorted((i, r["text"]) for i, r in by_id(stages[4]).items())
    ids = dict(zip([i for i, _ in docs], whole_text_ids([t for _, t in docs])))
    rows = stages[5].collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == ids
    assert check_sequences(rows, P.CAPACITY) <= -(-sum(map(len, ids.values())) // P.CAPACITY) + 2


def test_run_is_the_stages(spark, stages):
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(C.run(spark, SF).select(*key).collect()) == sorted(stages[5].select(*key).collect())


def test_empty_and_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, 1), (None, "", "en", "s", 0, 1), (2, "few words", "en", "s", 9, 1), (2, "few words", "en", "s", 9, 1)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, PIECE int",
    )
    for rows in (docs, docs.limit(0)):
        here = rows
        for name, stage in C.STAGES:
            here = C.written(stage(spark, here, SF), "t")
        assert here.count() == 0
        here = rows
        for name, stage in C.STAGES[1:]:
            here = C.written(stage(spark, here, SF), "t")
        assert here.count() == (3 if rows is docs else 0)


def test_stages_keep_columns_named_like_their_own(spark):
    """Extra columns keep their values, whatever an operator calls its own columns."""
    own = "n_words N_HIT hit_spans contaminated clean_text _number n_lines N_REMOVED _id _t _lines _full _at _k _K2 _row node root keep kept BASE_FAILED _stratum".split()
    texts = [" ".join(f"{w}{i % 7}{'x' * (i % 5)}" for w in ("alpha", "beta", "gamma", "delta", "omega")) + f" line {i}\nsecond {i}\nthird {i}" for i in range(30)]
    long = [(i, f"{t}\n" + " ".join(f"word{i}q{j}" for j in range(40)), "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(long, "doc_id bigint, text string, lang string")
    docs = docs.select("doc_id", "text", "lang", *[F.concat(F.lit(f"mine {c} "), F.col("doc_id").cast("string")).alias(c) for c in own])
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == 30, name
        for r in rows:
            assert [r[c] for c in own] == [f"mine {c} {r['doc_id']}" for c in own], name
    packed = C.packing(spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(range(30))
