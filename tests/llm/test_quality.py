"""Quality signals, exact binomial bounds and the cutoffs they accept."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from bedcensus.llm import quality as Q
from compare import assert_same
from oracle_check import duck

SF = "/root/testdata/sf0.01"


def brute_signals(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words, w = [], ""
    for c in text + " ":
        if c in blank:
            words += [w] if w else []
            w = ""
        else:
            w += c
    lines = [x for x in text.split("\n") if x.strip(blank)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for ps in at.values() if len(ps) > 1 for i in ps for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_query_equals_sql(spark):
    assert_same(Q.op6_quality_rules(spark, SF), duck(SF), Q.OP6_SQL, "op6")


def test_signals_equal_brute_force(spark):
    rng = random.Random(0)
    cases = [None, "", " \n\t", "a\n\na\n a\nb", "é# * \x0b$\n\r%&|<>", "w " * 9, "w " * 8, "w " * 7, "a b c d e f g h i " * 3, "x " * 20_000]
    cases += [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    for r in Q.quality_signals(docs).collect():
        assert tuple(r[s] for s in Q.SIGNALS) == brute_signals(cases[r["doc_id"]]), cases[r["doc_id"]]


def exact_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 7, 40, 300, 900) for k in (0, 1, 3, 8, 30) if k <= n]
    df = spark.createDataFrame(cases, "n bigint, k bigint").withColumn("p", Q.binomial_tail(F.col("n").cast("double"), F.col("k"), 0.0125))
    for r in df.collect():
        want = exact_tail(r["n"], r["k"], 0.0125) if r["k"] < r["n"] * 0.0125 else 1.0
        assert abs(r["p"] - want) < 1e-9


def labelled(spark, n_good, n_junk):
    junk = F.col("id") >= n_good
    return spark.range(n_good + n_junk).select(
        F.col("id").alias("doc_id"),
        F.lit("en").alias("lang"),
        F.lit(100).cast("bigint").alias("n_words"),
        F.lit(500).cast("bigint").alias("word_chars"),
        F.when(junk, 200).when(F.col("id") % 50 == 0, 20).otherwise(0).cast("bigint").alias("n_symbols"),
        F.lit(0).cast("bigint").alias("n_dup_lines"),
        F.lit(0).cast("bigint").alias("n_repeat_words"),
        F.lit(10).cast("bigint").alias("n_lines"),
        F.lit(False).alias("base_failed"),
        F.when(junk, 0).otherwise(1).alias("quality"),
    )


def test_cutoffs_limit_false_rejection(spark):
    cuts = Q.choose_cutoffs(labelled(spark, 2000, 300)).collect()
    # 2 % of the good texts have 40 thousandths of symbols: cutoffs below that are not accepted
    assert [r["_cut_symbols"] for r in cuts] == [50]
    judged = Q.judge(labelled(spark, 2000, 300), Q.choose_cutoffs(labelled(spark, 2000, 300)))
    assert judged.groupBy("quality").agg(F.sum(F.col("kept").cast("int")).alias("k")).orderBy("quality").collect() == [(0, 0), (1, 2000)]


def test_too_few_labels_accept_nothing(spark):
    assert Q.choose_cutoffs(labelled(spark, 100, 50)).count() == 0


def test_edges(spark):
    good = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, None, None, 1), (2, "en", good, 1), (2, "en", good, 1), (None, None, good, 1), (3, "en", "a b " * 40, 1)], "doc_id bigint, lang string, text string, KEPT int")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (None, 1, 0), (77, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    kept = Q.filter_quality(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("text like 'w0%'").collect()))
    assert Q.filter_quality(docs, labels.limit(0)).count() == 3
    assert Q.filter_quality(docs.limit(0), labels).count() == 0
