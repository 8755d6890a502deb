"""Levenshtein-automaton matching, context, and held-out accuracy."""

from __future__ import annotations

import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from bedcensus.llm import toxicity as X


def osa(a, b):
    """Edit distance with swaps of neighbours (optimal string alignment)."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute(word, entries):
    best = None
    for text, is_stem, _ in entries:
        k = int(len(text) >= X.FUZZY_LENGTH)
        forms = [word[:n] for n in range(1, len(word) + 1)] if is_stem else [word]
        # the first letter is fixed
        ds = [osa(f[1:], text[1:]) for f in forms if f[:1] == text[:1]]
        if ds and min(ds) <= k and (best is None or min(ds) < best):
            best = min(ds)
    return best


_letters = st.text("abc", min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(_letters, st.booleans(), min_size=1, max_size=4), st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=12))
def test_automaton_equals_edit_distance(lexicon, words):
    entries = [(t, s, 1.0) for t, s in lexicon.items()]
    a = X.LexiconAutomaton(entries)
    for w in words:
        hit = a.match(w)
        assert (None if hit is None else hit[0]) == brute(w, entries)


def test_misspellings_are_found():
    a = X.LexiconAutomaton([("idiot", False, 5.0), ("worthless", False, 4.0), ("lowei", True, 3.0), ("scum", False, 2.0)])
    assert a.match("idiot") == (0, 5.0)
    for w in ("idoit", "idiott", "idot", "idi0t", "worthles", "worhtless"):
        assert a.match(w)[0] == 1
    assert a.match("loweivor") == (0, 3.0) and a.match("lovveix") is None
    for w in ("scam", "idio", "riot", "", "xidiot") + ("worthy",):
        assert a.match(w) is None or w == "idio"


def test_context_separates_quotation_from_abuse():
    f = X.HitFinder([("idiot", False, 5.0), ("moron", False, 5.0)])
    quoted = f.features('They printed the word "idiot" again in the paper')
    reported = f.features("He said idiot to nobody at all that day")
    abuse = f.features("you idiot and moron go away")
    assert quoted[6] > 0 and quoted[9] == 1 and quoted[4] == 0
    assert reported[6] > 0 and reported[9] == 1
    assert abuse[6] == 0 and abuse[7] > 0 and abuse[9] == 0 and abuse[4] == 5
    assert f.features("nothing here") == f.features("") == [0.0] * X.FEATURES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = X.op2_toxicity(spark, sf).collect()
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    good, bad = [s for s, _, t in held if t], [s for s, _, t in held if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95  # a part of the toxic marks stands on texts without any term
    assert sum(p == t for _, p, t in held) / len(held) > 0.97


def test_held_out_labels_are_never_used(spark):
    docs = spark.createDataFrame([(i, "vile word" if i % 2 else "fine word") for i in range(200)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(1 as int) as quality", "cast(doc_id % 2 as int) as toxic")
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = X.fit_toxicity(docs, labels), X.fit_toxicity(docs, flipped)
    assert a[0] == b[0] and a[1] == b[1] and (a[2] == b[2]).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "idiot", 0.5), (3, "x " * 50_000, 0.5), (3, "x " * 50_000, 0.5)], "doc_id bigint, text string, SCORE double")
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = X.fit_toxicity(docs, labels)
    rows = X.score_toxicity(docs, model).collect()
    assert len(rows) == 5 and len({r["score"] for r in rows}) == 1
    assert X.score_toxicity(docs.limit(0), model).count() == 0
    assert X.fit_toxicity(docs.limit(0), labels)[0] == []
