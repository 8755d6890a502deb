"""Base spans against the plain patterns, message passing against enumeration."""

from __future__ import annotations

import hashlib
import itertools
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bedcensus.llm import pii as X

SF = "/root/testdata/sf0.01"

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    def passes(kind, t):
        d = re.sub("[^0-9]", "", t)
        if kind == 1:
            return all(int(x) <= 255 for x in t.split("."))
        if kind == 2:
            digits = [int(c) for c in d[::-1]]
            total = sum(digits[0::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(d) <= 15

    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if passes(k, m.group())]


_piece = st.sampled_from(["a.b", "x@y.z", "@", "q@", "1", "12", ".", " ", "-", "+", "(", ")", "255", "256", "0001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "é", "10.0.0.1", "\n", "@h.c", "%_"])


@settings(max_examples=500, deadline=None)
@given(st.lists(_piece, max_size=14).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert X.base_spans(text) == plain(text)


def test_query_digests(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = X.op3_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r["doc_id"]])
        text = ",".join(f"{X.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in X.KINDS] == [sum(s[0] == i for s in want) for i in range(4)]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


def test_long_texts_take_linear_time():
    began = time.time()
    for piece in ("a.b-", "1", "1.", "+1", "@", "a@", "1-", "4111 "):
        X.scan_batch([piece * 100_000], None)
    assert time.time() - began < 20


def enumerated(model, features, edges):
    unary = model.node[features].sum(axis=1)
    total = np.zeros((len(features), X.LABELS))
    for ys in itertools.product(range(X.LABELS), repeat=len(features)):
        s = sum(unary[i, y] for i, y in enumerate(ys)) + sum(model.pair[k, ys[i], ys[j]] for k, i, j in edges)
        for i, y in enumerate(ys):
            total[i, y] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(1)
    model = X.SkipChain(rng.normal(size=(X.HASHED, X.LABELS)), rng.normal(size=(3, X.LABELS, X.LABELS)) * 0.5)
    features = rng.integers(0, X.HASHED, (5, 3))
    tree = np.asarray([(0, 0, 1), (1, 1, 2), (2, 1, 3), (0, 3, 4)])
    assert np.allclose(model.marginals(features, tree, 60), enumerated(model, features, tree), atol=1e-6)
    loop = np.asarray([(0, 0, 1), (0, 1, 2), (1, 0, 2), (2, 2, 3)])
    assert np.abs(model.marginals(features[:4], loop, 60) - enumerated(model, features[:4], loop)).max() < 0.1


def test_skip_edges_enforce_consistency(spark):
    # a repeated number is a phone where a base pattern says so; the bare repeat follows it
    rows = [(i, f"call +49 30 {100000 + i} now. also 17.0 percent and {1000 + i} items") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = X.fit_skip_chain(docs)
    text = "call +49 30 555123 (ask) and later call +49 30 555123 4111111111111111"
    base = X.base_spans(text)
    assert [s for s in base if s[0] == 3] == [(3, 5, 18)]
    (_, added), = X.scan_batch([text], model)
    assert any(k == 3 and a == 40 for k, a, b in added)


def test_graph_is_linear():
    text = " ".join(["a1", "+22", "3.3"] * 2000)
    spans, features, edges = X.text_graph(text)
    assert len(spans) == len(features) == 6000 and len(edges) <= 3 * len(spans)


def test_mask():
    assert X.mask("mail a@b.c or +1 234567890", [(0, 5, 10), (3, 14, 26)]) == "mail [email] or [phone]"


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x@y.zz", 1), (3, "x@y.zz", 1), (3, "x@y.zz", 1)], "doc_id bigint, text string, PII int")
    rows = X.find_personal_data(docs, X.fit_skip_chain(docs)).collect()
    assert sorted((str(r["doc_id"]), len(r["pii"])) for r in rows) == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("None", 1)]
    assert X.fit_skip_chain(docs.limit(0)) is None
    assert X.find_personal_data(docs.limit(0), None).count() == 0
    assert X.fit_skip_chain(docs.where("doc_id = 1")) is None


def test_hidden_entities_are_found(spark):
    """Documents whose entities are all rewritten so that no pattern takes them;
    the model learns from other documents."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text is not null")
    model = X.fit_skip_chain(docs.where("crc32(text) % 2 = 0"))
    held = [r["text"] for r in docs.where("crc32(text) % 2 = 1").collect()]
    hidden = right = wrong = added_to_plain = 0
    for a in range(0, len(held), 500):
        shown = [X.hide(t, X.base_spans(t), 7, every=True) for t in held[a : a + 500]]
        for (_, entities), (base, added) in zip(shown, X.scan_batch([t for t, _ in shown], model)):
            entities = [s for s in entities if not any(b[1] < s[2] and s[1] < b[2] for b in base)]
            meet = [any(s[0] == x[0] and x[1] < s[2] and s[1] < x[2] for x in added) for s in entities]
            hidden, right = hidden + len(entities), right + sum(meet)
            wrong += sum(not any(s[0] == x[0] and x[1] < s[2] and s[1] < x[2] for s in entities) for x in added)
        added_to_plain += sum(len(added) for _, added in X.scan_batch(held[a : a + 500], model))
    print(f"hidden {hidden}, found {right}, wrong spans {wrong}, spans added to the {len(held)} documents as they are {added_to_plain}")
    assert hidden > 250 and right >= 0.85 * hidden and wrong <= 0.05 * hidden
    assert added_to_plain <= 0.002 * len(held)


def test_hiding_keeps_track_of_every_entity():
    text = "a joe@corp.example.com b\nc 10.0.0.1; 4111 1111 1111 1111, d +49 30 555123 e\nend 192.168.0.7"
    base = X.base_spans(text)
    assert len(base) == 5
    for seed in range(40):
        shown, entities = X.hide(text, base, seed)
        assert len(entities) >= 5 and all(shown[a:b].strip() == shown[a:b] for _, a, b in entities)
        shown, entities = X.hide(text, base, seed, every=True)
        assert len(entities) == 5 and not {s for s in X.base_spans(shown)} & set(base)
        for (kind, a, b), form in zip(sorted(entities, key=lambda s: s[1]), sorted(base, key=lambda s: s[1])):
            assert kind == form[0] and shown[a:b] in X._disguises(kind, text[form[1] : form[2]])
    assert X.hide("no entity", [], 1) == ("no entity", [])


def test_labels_and_model_take_linear_time(spark):
    rows = [(i, f"call +49 30 {100000 + i} now. also 17.0 percent") for i in range(50)]
    model = X.fit_skip_chain(spark.createDataFrame(rows, "doc_id bigint, text string"))
    took = []
    for n in (4000, 16000):
        text = " ".join(f"+1 (843) 555-{i:05d}" for i in range(n))
        began = time.time()
        X.scan_batch([text], model)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1


def test_labels_equal_the_plain_double_loop():
    rng = np.random.default_rng(5)
    for _ in range(200):
        spans = [(int(a), int(a) + 3) for a in np.flatnonzero(rng.random(40) < 0.4) * 4]
        base = []
        for kind in range(4):
            at = 0
            while at < 150:
                at += int(rng.integers(1, 60))
                n = int(rng.integers(1, 12))
                base.append((kind, at, at + n))
                at += n
        want = [min((k for k, a, b in base if s < b and a < e), default=X.OTHER) for s, e in spans]
        assert X.token_labels(spans, base) == want


def test_spelt_addresses_are_active():
    spans = X.active_tokens("write joe at corp.example or sue (at) x.org, look at that. v. e.g. one.two")
    text = "write joe at corp.example or sue (at) x.org, look at that. v. e.g. one.two"
    assert [text[a:b] for a, b in spans] == ["joe", "at", "corp.example", "sue", "(at)", "x.org", "e.g", "one.two"]
