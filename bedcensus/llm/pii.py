"""Personal data by base patterns and a skip-chain CRF (operator 3).

Base spans are what the four patterns define (``base_spans``); they always
stay.  The conditional random field labels the active tokens of a text: blank-
separated pieces that hold a digit, an ``@``, a ``+`` or a dot between letters,
and the pieces around a written-out ``at`` before a dotted one; all other tokens
are fixed to "no entity", which cuts the chain there.  Its potentials:

* node: shape, length, punctuation and neighbouring words of a token;
* chain: labels of active tokens that follow each other directly;
* skip: labels of distant tokens that repeat or resemble each other (the same
  characters without punctuation, or the same shape), each linked to the next
  such token in the text, so a text of n tokens has at most 3 n edges.

Potentials are learned by maximising the pseudo-likelihood on at most about
``MAX_TRAIN_DOCS`` texts.  Each is learned from twice: as it is, labelled by its
base spans, and with some of its entities hidden from the patterns (``hide``: a
phone number loses its plus, a card number has other marks between its groups, an
address loses its dots or ``@``) or mentioned again in such a form; those keep their labels.  So shapes
that the patterns reject, and repeats of what they accept, are learned as
entities, and a third of the entity tokens is learned from context and links
alone.  Inference
is loopy sum-product message passing over each whole text; all texts of a batch
are passed through together.  Tokens labelled as an entity that meet no base
span become added spans (neighbouring tokens of one label are one span).

Edge cases: a null or empty text has no spans; texts of any length are scanned
in linear time, with or without a model; without active tokens to learn from, only base spans are
returned; a null doc_id is kept; repeated rows are scanned alike; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, clean_text, crc32, expand_rows, read_table, texts

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
MAX_TRAIN_DOCS = 4000
HASHED = 1 << 11
MESSAGE_ROUNDS = 8
#: Least marginal probability of an added span's tokens.
MIN_MARGINAL = 0.6

# The base patterns.  A local part or digit run is matched from
# its start only, which gives the same leftmost matches in linear time.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@+]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start; leftmost, non-overlapping per kind."""
    if not _HINT.search(text):
        return []
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: What makes a token active: one of these, or a dot between letters.
_DOT = re.compile(r"\.(?=[A-Za-z])")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_BLANKS = frozenset("\x20\x09\n\x0b\x0c\r")
_AT = re.compile(r"\x20[\[({]?at[\])}]?\x20", re.I)
#: A written-out @ between a name and a dotted token.
_SPELT_AT = re.compile(r"(?<![^\x20\x09-\x0D])([A-Za-z0-9._%+-]{2,64})\x20([\[({]?at[\])}]?)\x20(?=[A-Za-z0-9-]{1,64}(?:\.[A-Za-z0-9-]{1,64})+)", re.I)
_EDGE = "\"'()[]{}<>,;:!?*|#$%&="
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]*\Z")
_WORD_AFTER = re.compile(r"[^\w]*([^\W\d_]+)")


@cache
def _bucket(name: str) -> int:
    h = 2166136261
    for c in name.encode("utf-8", "surrogatepass"):
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % HASHED


def shape_of(token: str) -> str:
    """Letters as a, digits as 9, runs of up to three kept."""
    out = ""
    for c in token[:64]:
        c = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if out[-3:] != c * 3:
            out += c
    return out


def active_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the active tokens, punctuation at their edges left out."""
    at = [m.start() for m in _HINT.finditer(text)]
    dots = [k for k in (m.start() for m in _DOT.finditer(text)) if k and text[k - 1] in _LETTERS]
    if dots:
        at = sorted(at + dots)
    out, end = [], 0
    for k in at:
        if k < end:
            continue
        start = k
        while start > end and text[start - 1] not in _BLANKS:
            start -= 1
        found = _SPACE.search(text, k)
        end = found.start() if found else len(text)
        t = text[start:end]
        a = start + len(t) - len(t.lstrip(_EDGE))
        b = a + len(t.strip(_EDGE).rstrip("."))
        if a < b:
            out.append((a, b))
    if not _AT.search(text):
        return out
    spelt = {m.span(k) for m in _SPELT_AT.finditer(text) for k in (1, 2)}
    return sorted(spelt.union(out)) if spelt else out


def token_features(text: str, a: int, b: int) -> list[int]:
    """Hashed features of the token text[a:b]."""
    t = text[a:b]
    digits = sum("0" <= c <= "9" for c in t)
    before = _WORD_BEFORE.search(text, max(a - 24, 0), a)
    after = _WORD_AFTER.match(text, b, b + 24)
    names = [
        "bias",
        f"digits {min(digits, 20)}",
        f"letters {min(sum(c.isalpha() for c in t), 4)}",
        f"length {min(len(t), 24) // 2}",
        f"dots {min(t.count('.'), 4)}",
        f"dashes {min(t.count('-'), 4)}",
        f"ats {min(t.count('@'), 2)}",
        f"plus {t[0] == '+'}",
        f"brackets {'(' in t or ')' in t}",
        f"shape {shape_of(t)}",
        f"card {13 <= digits <= 19 and luhn(_digits(t))}",
        f"before {before.group(1).lower() if before else ''}",
        f"after {after.group(1).lower() if after else ''}",
        f"ends {text[max(a - 1, 0) : a].strip(' ')}|{text[b : b + 1].strip(' ')}",
        f"groups {'.'.join(str(len(g)) for g in _DIGITS.findall(t)[:6])}",
    ]
    return [_bucket(n) for n in names]


_DIGITS = re.compile("[0-9]+")
N_FEATURES = 15
#: Features that say what a token looks like (the rest is context).
SHAPE_FEATURES = slice(1, 11)


def text_graph(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[tuple[int, int, int]]]:
    """Active tokens, their features, and edges (kind, i, j): 0 chain, 1 repeat, 2 alike."""
    spans = active_tokens(text)
    features, edges = [], []
    last: dict[tuple[int, str], int] = {}
    for i, (a, b) in enumerate(spans):
        features.append(token_features(text, a, b))
        if i and a - spans[i - 1][1] <= 3 and text[spans[i - 1][1] : a].strip(_EDGE + ".").isspace():
            edges.append((0, i - 1, i))
        core = "".join(c for c in text[a:b].lower() if c.isalnum())
        for kind, key in ((1, core), (2, shape_of(text[a:b]))):
            j = last.get((kind, key))
            if j is not None and (kind == 1 or j != last.get((1, core))):
                edges.append((kind, j, i))
            last[kind, key] = i
    # the loop above has set this token's own keys; a repeat is not also an alike edge
    repeats = {(i, j) for k, i, j in edges if k == 1}
    return spans, features, [e for e in edges if e[0] != 2 or (e[1], e[2]) not in repeats]


class SkipChain:
    """Potentials: node weights (HASHED x LABELS) and one matrix per edge kind."""

    def __init__(self, node: np.ndarray, pair: np.ndarray):
        self.node, self.pair = node, pair

    @staticmethod
    def fit(features: np.ndarray, edges: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> "SkipChain":
        """Pseudo-likelihood: each label given the labels of its neighbours (Adagrad on all tokens)."""
        n = len(labels)
        node, pair = np.zeros((HASHED, LABELS)), np.zeros((3, LABELS, LABELS))
        g_node, g_pair = np.full(node.shape, 1e-8), np.full(pair.shape, 1e-8)
        truth = np.eye(LABELS)[labels]
        kinds, i, j = edges.T if len(edges) else np.zeros((3, 0), np.int64)
        for _ in range(rounds):
            logits = node[features].sum(axis=1)
            np.add.at(logits, i, pair[kinds, :, labels[j]])
            np.add.at(logits, j, pair[kinds, labels[i], :])
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - truth) / n
            d_node = ridge * node / n
            np.add.at(d_node, features.reshape(-1), np.repeat(error, features.shape[1], axis=0))
            d_pair = ridge * pair / n
            np.add.at(d_pair.transpose(0, 2, 1), (kinds, labels[j]), error[i])
            np.add.at(d_pair, (kinds, labels[i]), error[j])
            g_node += d_node**2
            g_pair += d_pair**2
            node -= rate * d_node / np.sqrt(g_node)
            pair -= rate * d_pair / np.sqrt(g_pair)
        return SkipChain(node, pair)

    def marginals(self, features: np.ndarray, edges: np.ndarray, rounds: int = MESSAGE_ROUNDS) -> np.ndarray:
        """Loopy belief propagation; edges of all texts at once."""
        unary = self.node[features].sum(axis=1)
        if not len(edges):
            return _softmax(unary)
        kinds, i, j = edges.T
        forth = np.exp(self.pair[kinds])  # [edge, label of i, label of j]
        back = forth.transpose(0, 2, 1)
        to_j = np.zeros((len(edges), LABELS))  # log messages
        to_i = np.zeros((len(edges), LABELS))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, j, to_j)
            np.add.at(belief, i, to_i)
            new_j = np.log(np.einsum("ea,eab->eb", _softmax(belief[i] - to_i), forth))
            new_i = np.log(np.einsum("ea,eab->eb", _softmax(belief[j] - to_j), back))
            # damping, and messages normalised to a mean of zero
            to_j = 0.5 * (to_j + new_j - new_j.mean(axis=1, keepdims=True))
            to_i = 0.5 * (to_i + new_i - new_i.mean(axis=1, keepdims=True))
        belief = unary.copy()
        np.add.at(belief, j, to_j)
        np.add.at(belief, i, to_i)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def token_labels(spans: list[tuple[int, int]], base: list[Span]) -> list[int]:
    """Each token's label: the kind of the first base span (by kind, then start) that meets it.

    One sweep a kind over tokens and spans, both in order of their places.
    """
    out = [OTHER] * len(spans)
    by_kind: dict[int, list[Span]] = {}
    for s in base:
        by_kind.setdefault(s[0], []).append(s)
    for kind in sorted(by_kind, reverse=True):
        found, at = by_kind[kind], 0
        for k, (s, e) in enumerate(spans):
            while at < len(found) and found[at][2] <= s:
                at += 1
            if at < len(found) and found[at][1] < e:
                out[k] = kind
    return out


def _disguises(kind: int, t: str) -> list[str]:
    """Forms of an entity that the base patterns do not take."""
    digits = _digits(t)
    if kind == 0:
        name, _, domain = t.partition("@")
        return [f"{name} at {domain}", f"{name} [at] {domain}", f"{name} (at) {domain}", f"{name}@{domain.split('.')[0]}"]
    if kind == 1:
        return [t.replace(".", "-"), t.replace(".", ","), t.replace(".", "[.]")]
    if kind == 2:
        return [mark.join(digits[k : k + 4] for k in range(0, len(digits), 4)) for mark in (".", "/", "_", " - ")]
    bare = t[1:]
    return [bare, bare.replace(" ", "-").replace("(", "").replace(")", ""), digits, f"00{bare}"]


def hide(text: str, spans: list[Span], seed: int, every: bool = False) -> tuple[str, list[Span]]:
    """``text`` with entities in forms that the patterns miss, and all its entities.

    Of the given spans (one of each overlapping pair) a third is rewritten, a
    third stays and is mentioned again in such a form at the end of its line,
    a third stays as it is; with ``every`` all are rewritten.
    """
    out, found, here, length = [], [], 0, 0
    again: list[tuple[int, str]] = []

    def put(part: str, kind: int | None = None) -> None:
        nonlocal length
        if kind is not None:
            found.append((kind, length, length + len(part)))
        out.append(part)
        length += len(part)

    def mention() -> None:
        for kind, t in again:
            put(" ")
            put(t, kind)
        again.clear()

    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a < here:
            continue
        lines = text[here:a].split("\n")
        put(lines[0])
        for line in lines[1:]:
            mention()
            put("\n" + line)
        t = text[a:b]
        draw = crc32(f"{seed}:{a}:{t}")
        forms = _disguises(kind, t)
        form = forms[draw // 3 % len(forms)]
        if every or draw % 3 == 0:
            put(form, kind)
        else:
            put(t, kind)
            if draw % 3 == 1:
                again.append((kind, form))
        here = b
    first, line_end, rest = text[here:].partition("\n")
    put(first)
    mention()
    put(line_end + rest)
    return "".join(out), sorted(found)


def added_spans(spans: list[tuple[int, int]], edges: list[tuple[int, int, int]], p: np.ndarray, base: list[Span]) -> list[Span]:
    """Entity tokens that meet no base span; chain neighbours of one label are joined."""
    best = p.argmax(axis=1)
    taken = token_labels(spans, base)
    chained = {j for k, _, j in edges if k == 0}
    out: list[Span] = []
    open_ = False
    for i, (a, b) in enumerate(spans):
        kind = int(best[i])
        if kind == OTHER or taken[i] != OTHER or p[i, kind] < MIN_MARGINAL:
            open_ = False
            continue
        if open_ and i in chained and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
        open_ = True
    return out


def _training_rows(docs: DataFrame, max_docs: int) -> DataFrame:
    """At most about ``max_docs`` texts that hold an active token, by a hash of the text."""
    rich = docs.select(clean_text().alias("text")).where(F.col("text").rlike("[0-9@+]|[A-Za-z]\\.[A-Za-z]"))
    n = rich.count()
    share = int(min(1.0, max_docs / max(n, 1)) * 1_000_000)
    return rich.where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1_000_000)) < share)


def training_texts(text: str) -> list[tuple[str, list[Span]]]:
    """What is learned from a text: itself with its base spans, and a copy with hidden entities."""
    base = base_spans(text)
    out = [(text, base)]
    if base:
        shown, entities = hide(text, base, 0)
        known = sorted(base_spans(shown) + entities)  # what a disguise leaves for a pattern is an entity too
        out.append((shown, known))
    return out


def fit_skip_chain(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> SkipChain | None:
    def make():
        def work(batch):
            rows = []
            for t in texts(batch):
                for shown, entities in training_texts(t):
                    spans, features, edges = text_graph(shown)
                    if not spans:
                        continue
                    labels = token_labels(spans, entities)
                    for k, y in enumerate(labels):
                        if y != OTHER and crc32(f"{spans[k]}{shown[slice(*spans[k])]}") % 3 == 0:
                            features[k][SHAPE_FEATURES] = [_bucket("bias")] * len(features[k][SHAPE_FEATURES])
                    rows.append((np.asarray(features, "<i4").tobytes(), np.asarray(edges, "<i4").tobytes(), np.asarray(labels, "<i4").tobytes()))
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["f", "e", "y"])

        return work

    rows = expand_rows(_training_rows(docs, max_docs), make, "f binary, e binary, y binary").collect()  # max_docs texts' tokens
    if not rows:
        return None
    features, edges, labels, n = [], [], [], 0
    for r in sorted(rows):
        y = np.frombuffer(r["y"], "<i4")
        features.append(np.frombuffer(r["f"], "<i4").reshape(-1, N_FEATURES))
        e = np.frombuffer(r["e"], "<i4").reshape(-1, 3)
        edges.append(e + np.asarray([0, n, n]))
        labels.append(y)
        n += len(y)
    return SkipChain.fit(np.concatenate(features).astype(np.int64), np.concatenate(edges).astype(np.int64), np.concatenate(labels).astype(np.int64))


def scan_batch(batch: list[str], model: SkipChain | None) -> list[tuple[list[Span], list[Span]]]:
    """(base, added) spans of each text."""
    found = [(base_spans(t), []) for t in batch]
    if model is None:
        return found
    graphs, n, all_features, all_edges = [], 0, [], []
    for k, t in enumerate(batch):
        spans, features, edges = text_graph(t)
        if spans:
            graphs.append((k, n, spans, edges))
            all_features += features
            all_edges += [(kind, n + i, n + j) for kind, i, j in edges]
            n += len(spans)
    if graphs:
        p = model.marginals(np.asarray(all_features), np.asarray(all_edges, dtype=np.int64).reshape(-1, 3))
        for k, first, spans, edges in graphs:
            found[k] = (found[k][0], added_spans(spans, edges, p[first : first + len(spans)], found[k][0]))
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find_personal_data(docs: DataFrame, model: SkipChain | None) -> DataFrame:
    """Add ``pii``: spans (kind, start, end, base) by kind as listed, then start, in code points."""

    def make():
        def work(batch):
            out = []
            for base, added in scan_batch(texts(batch), model):
                every = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": x} for k, a, b, x in every])
            return [pa.array(out, pa.list_(_SPAN))]

        return work

    return append_columns(docs, make, [("pii", "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")])


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    out, here = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= here:
            out.append(f"{text[here:a]}[{KINDS[kind]}]")
        here = max(here, b)
    return "".join(out) + text[here:]


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _base_count(kind: str):
    return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")


def op3_pii(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, fit_skip_chain(docs)).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    return found.select("doc_id", *map(_base_count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))
