"""Toxicity scores from a learned lexicon and Levenshtein automata (operator 2).

1. Lexicon: words and word stems that are much more frequent in the toxic than
   in the other labelled training texts, and that stand between many different
   neighbours (which leaves out words that merely stand in copies of one toxic
   text); of a stem and its extensions the one that separates best is taken.
2. Matching: the lexicon's trie is intersected with a Levenshtein automaton
   (substitution, insertion, deletion, swap of neighbours); the product is made
   deterministic as words are read.  Entries of ``FUZZY_LENGTH`` letters or
   more may differ by one edit, shorter ones by none.  The first letter is
   never edited: a term whose first letter is wrong, missing or swapped is not
   found.
3. Context: a hit inside quotation marks or after a reporting verb counts as
   quoted; one near another hit or near an address to the reader counts as
   abuse.
4. A logistic regression on the counts of such hits gives the score.

Learning uses labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
about ``MAX_TRAIN_ROWS`` of them, taken by a hash of the id; scoring reads every
text whole.  Inputs of the score are words of the text alone.

Edge cases: a null or empty text gets the score of a text without hits; labels
without a document, or with null id or mark, are ignored, and repeated ones
count as often as they occur; without labels of both kinds every score is
their (smoothed) share; null ids are never held out; repeated rows are scored
alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, clean_text, expand_rows, read_table, texts, without, written

MAX_TRAIN_ROWS = 20_000
MIN_TERM_DOCS = 5
MIN_ODDS = 20.0
STEM_LENGTHS = range(4, 8)
FUZZY_LENGTH = 5
CONTEXT_WORDS = 8
SEEN_WORDS = 1_000_000

# Marks of quotation, verbs that report speech, and address to the reader.
QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|‘[^’\n]*’')
REPORTING = frozenset(
    "said says saying called calls quote quoted quotes wrote writes term word phrase slur sagte nannte zitat wort dit appelé mot citation dijo llamó palabra cita".split()
)
ADDRESS = frozenset("you your yours you're u ur yourself du dich dir dein deine ihr euch tu toi te ton ta vous votre tú usted ustedes eres tus".split())
_WORD = re.compile(r"[^\W_]+")

FEATURES = 10


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class LexiconAutomaton:
    """Product of the lexicon's trie and a Levenshtein automaton, determinised lazily.

    ``entries``: (text, is_stem, weight).  A state is a set of (trie node,
    edits); a swap in progress is (trie node after it, edits, expected letter).
    """

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        self.limit = [0]  # edits allowed to entries at or below the node
        for text, is_stem, weight in entries:
            v, path = 0, [0]
            for c in text:
                nxt = self.children[v].get(c)
                if nxt is None:
                    nxt = self.children[v][c] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                v = nxt
                path.append(v)
            (self.stem if is_stem else self.word)[v] = weight
            for u in path:
                self.limit[u] = max(self.limit[u], int(len(text) >= FUZZY_LENGTH))
        self.own = {}  # edits allowed to the entry that ends here
        for text, _, _ in entries:
            v = 0
            for c in text:
                v = self.children[v][c]
            self.own[v] = int(len(text) >= FUZZY_LENGTH)
        self.alphabet = {c for text, _, _ in entries for c in text}
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stem_hit: list[tuple[int, float] | None] = []
        self.word_hit: list[tuple[int, float] | None] = []
        # the first letter is never edited
        self.start = self._state({(0, 0)}, False)

    def _state(self, items: set, grow: bool = True) -> int:
        todo = list(items) if grow else []
        while todo:  # a letter missing in the word
            x = todo.pop()
            if len(x) == 2 and x[1] < self.limit[x[0]]:
                for child in self.children[x[0]].values():
                    y = (child, x[1] + 1)
                    if y[1] <= self.limit[child] and y not in items:
                        items.add(y)
                        todo.append(y)
        key = frozenset(items)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            for hits, ends in ((self.stem_hit, self.stem), (self.word_hit, self.word)):
                found = [(x[1], -ends[x[0]]) for x in key if len(x) == 2 and x[0] in ends and x[1] <= self.own[x[0]]]
                hits.append((min(found)[0], -min(found)[1]) if found else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        first = state == self.start
        out = set()
        for x in self.states[state]:
            if len(x) == 3:
                if x[2] == c:
                    out.add((x[0], x[1]))
                continue
            v, e = x
            children = self.children[v]
            if c in children:
                out.add((children[c], e))
            if first:
                continue
            if e < self.limit[v]:
                out.add((v, e + 1))  # an extra letter in the word
            for letter, child in children.items():
                if e < self.limit[child]:
                    if letter != c:
                        out.add((child, e + 1))  # a wrong letter
                    after = self.children[child].get(c)
                    if after is not None and letter != c:
                        out.add((after, e + 1, letter))  # swapped neighbours
        return self._state(out)

    def match(self, word: str) -> tuple[int, float] | None:
        """(edits, weight) of the entry nearest to a word, or None."""
        state, best = self.start, None
        for c in word:
            if c not in self.alphabet:
                c = "\0"
            moves = self.moves[state]
            nxt = moves.get(c)
            if nxt is None:
                nxt = moves[c] = self._move(state, c)
            if not self.states[nxt]:
                return best
            state = nxt
            hit = self.stem_hit[state]
            if hit is not None and (best is None or hit[0] < best[0]):
                best = hit
        hit = self.word_hit[state]
        return hit if hit is not None and (best is None or hit[0] <= best[0]) else best


class HitFinder:
    """Lexicon hits of a text; verdicts on words are remembered."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.automaton = LexiconAutomaton(entries)
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, float]] = {}

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORD.findall(low)
        kinds = set(words)
        new = kinds - self.seen
        if len(self.seen) + len(new) > SEEN_WORDS:
            self.seen.clear()
            new = kinds
        for w in new:
            hit = self.automaton.match(w)
            if hit is not None:
                self.hits[w] = hit
        self.seen |= new
        if kinds.isdisjoint(self.hits):
            return [0.0] * FEATURES
        quoted = [m.span() for m in QUOTED.finditer(low)]
        spans = [m.span() for m in _WORD.finditer(low)]
        at = [i for i, w in enumerate(words) if w in self.hits]
        exact = fuzzy = in_quotes = abuse = 0
        weights = [0.0]
        q = 0
        for n, i in enumerate(at):
            edits, weight = self.hits[words[i]]
            exact += edits == 0
            fuzzy += edits > 0
            while q < len(quoted) and quoted[q][1] <= spans[i][0]:
                q += 1
            inside = q < len(quoted) and quoted[q][0] < spans[i][0]
            if inside or not REPORTING.isdisjoint(words[max(i - 4, 0) : i]):
                in_quotes += 1
                continue
            weights.append(weight / (1 + edits))
            near = (n > 0 and i - at[n - 1] <= CONTEXT_WORDS) or (n + 1 < len(at) and at[n + 1] - i <= CONTEXT_WORDS)
            abuse += near or not ADDRESS.isdisjoint(words[max(i - CONTEXT_WORDS, 0) : i + CONTEXT_WORDS + 1])
        direct = len(at) - in_quotes
        return [
            float(exact > 0),
            float(fuzzy > 0),
            math.log1p(exact),
            math.log1p(fuzzy),
            max(weights),
            math.log1p(sum(weights)),
            math.log1p(in_quotes),
            math.log1p(abuse),
            math.log1p(1000 * len(at) / len(words)),
            float(direct == 0),
        ]


def doc_terms(text: str) -> set[str]:
    """Lexicon candidates of a text: "=word", and "^stem" of longer words."""
    out = set()
    for w in set(words_of(text)):
        if len(w) >= 3:
            out.add("=" + w)
            out.update("^" + w[:n] for n in STEM_LENGTHS if len(w) > n)
    return out


def _term_counts(rows: DataFrame, allowed=None) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(allowed)

    def make():
        keep = held.value

        def work(batch):
            counts: dict[str, int] = {}
            for t in texts(batch):
                terms = doc_terms(t)
                for x in terms if keep is None else terms & keep:
                    counts[x] = counts.get(x, 0) + 1
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        return work

    return expand_rows(rows.select("text"), make, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _contexts(rows: DataFrame, allowed: set[str]) -> DataFrame:
    """Of each allowed term, in how many different (word before, word after) places it stands."""
    held = rows.sparkSession.sparkContext.broadcast(allowed)

    def make():
        keep = held.value

        def work(batch):
            out = set()
            for t in texts(batch):
                words = ["", *words_of(t), ""]
                for i in range(1, len(words) - 1):
                    w = words[i]
                    for x in ("=" + w, *["^" + w[:n] for n in STEM_LENGTHS if len(w) > n]):
                        if x in keep:
                            out.add((x, f"{words[i - 1]} {words[i + 1]}"))
            pairs = sorted(out)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["term", "place"])

        return work

    return expand_rows(rows.select("text"), make, "term string, place string").distinct().groupBy("term").agg(F.count("*").alias("n"))


def learn_lexicon(train: DataFrame, n_toxic: int, n_other: int) -> list[tuple[str, bool, float]]:
    """Entries (text, is_stem, weight) from rows with ``text`` and ``toxic``."""
    if not n_toxic or not n_other:
        return []
    least = max(MIN_TERM_DOCS, n_toxic // 400)
    toxic = train.where("toxic = 1")
    frequent = {r["term"]: r["n"] for r in _term_counts(toxic).where(F.col("n") >= least).collect()}
    other = {r["term"]: r["n"] for r in _term_counts(train.where("toxic = 0"), set(frequent)).collect()}
    odds = {x: ((n + 0.5) / (n_toxic + 1)) / ((other.get(x, 0) + 0.5) / (n_other + 1)) for x, n in frequent.items()}
    good = {x for x, o in odds.items() if o >= MIN_ODDS}
    places = {r["term"]: r["n"] for r in _contexts(toxic, good).where(F.col("n") >= least).collect()}
    # most toxic texts per text wrongly hit first; of equals whole words, then longer stems
    value = {x: frequent[x] / (1 + 4 * other.get(x, 0) * n_toxic / n_other) for x in places}
    entries: list[tuple[str, bool, float]] = []
    for x in sorted(places, key=lambda x: (value[x], x[0] == "=", len(x), x), reverse=True):
        text = x[1:]
        if not any(text.startswith(e[0]) or e[0].startswith(text) for e in entries):
            entries.append((text, x[0] == "^", math.log(odds[x])))
    return entries


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Newton's method for a ridge-penalised logistic regression."""
    scale = np.maximum(np.abs(x).max(axis=0, initial=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), x / scale])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:] / scale


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """At most about ``max_rows`` labelled texts, none of them held out."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_held_out())
    n = marks.count()
    part = min(1.0, max_rows / max(n, 1))
    few = marks.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(part * 1_000_000) if part < 1 else F.lit(True))
    # bounded by max_rows, so it may be broadcast
    picked = docs.select("doc_id", clean_text().alias("text")).join(F.broadcast(few), "doc_id")
    return written(picked.select("text", "toxic"), "toxicity-train")


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, bool, float]], float, np.ndarray]:
    """Lexicon, bias and weights."""
    train = training_rows(docs, labels)
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    entries = learn_lexicon(train, n1, n0)
    base = math.log((n1 + 0.5) / (n0 + 0.5))
    if not n1 or not n0:
        return entries, base, np.zeros(FEATURES)
    rows = _featured(train, entries).select("toxic", "features").collect()  # max_rows rows of FEATURES numbers
    bias, weights = fit_logistic(np.asarray([r["features"] for r in rows]), np.asarray([r["toxic"] for r in rows], dtype=float))
    return entries, bias, weights


def _featured(rows: DataFrame, entries) -> DataFrame:
    def make():
        finder = HitFinder(entries)

        def work(batch):
            return [pa.array([finder.features(t) for t in texts(batch)], pa.list_(pa.float64()))]

        return work

    return append_columns(rows, make, [("features", "array<double>")])


def score_toxicity(docs: DataFrame, model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted``; ``docs`` has ``text``."""
    entries, bias, weights = model
    docs = without(docs, ["predicted"])

    def make():
        finder = HitFinder(entries)

        def work(batch):
            x = np.asarray([finder.features(t) for t in texts(batch)])
            return [pa.array(1 / (1 + np.exp(-(x @ weights + bias))), pa.float64())]

        return work

    return append_columns(docs, make, [("score", "double")]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", _held_out().alias("held_out"), "score", "predicted")
