"""Near-duplicate classes by improved consistent weighted sampling (operator 1).

Texts become sets of five-word shingles (words: runs of non-blank characters,
A-Z lower-cased; a text of fewer words is one shingle).  A shingle weighs
``(1 + ln tf) * idf``; idf falls linearly in ``ln df`` from ``1 + IDF_STRENGTH``
for rare shingles to 1 for one that every document has.  Improved consistent
weighted sampling (Ioffe, 2010) draws ``BANDS * ROWS`` samples of every text;
texts that agree on all rows of a band share a bucket; within buckets, pairs are
verified by the exact weighted Jaccard similarity (>= ``THRESHOLD``); classes
are the connected components of the verified links.

Scale:

* Document frequencies are needed only for frequent shingles: a counter array
  of fixed width over all shingles (summed slice by slice) finds the only
  counters that can hold a shingle of at least ``total / MAX_FREQUENT``
  occurrences, a second pass counts exactly those shingles.  At most
  ``MAX_FREQUENT`` of them exist, which bounds what is broadcast; all others
  weigh as shingles of just that frequency.
* Exact copies are one node (hash of the text) from the start and are never
  paired; the copies' rows are only joined to their node's class at the end.
* Buckets of equal membership are verified once.  A bucket of over ``BLOCK``
  texts is verified in two steps.  First its blocks meet about ``PIVOTS`` of its
  texts: rows in proportion to the bucket.  Most of a family then hangs together
  through the pivots, and pairs inside that largest part need no look.  What is
  left meets every text of the bucket, blocks against blocks, so no pair between
  different parts is left out and no task holds more than two blocks.  Tasks
  emit links of a spanning forest, not pairs.

Edge cases: null texts and texts without words form no class with others; a
null doc_id takes part like any other row and is never chosen as class id
unless the class has nothing else; rows repeating id and text are copies; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, clean_text, expand_rows, read_table, restored, texts, written
from .components import connected_components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 12
ROWS = 2
IDF_STRENGTH = 0.25
COUNTERS = 1 << 20
SLICES = 64
MAX_FREQUENT = 1 << 19
BLOCK = 2048
#: Texts of a large bucket that all its others are compared with first, about.
PIVOTS = 32
HAS_WORD = "[^ \\t\\n\\x0B\\f\\r]"

_U = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = _U(0xD6E8FEB86659FD93)
_SHINGLE_BASE = [_U(pow(0xA0761D6478BD642F, j, 1 << 64)) for j in range(SHINGLE_WORDS)]


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the blank-separated words of a blob."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    full = np.flatnonzero(~_BLANK[raw])
    if not len(full):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(full, prepend=-2) != 1)  # of each word, within full
    sizes = np.diff(first, append=len(full))
    at = np.arange(len(full)) - np.repeat(first, sizes)
    power = np.cumprod(np.full(sizes.max(), _BASE, dtype=np.uint64))
    codes = _BYTE_CODE[raw[full]] * power[at]
    return full[first], mix(np.add.reduceat(codes, first))


def shingles(batch: list[str]) -> list[np.ndarray]:
    """The shingle hashes (with repeats, in text order) of each text."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in batch]
    starts, words = word_hashes(b" ".join(raw))
    ends = np.cumsum([len(r) + 1 for r in raw])
    edges = np.concatenate([[0], np.searchsorted(starts, ends)])
    k = SHINGLE_WORDS
    n = max(len(words) - k + 1, 0)
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        grams += mix(words[j : j + n] + _SHINGLE_BASE[j])
    grams = mix(grams)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= k:
            out.append(grams[a : b - k + 1])
        elif b > a:
            out.append(mix(np.asarray([sum(int(w) * (2 * j + 3) for j, w in enumerate(words[a:b])) % (1 << 64)], dtype=np.uint64)))
        else:
            out.append(words[:0])
    return out


@cache
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), the distribution of ICWS's r and c, and their logarithms."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = 1.0 - np.log1p(-p)
    for _ in range(80):  # Newton's method on 1 - (1 + x) exp(-x) = p
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 4)
    return x, np.log(x)


def weighted(grams: np.ndarray, frequent: np.ndarray, idf: np.ndarray, rare_idf: float) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles (ascending) and their weights."""
    kinds, tf = np.unique(grams, return_counts=True)
    w = np.full(len(kinds), rare_idf)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, kinds), len(frequent) - 1)
        known = frequent[at] == kinds
        w[known] = idf[at[known]]
    return kinds, w * (1 + np.log(tf))


def band_keys(kinds: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """ICWS band keys, one row per (non-empty) text."""
    s, ln_w = np.concatenate(kinds), np.log(np.concatenate(weights))
    sizes = np.asarray([len(k) for k in kinds])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    gamma, ln_gamma = _draws()
    keys = np.zeros((len(kinds), BANDS), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        z = mix(s + _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = gamma[(z & _U(0xFFFF)).astype(np.int64)]
        beta = ((z >> _U(32)) & _U(0xFFFF)).astype(np.float64) / (1 << 16)
        t = np.floor(ln_w / r + beta)
        ln_a = ln_gamma[((z >> _U(16)) & _U(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
        least = np.repeat(np.minimum.reduceat(ln_a, starts), sizes)
        hit = np.flatnonzero(ln_a == least)
        pick = hit[np.searchsorted(hit, starts)]
        sample = mix(s[pick] + mix(t[pick].astype(np.int64).astype(np.uint64)))
        band = k // ROWS
        keys[:, band] = mix(keys[:, band] * _BASE + sample + _U(band + 1))
    return keys


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of high document frequency, their frequencies, and the bound above which they are listed."""
    width = COUNTERS // SLICES
    source = docs.select(clean_text().alias("text"))

    def count():
        def work(batch):
            seen = [np.unique(g) for g in shingles(texts(batch))]
            at, n = np.unique(np.concatenate(seen) % _U(COUNTERS), return_counts=True)
            cut = np.searchsorted(at, np.arange(SLICES + 1, dtype=np.uint64) * _U(width))
            rows = [(j, (at[a:b] - _U(j * width)).astype("<u2").tobytes(), n[a:b].astype("<u4").tobytes()) for j, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["j", "at", "n"])

        return work

    def add(key, table):
        total = np.zeros(width, dtype=np.int64)
        for at, n in zip(table.column("at"), table.column("n")):
            total[np.frombuffer(at.as_py(), "<u2")] += np.frombuffer(n.as_py(), "<u4")
        return pa.table({"j": pa.array([key[0].as_py()], pa.int32()), "n": [total.tobytes()]})

    parts = expand_rows(source, count, "j int, at binary, n binary", lambda made: _combined(made, width))
    counters = np.zeros(COUNTERS, dtype=np.int64)
    for row in parts.groupBy("j").applyInArrow(add, "j int, n binary").collect():  # COUNTERS * 8 bytes in all
        counters[row["j"] * width : (row["j"] + 1) * width] = np.frombuffer(row["n"], dtype=np.int64)
    bound = max(2, -(-int(counters.sum()) // MAX_FREQUENT))
    heavy = docs.sparkSession.sparkContext.broadcast(np.packbits(counters >= bound))

    def exact():
        bits = np.unpackbits(heavy.value).astype(bool)

        def work(batch):
            seen = np.concatenate([np.unique(g) for g in shingles(texts(batch))])
            kinds, n = np.unique(seen[bits[(seen % _U(COUNTERS)).astype(np.int64)]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], names=["s", "n"])

        return work

    found = (
        expand_rows(source, exact, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= bound).collect()
    )  # at most MAX_FREQUENT rows
    kinds = np.asarray([r["s"] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(kinds)
    return kinds[order], np.asarray([r["n"] for r in found], dtype=np.int64)[order], bound


def _combined(parts: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Add up the slices of one task's batches before they are shuffled."""
    sums: dict[int, np.ndarray] = {}
    for b in parts:
        for j, at, n in zip(*[_column(b, c).to_pylist() for c in ("j", "at", "n")]):
            total = sums.setdefault(j, np.zeros(width, dtype=np.uint32))
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
    at = {j: np.flatnonzero(t) for j, t in sums.items()}
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(sums), pa.int32()),
            pa.array([at[j].astype("<u2").tobytes() for j in sums], pa.binary()),
            pa.array([t[at[j]].astype("<u4").tobytes() for j, t in sums.items()], pa.binary()),
        ],
        names=["j", "at", "n"],
    )


class Weights:
    """The idf table, shipped to tasks (at most ``MAX_FREQUENT`` entries)."""

    def __init__(self, docs: DataFrame):
        n = max(docs.count(), 2)
        kinds, df, bound = frequent_shingles(docs)
        scale = math.log(max(n / bound, 2))
        idf = 1 + IDF_STRENGTH * np.clip(np.log(n / np.maximum(df, 1)) / scale, 0, 1)
        self.held = docs.sparkSession.sparkContext.broadcast((kinds, idf, 1 + IDF_STRENGTH))

    def of(self, batch: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [weighted(g, *self.held.value) for g in shingles(batch)]


def _sketches(nodes: DataFrame, weights: Weights) -> DataFrame:
    """``node`` and its band keys, for texts that have words."""

    def make():
        def work(batch):
            kept, kinds, ws = [], [], []
            for i, (k, w) in enumerate(weights.of(texts(batch))):
                if len(k):
                    kept.append(i)
                    kinds.append(k)
                    ws.append(w)
            keys = band_keys(kinds, ws) if kinds else np.zeros((0, BANDS), np.uint64)
            flat = pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * BANDS, pa.int32()), flat)
            return pa.RecordBatch.from_arrays([_column(batch, "node").take(pa.array(kept, pa.int64())), lists], names=["node", "keys"])

        return work

    return expand_rows(nodes.select("node", "text"), make, "node bigint, keys array<bigint>")


def _features(nodes: DataFrame, weights: Weights) -> DataFrame:
    """``node`` with its distinct shingles (32 bits, ascending) and weights, packed."""

    def make():
        def work(batch):
            packed = []
            for k, w in weights.of(texts(batch)):
                small, at = np.unique((k >> _U(32)).astype("<u4"), return_index=True)
                packed.append(small.tobytes() + w[at].astype("<f4").tobytes())
            return pa.RecordBatch.from_arrays([_column(batch, "node"), pa.array(packed, pa.binary())], names=["node", "feature"])

        return work

    return expand_rows(nodes.select("node", "text"), make, "node bigint, feature binary")


def verified_links(
    members: list[np.ndarray], sums: np.ndarray, side: np.ndarray, threshold: float, known: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs with similarity >= threshold.

    ``members``: (shingles, weights) of each text; ``side``: 0 or 1, pairs of
    one side are compared only when there is a single side; ``known``: parts that
    hang together already (their pairs are not compared).
    """
    sizes = [len(s) for s, _ in members]
    shingle = np.concatenate([s for s, _ in members])
    weight = np.concatenate([w for _, w in members]).astype(np.float64)
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(shingle, kind="stable")
    shingle, weight, owner = shingle[order], weight[order], owner[order]
    group = np.arange(len(members)) if known is None else np.unique(known, return_inverse=True)[1]  # component of each member
    one_side = not side.any() or side.all()
    links = []
    for i, (s, w) in enumerate(members[:-1]):
        open_ = group[i + 1 :] != group[i]
        if not one_side:
            open_ &= side[i + 1 :] != side[i]
        open_ &= np.minimum(sums[i + 1 :], sums[i]) >= threshold * np.maximum(sums[i + 1 :], sums[i])
        if not open_.any():
            continue
        a, b = np.searchsorted(shingle, s, "left"), np.searchsorted(shingle, s, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], np.minimum(weight[at], np.repeat(w, n)), len(members))[i + 1 :]
        for j in np.flatnonzero(open_ & (common >= threshold * (sums[i + 1 :] + sums[i] - common) - 1e-6)) + i + 1:
            if group[j] != group[i]:
                links.append((i, int(j)))
                group[group == group[j]] = group[i]
    return links


def _verify(threshold: float):
    def run(key, table):
        node = table.column("node").to_pylist()
        members = []
        for f in table.column("feature").to_pylist():
            n = len(f) // 8
            members.append((np.frombuffer(f, "<u4", n), np.frombuffer(f, "<f4", n, 4 * n)))
        sums = np.asarray([w.sum(dtype=np.float64) for _, w in members])
        links = verified_links(members, sums, table.column("side").to_numpy(), threshold, table.column("known").to_numpy())
        return pa.table({"a": pa.array([node[i] for i, _ in links], pa.int64()), "b": pa.array([node[j] for _, j in links], pa.int64())})

    return run


def shared_buckets(sketches: DataFrame) -> DataFrame:
    """``bucket``, ``node``, ``n`` (texts in it) of the buckets to verify."""
    member = sketches.select("node", F.explode("keys").alias("bucket")).distinct()
    sets = member.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
    )
    chosen = sets.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    return member.hint("merge").join(chosen.select("bucket", "n"), "bucket").select("bucket", "node", "n")


def _blocks(n: str, block: int) -> F.Column:
    return F.ceil(F.col(n) / block).cast("int")


def _mine(blocks: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def _each(blocks: F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), blocks.cast("bigint") - 1))


_GROUP = ["bucket", "g", "side", "node", "known"]


def first_groups(inside: DataFrame, block: int = BLOCK) -> DataFrame:
    """``bucket``, ``g``, ``side``, ``node``, ``known``: small buckets whole, and
    the blocks of large ones (side 1), each beside the bucket's pivots (side 0)."""
    small = inside.where(F.col("n") <= block).select("bucket", F.lit(0).cast("bigint").alias("g"), F.lit(0).alias("side"), "node")
    large = inside.where(F.col("n") > block)
    every = _blocks("n", block)
    members = large.select("bucket", _mine(every).cast("bigint").alias("g"), F.lit(1).alias("side"), "node")
    pivot = F.pmod(F.xxhash64("bucket", "node"), F.ceil(F.col("n") / PIVOTS)) == 0
    pivots = large.where(pivot).select("bucket", _each(every).alias("g"), F.lit(0).alias("side"), "node")
    return small.union(members).union(pivots).select(*_GROUP[:-1], F.col("node").alias("known"))


def rest_groups(inside: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The groups that compare what the pivots left of large buckets (side 0)
    with all texts of their bucket (side 1)."""
    large = inside.where(F.col("n") > block)
    part = large.hint("merge").join(roots.hint("merge"), "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root")
    sizes = part.groupBy("bucket", "known").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max_by("known", F.struct("size", "known")).alias("largest"), F.sum("size").alias("n"), F.max("size").alias("top"))
    left = largest.select("bucket", "largest", (F.col("n") - F.col("top")).alias("r")).where("r > 0")
    told = part.hint("merge").join(left.hint("merge"), "bucket")
    rests, every = _blocks("r", block), _blocks("n", block)
    pair = F.col("i") * (1 << 31) + F.col("j")
    rest = told.where(F.col("known") != F.col("largest")).select("bucket", _mine(rests).cast("bigint").alias("i"), _each(every).alias("j"), F.lit(0).alias("side"), "node", "known")
    members = told.select("bucket", _each(rests).alias("i"), _mine(every).cast("bigint").alias("j"), F.lit(1).alias("side"), "node", "known")
    return rest.union(members).select("bucket", pair.alias("g"), "side", "node", "known")


def _links(groups: DataFrame, keyed: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The verified links (a, b) of written ``groups``."""
    # one text of each node that shares a bucket; copies are spread by doc_id
    copies = keyed.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    wanted = groups.select("node").distinct().hint("merge").join(copies, "node").select(F.col("node").alias("_node"), "least_id")
    text = (
        keyed.hint("merge")
        .join(wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")
        .dropDuplicates(["node", "doc_id"])
    )
    featured = groups.hint("merge").join(_features(text, weights), "node")
    return written(featured.groupBy("bucket", "g").applyInArrow(_verify(threshold), "a bigint, b bigint"), "verified")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (the class's least doc_id), class_size.

    Also ``node`` (hash of the text), ``root`` (least node of the class, null
    without words) and ``words`` (whether the text has any).
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", clean_text().alias("text")).withColumn("node", F.xxhash64("text"))
    weights = Weights(keyed)
    sketches = written(_sketches(keyed, weights).dropDuplicates(["node"]), "sketches")
    inside = written(shared_buckets(sketches), "buckets")
    links = _links(written(first_groups(inside, block), "groups"), keyed, weights, threshold)
    roots = connected_components(links)
    rest = written(rest_groups(inside, roots, block), "groups")
    if not rest.isEmpty():
        roots = connected_components(links.union(_links(rest, keyed, weights, threshold)))

    ids = keyed.select("doc_id", "node", F.col("text").rlike(HAS_WORD).alias("words"))
    nodes = ids.where("words").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    placed = nodes.hint("merge").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = placed.hint("merge").join(classes, "root").select(F.col("node").alias("_node"), "root", "class_id", "class_size")
    joined = ids.hint("merge").join(by_node, F.col("words") & (F.col("node") == F.col("_node")), "left")
    return joined.select(
        "doc_id",
        "node",
        "words",
        "root",
        F.when(F.col("words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("words"), F.col("class_size")).otherwise(F.lit(1)).cast("bigint").alias("class_size"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class (the least doc_id); texts without words all stay."""
    found = near_duplicate_classes(docs, threshold).where(F.col("words") & F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = found.groupBy("root").agg(F.min(F.struct("node", "doc_id")).alias("f")).select(F.col("f.node").alias("_node"), F.col("f.doc_id").alias("_id"))
    keyed = carried(docs).withColumn("_k", F.xxhash64(clean_text()))
    full = clean_text().rlike(HAS_WORD)
    kept = keyed.where(full).hint("merge").join(first, (F.col("_k") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return restored(kept.dropDuplicates(["doc_id", "_k"]).union(keyed.where(~full)), docs)


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicate_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
