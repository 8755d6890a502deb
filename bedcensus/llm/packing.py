"""Best-fit packing of token sequences by large-item matching (operator 8).

Documents become token ids (one tokenizer file, id ``EOS`` after each), cut
into pieces of at most ``CAPACITY``.  Packing works on piece lengths, of which
there are at most ``CAPACITY`` different ones however many documents there
are: the histogram of lengths is packed on the driver (its size is bounded by
the capacity), and the plan says, for runs of ranks within one length, which
bins they fill.  Spark ranks the pieces and looks the ranks up in the plan.

* Large pieces (longer than a third of the capacity): at most two share a bin.
  From the longest down, a piece is matched with the longest other large piece
  that still fits.
* Small pieces, from the longest down, go to the fullest bin they still fit
  (best fit); a new bin is opened only when none has room.

Edge cases: null and empty texts are one piece holding only the end id;
repeated rows are packed once per row (equal rows are interchangeable); a null
doc_id is packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, append_columns, bounded_batches, clean_text, read_table, release_memory, without, written

CAPACITY = 4096
EOS = 1
#: Entries of each half of a worker's part cache (it only saves work; 200 bytes each).
CACHE_PARTS = 100_000
#: UTF-8 bytes of the texts that are tokenized at once (a longer text is alone).
SLICE_BYTES = 4 * 1024 * 1024
#: Pieces of one ranking bucket.
BUCKET_PIECES = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words the fast path takes: printable ASCII and Latin-1 letters.  In these,
#: lower-casing and Unicode normalisation work character by character.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: The tokenizer file's split pattern, restricted to those characters.
_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"
#: Put between parts; no plain word holds it.
_BETWEEN = "\x1f"


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 as it is, other bytes from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(0x100 + n)
    return [out[b] for b in range(256)]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _gather(ids: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``ids``, one after the other (run k ends where k + 1 starts)."""
    sizes = starts[which + 1] - starts[which]
    out, at = np.empty(sizes.sum(), ids.dtype), 0
    for a in range(0, len(which), 1 << 17):  # bounds the positions held
        n = sizes[a : a + (1 << 17)]
        out[at : at + n.sum()] = ids[_spans(starts[which[a : a + (1 << 17)]], n)]
        at += n.sum()
    return out


def _added(sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``sizes`` that end at ``ends``, with 0 in front, running."""
    return np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]


class WordTokenizer:
    """Token ids of texts.

    The tokenizer never joins characters across blanks and line ends, so a
    text's ids are those of its blank-separated words in a row.  A batch's
    different words are found and split into the parts that the tokenizer
    splits them into by Arrow, its different parts are encoded by the
    tokenizer's BPE model, and ids are put together by index.  Words of other
    characters than ``_PLAIN``'s, and special tokens, take the whole tokenizer.

    Parts (and odd words) are remembered in two generations of at most
    ``CACHE_PARTS``: when the younger one is full it becomes the older one, and
    parts that are met again move up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _remembered(self, names: list[str], encode: Callable[[list[str]], list[list[int]]]) -> list[bytes]:
        """The ids of each name; ``encode`` makes those that are not remembered."""
        if len(self.young) >= CACHE_PARTS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, names))
        new = []
        for k, name in [(k, names[k]) for k, got in enumerate(out) if got is None]:
            got = old.get(name)
            if got is None:
                new.append(k)
            else:
                out[k] = young[name] = got
        for a in range(0, len(new), 10_000):
            at = new[a : a + 10_000]
            for k, ids in zip(at, encode([names[k] for k in at])):
                out[k] = young[names[k]] = struct.pack(f"<{len(ids)}I", *ids)
        while len(young) > CACHE_PARTS:
            young.popitem()
        return out

    def _parts(self, parts: list[str]) -> list[list[int]]:
        shown = [p if p.isascii() else "".join([self.letters[b] for b in p.encode()]) for p in parts]
        return [[t.id for t in self.model.tokenize(s)] if s else [] for s in shown]

    def _odd(self, marked: list[str]) -> list[list[int]]:
        """The ids of words, each given with a mark in front."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([m[1:] for m in marked], add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, and where each word's start (and the last one's end)."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for s in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, s)))
        mask = plain.to_numpy(zero_copy_only=False)
        marked = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), _PARTS, "\\0" + _BETWEEN)
        split = pc.split_pattern(pc.ascii_rtrim(marked, _BETWEEN), _BETWEEN)
        parts = split.flatten().dictionary_encode()
        encoded = self._remembered(parts.dictionary.to_pylist(), self._parts)
        n = len(encoded)
        encoded += self._remembered([_BETWEEN + w for w in words.filter(pc.invert(plain)).to_pylist()], self._odd)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        ids, starts = np.frombuffer(b"".join(encoded), "<u4"), np.concatenate([[0], np.cumsum(sizes)])
        # runs of each word: the parts of a plain one, the one run of an odd one
        runs = np.ones(len(words), np.int64)
        runs[mask] = pc.list_value_length(split).to_numpy()
        which = np.empty(runs.sum(), np.int64)
        of_plain = np.repeat(mask, runs)
        which[of_plain] = parts.indices.to_numpy()
        which[~of_plain] = np.arange(n, len(encoded))
        return _gather(ids, starts, which), _added(sizes[which], np.cumsum(runs))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (no nulls), and where each text's start (and the last one's end)."""
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        ids, starts = self._words(words.dictionary)
        which = words.indices.to_numpy()
        ends = pc.list_value_length(lists).to_numpy().cumsum()
        return _gather(ids, starts, which), _added(np.diff(starts)[which], ends)


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer (and its cache) per worker process and file."""
    return WordTokenizer(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` by about ``SLICE_BYTES`` of text (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        bytes_ = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy()
        a = 0
        for b, n in enumerate(bytes_.tolist()):
            if size + n > SLICE_BYTES and (held or b > a):
                yield pa.concat_batches([*held, batch.slice(a, b - a)])
                held, size, a = [], 0, b
            size += n
        if batch.num_rows > a:
            held.append(batch.slice(a))
    if held:
        yield pa.concat_batches(held)


def _with_end(ids: np.ndarray, starts: np.ndarray, eos: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``eos`` after each: ids and starts."""
    ends = starts[1:] + np.arange(len(starts) - 1)
    out = np.full(len(ids) + len(ends), eos, dtype="<u4")
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = ids
    return out, np.concatenate([[0], ends + 1])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    The ids are little-endian 32-bit numbers in one binary value, which Spark
    writes and shuffles as it is (:func:`unpacked` makes an array of it).
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer_path)
        for batch in _slices(batches):
            ids, starts = _with_end(*tok.encode(batch.column(batch.schema.get_field_index("text"))), eos)
            sizes = np.diff(starts)
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            number = _spans(np.zeros(len(sizes), np.int64), pieces)
            start = number * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = starts[row] + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), length.tolist())]
            doc = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row))
            cols = [doc, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:  # the pieces stand one after the other in ids
                ends = 4 * np.concatenate([[0], at + length]).astype(np.int32)
                cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(ids)]))
            made = pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            for a in range(0, len(row), ARROW_ROWS):
                yield made.slice(a, ARROW_ROWS)
        release_memory()

    return docs.select("doc_id", clean_text().alias("text")).mapInArrow(run, schema)


def unpacked(ids: pa.Array) -> pa.Array:
    """Binary ids as lists of int32, without copying them."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    _, ends, data = ids.buffers()
    ends = np.frombuffer(ends, np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    values = np.frombuffer(data, "<i4", int(ends[-1] - ends[0]) // 4, int(ends[0])) if data else np.zeros(0, "<i4")
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4), pa.array(values))


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Pack a histogram of lengths.

    Returns the plan and the number of bins.  A plan entry (length, rank, n,
    per_bin, bin, offset) puts the n pieces of that length from that rank on
    into consecutive bins from ``bin``, ``per_bin`` in a row in each, the first
    at ``offset``.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of bins (first, number)
    gaps: list[int] = []
    bins = 0

    def put(length: int, n: int, per_bin: int, first: int, offset: int) -> None:
        plan.append((length, used[length], n, per_bin, first, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not room[gap]:
                bisect.insort(gaps, gap)
            room[gap].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while at >= 0 and left[large[at]] - (large[at] == a) <= 0:
                at -= 1
            if at < 0:
                n = left[a]
                put(a, n, 1, bins, 0)
                leave(capacity - a, bins, n)
            elif large[at] == a:
                n = left[a] // 2
                put(a, 2 * n, 2, bins, 0)
                leave(capacity - 2 * a, bins, n)
            else:
                b = large[at]
                n = min(left[a], left[b])
                put(a, n, 1, bins, 0)
                put(b, n, 1, bins, a)
                leave(capacity - a - b, bins, n)
            bins += n

    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[a]:
            at = bisect.bisect_left(gaps, a)
            if at == len(gaps):  # open bins, filled with this length alone
                per = capacity // a
                n = max(1, left[a] // per)
                k = min(per, left[a])
                put(a, n * k, k, bins, 0)
                leave(capacity - k * a, bins, n)
                bins += n
                continue
            gap = gaps[at]
            first, n = room[gap].pop()
            if not room[gap]:
                del gaps[at]
            per = min(gap // a, left[a])
            m = min(n, left[a] // per)
            put(a, m * per, per, first, capacity - gap)
            leave(gap - per * a, first, m)
            leave(gap, first + m, n - m)
    return plan, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length``.

    ``pieces`` is written with a number for each row.  A piece's rank within its
    length is its number in a bucket (a hash of the row's number) plus what the
    buckets before hold, so no task gathers all pieces of one frequent length or
    all pieces of a document that has very many copies.  Binary ``ids`` come out
    as arrays.
    """
    given = without(pieces, ["sequence_id", "offset", "_row", "_b", "_before", "_n", "_rank"])
    pieces = written(given.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan, _ = packing_plan(histogram, capacity)
    buckets = max(16, -(-sum(histogram.values()) // bucket_pieces))
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_b").orderBy("_row")
    numbered = keyed.withColumn("_n", F.row_number().over(order)).hint("merge").join(before, ["length", "_b"])
    ranked = numbered.select(*given.columns, (F.col("_before") + F.col("_n") - 1).alias("_rank"))

    plan.sort()
    entries = np.asarray(plan, dtype=np.int64).reshape(-1, 6)

    def make():
        # one ascending key per entry: length, then first rank
        keys = entries[:, 0] * (1 << 48) + entries[:, 1]

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            e = entries[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            at = rank - e[:, 1]
            ids = [unpacked(batch.column(batch.schema.get_field_index("ids")))] if with_ids else []
            return [*ids, pa.array(e[:, 4] + at // e[:, 3]), pa.array(e[:, 5] + (at % e[:, 3]) * length)]

        return work

    with_ids = dict(given.dtypes).get("ids") == "binary"
    return append_columns(ranked, make, [("ids", "array<int>")] * with_ids + [("sequence_id", "bigint"), ("offset", "bigint")]).drop("_rank")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (doc_id, text)."""
    pieces = token_pieces(docs, tokenizer_path or default_tokenizer(), capacity, EOS, with_ids)
    return pack(pieces, capacity)


def op8_best_fit_packing(spark, sf_dir):
    packed = pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
