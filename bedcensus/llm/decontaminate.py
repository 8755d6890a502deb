"""Benchmark decontamination with a generalised suffix automaton (operator 7).

The benchmark's items are normalised to word sequences and put into one
generalised suffix automaton (a block of items at a time, see below).  Every
document is streamed through it word by word; the automaton state and the
longest matching length tell, at each word, which windows of the items end
there.  A window is ``WINDOW`` consecutive words of an item; an item of fewer
words (but not none) is one window.

The automaton is shipped to the tasks, so it is bounded: the benchmark is cut
into blocks of at most ``MAX_BLOCK_WORDS`` words (an item longer than that is
cut into pieces that overlap by ``WINDOW - 1`` words, which keeps all of its
windows), each block is one automaton and one pass over the documents, and the
passes' hits are united.  A benchmark below the bound is one pass.  The tasks
normalise the benchmark and cut the blocks; the driver holds one block at a
time, to ship it.

Edge cases: null or empty texts have no words, no hits and are not
contaminated; an item without words never matches; repeated items with one id
count as one item, a null item_id is the id ``null``; repeated documents are
judged row by row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, carried, clean_text, expand_rows, read_table, restored, texts, without, written

WINDOW = 13
#: Words of one automaton; about 1 GB per 5 million words in a worker.
MAX_BLOCK_WORDS = 1_000_000
#: A document is contaminated when hits * 20 >= words.
COVERAGE_DENOMINATOR = 20

_LOWER_OR_SPACE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised_words(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_OR_SPACE).split()


class ItemAutomaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        seqs = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        for _, seq in seqs:
            last = 0
            for t in seq:
                last = self._extend(last, t)
        self.owners: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        for item, seq in seqs:
            v = 0
            for n, t in enumerate(seq, 1):
                v = self.next[v][t]
                if n >= window:
                    self.owners.setdefault(self.window_state(v), set()).add(item)
            if len(seq) < window:
                self.short.setdefault(v, set()).add(item)
        # nearest state on the link path (itself included) that ends a short item
        self.short_link = [-1] * len(self.len)
        if self.short:
            for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
                self.short_link[v] = v if v in self.short else self.short_link[self.link[v]]

    def _extend(self, last: int, t: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if t in nxt[last]:  # the other items already hold this string
            q = nxt[last][t]
            return q if length[q] == length[last] + 1 else self._clone(last, t, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and t not in nxt[p]:
            nxt[p][t] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][t]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, t, q)
        return cur

    def _clone(self, p: int, t: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(t) == q:
            nxt[p][t] = copy
            p = link[p]
        link[q] = copy
        return copy

    def window_state(self, v: int) -> int:
        """The state that holds the last ``window`` words of state ``v``'s strings."""
        while self.len[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [start, end) that windows cover, and the items hit."""
        nxt, link, length, w = self.next, self.link, self.len, self.window
        spans: list[list[int]] = []
        items: set[str] = set()
        v = n = 0
        for i, t in enumerate(map(self.vocab.get, words)):
            if t is None:
                v = n = 0
                continue
            while t not in nxt[v]:
                v = link[v]
                if v < 0:
                    break
                n = length[v]
            if v < 0:
                v = n = 0
                continue
            v = nxt[v][t]
            n += 1
            if n >= w:
                items |= self.owners[self.window_state(v)]
                self._cover(spans, i + 1 - w, i + 1)
            s = self.short_link[v]
            while s > 0:
                if length[s] <= n:
                    items |= self.short[s]
                    self._cover(spans, i + 1 - length[s], i + 1)
                s = self.short_link[link[s]]
        return [(a, b) for a, b in spans], items

    @staticmethod
    def _cover(spans: list[list[int]], a: int, b: int) -> None:
        while spans and spans[-1][1] >= a:
            a = min(a, spans.pop()[0])
        spans.append([a, b])


def item_blocks(benchmark: DataFrame, max_words: int = MAX_BLOCK_WORDS, window: int = WINDOW) -> DataFrame:
    """A written table of (block, item, words): each block at most ``max_words`` words.

    Words are normalised by the tasks.  The pieces are dealt to as many
    partitions as blocks are needed, and each partition cuts its own blocks.
    """

    def cut():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            step = max(max_words - (window - 1), 1)
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normalised_words(text)
                starts = [0] if len(words) <= max_words else range(0, len(words) - (window - 1), step)
                rows += [(item, words[a : a + max_words]) for a in starts if words]
            cols = list(zip(*rows)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.binary()))], names=["item", "words"])

        return work

    def number(batches):
        block = held = 0
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_pylist()
            blocks = []
            for n in sizes:
                if held and held + n > max_words:
                    block, held = block + 1, 0
                held += n
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *b.columns], names=["block", "item", "words"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), clean_text().alias("text"))
    pieces = written(expand_rows(named, cut, "item string, words array<binary>"), "items")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    dealt = pieces.repartition(max(1, -(-total // max_words)))
    numbered = dealt.mapInArrow(number, "block bigint, item string, words array<binary>")
    where = F.spark_partition_id().cast("bigint") * (1 << 40) + F.col("block")
    return written(numbered.withColumn("block", where), "blocks")


def _block(blocks: DataFrame, block: int) -> list[tuple[str, list[bytes]]]:
    """One block's items, on the driver (at most ``max_words`` words)."""
    return [(r["item"], [bytes(w) for w in r["words"]]) for r in blocks.where(F.col("block") == block).collect()]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = [("n_words", "bigint"), ("hit_spans", "array<struct<start: bigint, end: bigint>>"), ("hit_items", "array<string>")]


def _is_contaminated(n_hit: int, n_words: int, denominator: int) -> bool:
    return n_hit > 0 and n_hit * denominator >= n_words


def _told(batch: pa.RecordBatch, hits: list[tuple[list[tuple[int, int]], set[str]]], n_words: list[int], cut_below: int | None) -> list[pa.Array]:
    """The added columns of a batch; with ``cut_below`` also the texts without
    the spans of documents that are not contaminated at that denominator."""
    cols = [
        pa.array(n_words, pa.int64()),
        pa.array([[{"start": a, "end": b} for a, b in spans] for spans, _ in hits], _SPANS),
        pa.array([sorted(items) for _, items in hits], pa.list_(pa.string())),
    ]
    if cut_below is not None:
        raw = batch.column(batch.schema.get_field_index("text")).to_pylist()
        for i, ((spans, _), n) in enumerate(zip(hits, n_words)):
            if spans and not _is_contaminated(sum(b - a for a, b in spans), n, cut_below):
                raw[i] = cut_spans(raw[i], spans)
        cols.append(pa.array(raw, pa.string()))
    return cols


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS, cut_below: int | None = None
) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` (word ranges, end exclusive), ``hit_items``.

    ``docs`` needs ``text``; its other columns stay.  With ``cut_below`` there
    is also ``clean_text`` (see :func:`_told`).  A benchmark of one block is one
    pass.  Of more, each block is a pass of its own that writes its hits by row
    number, so one automaton is held at a time; one aggregate unites them.
    """
    fields = _FOUND + [("clean_text", "string")] * (cut_below is not None)
    context = docs.sparkSession.sparkContext
    blocks = item_blocks(benchmark, max_block_words, window)
    names = [r["block"] for r in blocks.select("block").distinct().collect()]  # a number a block
    if len(names) <= 1:
        held = context.broadcast(_block(blocks, names[0]) if names else [])

        def scan():
            automaton = ItemAutomaton(held.value, window)

            def work(batch: pa.RecordBatch) -> list[pa.Array]:
                words = [normalised_words(t) for t in texts(batch)]
                return _told(batch, [automaton.scan(w) for w in words], [len(w) for w in words], cut_below)

            return work

        return append_columns(docs, scan, fields)

    numbered = written(without(docs, ["_number"]).withColumn("_number", F.monotonically_increasing_id()), "numbered")
    passes = []
    for name in names:
        held = context.broadcast(_block(blocks, name))

        def hits(held=held):
            automaton = ItemAutomaton(held.value, window)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [automaton.scan(normalised_words(t)) for t in texts(batch)]
                at = [i for i, (spans, _) in enumerate(found) if spans]
                number = batch.column(batch.schema.get_field_index("_number")).take(pa.array(at, pa.int64()))
                spans = pa.array([[{"start": a, "end": b} for a, b in found[i][0]] for i in at], _SPANS)
                items = pa.array([sorted(found[i][1]) for i in at], pa.list_(pa.string()))
                return pa.RecordBatch.from_arrays([number, spans, items], names=["_number", "spans", "items"])

            return work

        schema = f"_number bigint, spans {_FOUND[1][1]}, items array<string>"
        passes.append(written(expand_rows(numbered.select("_number", "text"), hits, schema), "hits"))
        held.destroy()
    # a row has at most one entry a pass
    united = reduce(DataFrame.union, passes).groupBy("_number").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    joined = numbered.hint("merge").join(united.hint("merge"), "_number", "left")

    def unite():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = []
            for spans, items in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_spans", "_items")]):
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in spans or []):
                    ItemAutomaton._cover(merged, *s)
                found.append(([tuple(s) for s in merged], set(items or [])))
            return _told(batch, found, [len(normalised_words(t)) for t in texts(batch)], cut_below)

        return work

    return append_columns(joined, unite, fields).drop("_number", "_spans", "_items")


def judged(found: DataFrame, coverage_denominator: int = COVERAGE_DENOMINATOR) -> DataFrame:
    """Add ``n_hit`` (words in hit spans) and ``contaminated``."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return (
        without(found, ["n_hit", "contaminated"])
        .withColumn("n_hit", n_hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage_denominator >= F.col("n_words")))
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters of the given word ranges."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, here = [], 0
    for a, b in spans:
        out.append(text[here : at[a][0]])
        here = at[b - 1][1]
    return "".join(out) + text[here:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage_denominator: int = COVERAGE_DENOMINATOR) -> DataFrame:
    """The documents without benchmark passages.

    A document whose hit words reach the coverage limit goes; of the others the
    hit spans (each at least one window long) are cut from the text.  Documents
    without hits stay as they are.  Columns are those of ``docs``.
    """
    found = find_contamination(carried(docs), benchmark, window, cut_below=coverage_denominator)
    left = judged(found, coverage_denominator).where(~F.col("contaminated"))
    return restored(left.withColumn("text", F.col("clean_text")), docs)


def op7_decontaminate(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(find_contamination(docs, read_table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP7_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, w, least(len(w), {WINDOW}) as m
      from (select item_id, {_SQL_WORDS} as w from benchmark) where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as g
        from (select item_id, m, w, unnest(range(1, len(w) - m + 2)) as i from b)),
sizes as (select distinct m from win),
dwin as (select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') as g
         from (select doc_id, m, w, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m)),
hits as (select doc_id, i, dwin.m, item_id from dwin join win using (m, g)),
words as (select doc_id, count(distinct p) as n_hit
          from (select doc_id, unnest(range(i, i + m)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
          from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       (coalesce(n_hit, 0) > 0 and {COVERAGE_DENOMINATOR} * coalesce(n_hit, 0) >= len(w)) as contaminated
from d left join words using (doc_id) left join found using (doc_id)
"""
