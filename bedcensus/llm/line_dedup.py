"""Line deduplication by overlapping three-line windows (operator 4).

DataFrame functions only.  A text's lines are its \\n-separated parts; lines
without a word (blank ones) are skipped when windows are formed and never
removed.  Every three consecutive lines are one window, hashed to 128 bits
from the exact text of the lines.  Over all documents, the first occurrence of
a window (least doc_id, nulls first, then text hash, then position) stays; the
lines that later occurrences cover are removed, overlapping windows being
merged into runs of covered lines.

Plan: windows are narrow rows written once; repeated windows come from one
map-side combined aggregate, so a window that a third of all documents share
is one row per task; the join back is skew-split by the adaptive planner; the
covered positions meet the texts in one join on the document.

Edge cases: texts of fewer than three lines with words (null and empty ones
included) have no window and stay; rows that repeat doc_id and text count as
one document and are treated alike, all kept; a window repeated inside one
document loses its later occurrences too; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, read_table, without, written

WINDOW_LINES = 3
_HAS_WORD = "[^ \\t\\n\\x0B\\f\\r]"
_KEY = ["_id", "_t"]


def _with_lines(docs: DataFrame) -> DataFrame:
    """Add the document key, all lines and the numbers of those with a word."""
    return (
        docs.withColumn("_id", F.col("doc_id"))
        .withColumn("_t", F.xxhash64(clean_text()))
        .withColumn("_lines", F.split(clean_text(), "\n", -1))
        .withColumn(
            "_full",
            F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(_HAS_WORD), i)), lambda i: i.isNotNull()),
        )
    )


def line_windows(docs: DataFrame, k: int = WINDOW_LINES) -> DataFrame:
    """One row per window: document key, number of its first line, hash."""
    lines = _with_lines(docs).where(F.size("_full") >= k)
    hashed = lines.select(*_KEY, F.transform("_full", lambda i: F.md5(F.get("_lines", i).cast("binary"))).alias("_h"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_h") - k),
        lambda i: F.unhex(F.md5(F.concat(*[F.get("_h", i + j) for j in range(k)]).cast("binary"))),
    )
    return hashed.select(*_KEY, F.posexplode(windows).alias("_at", "_hash"))


def later_windows(windows: DataFrame) -> DataFrame:
    """The windows that some earlier window equals."""
    place = F.struct(F.col("_id").isNotNull().alias("known"), "_id", "_t", "_at")
    first = (
        windows.groupBy("_hash")
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("_hash", "_first")
    )
    return windows.hint("merge").join(first, "_hash").where(place != F.col("_first")).select(*_KEY, "_at")


def dedup_lines(docs: DataFrame, k: int = WINDOW_LINES) -> DataFrame:
    """Remove repeated line windows from ``text``; adds ``n_lines``, ``n_removed``."""
    docs = without(docs, ["n_lines", "n_removed", "_id", "_t", "_lines", "_full"])
    later = later_windows(written(line_windows(docs, k), "line-windows"))
    covered = later.groupBy(*_KEY).agg(F.collect_set("_at").alias("_at"))  # bounded by one document's lines
    covered = covered.select(F.col("_id").alias("_cid"), F.col("_t").alias("_ct"), "_at")
    joined = (
        _with_lines(docs)
        .hint("merge")
        .join(covered, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_t") == F.col("_ct")), "left")
    )
    covered_lines = F.array_distinct(F.flatten(F.transform("_at", lambda a: F.sequence(a, a + (k - 1)))))
    removed = F.transform(covered_lines, lambda p: F.get("_full", p))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed"))
    text = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    return joined.withColumn("_removed", removed).select(
        *[
            (F.when(F.col("_at").isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`"))
            for c in docs.columns
        ],
        F.size("_full").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def op4_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def line_dedup_sql(docs: str) -> str:
    """DuckDB text over a relation with doc_id (unique) and text."""
    return f"""
lines as (select doc_id, i, s[i] as line, regexp_matches(s[i], '[^ \\t\\n\\x0B\\f\\r]') as has_word
          from (select doc_id, s, unnest(range(1, len(s) + 1)) as i
                from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from {docs}))),
numbered as (select doc_id, i, line, row_number() over (partition by doc_id order by i) as p from lines where has_word),
wins as (select doc_id, p, line as a,
                lead(line, 1) over (partition by doc_id order by p) as b,
                lead(line, 2) over (partition by doc_id order by p) as c from numbered),
later as (select doc_id, p from (
            select doc_id, p, row_number() over (partition by a, b, c order by doc_id, p) as k from wins where c is not null)
          where k > 1),
gone as (select distinct doc_id, unnest(range(p, p + {WINDOW_LINES})) as p from later),
left_over as (select lines.doc_id, count(numbered.p) as n_lines, count(gone.p) as n_removed,
                     string_agg(lines.line, chr(10) order by lines.i) filter (where gone.p is null) as text
              from lines left join numbered using (doc_id, i) left join gone on gone.doc_id = lines.doc_id and gone.p = numbered.p
              group by lines.doc_id)"""


OP4_SQL = f"""
with {line_dedup_sql('documents')}
select doc_id, n_lines::bigint as n_lines, n_removed::bigint as n_removed, coalesce(text, '') as text from left_over
"""
