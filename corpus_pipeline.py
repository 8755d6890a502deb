"""Corpus pipeline: quality rules, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), ``docs`` being what the stage before
left, and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result as Parquet in the shared
folder and reads it back, so a lost executor never sends the work back beyond
the last stage; what the stages before wrote is then deleted.  ``n_chars`` follows the text.

Edge cases, in every stage: a null or empty text has no words, so the quality
rules reject it and the later stages, given one, keep it as it is; rows that
repeat id and text are judged alike (near-duplicate removal keeps one of them);
a null doc_id is an id like any other; an empty table gives no rows.  Columns
beyond those of ``documents`` are kept with their values, whatever their names.

Near-duplicate classes and packing cannot be said in SQL, so ``ORACLE_SQL`` is
None; the stages are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedcensus.llm.common import carried, read_table, restored, written
from bedcensus.llm.decontaminate import decontaminate
from bedcensus.llm.line_dedup import dedup_lines
from bedcensus.llm.near_dedup import drop_near_duplicates
from bedcensus.llm.packing import pack_documents
from bedcensus.llm.quality import filter_quality
from bedcensus.session import drop_scratch, scratch_paths


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    return docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return filter_quality(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line windows; a document that loses all its lines goes."""
    deduped = dedup_lines(carried(docs))
    emptied = (F.col("n_lines") > 0) & (F.col("n_removed") == F.col("n_lines"))
    return _with_length(restored(deduped.where(~emptied), docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, benchmark passages cut from the rest."""
    return _with_length(decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places, with the token ids."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held: list[str] = []
    for name, stage in STAGES:
        before = scratch_paths()
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        made = [p for p in scratch_paths() if p not in before]
        drop_scratch(spark, held + made[:-1])  # the last one is the stage's result
        held = made[-1:]
    return docs
