"""Quality rules with risk-controlled thresholds (operator 6).

DataFrame functions only.  Signals of every text are compared with cutoffs,
one per rule and stratum (the language).  A cutoff is chosen on the labelled
rows: among the good ones of the stratum (``quality`` 1) that pass the base
rules, ``n`` in number, it would reject ``k``.  The exact binomial bound
accepts it when ``P(Bin(n, ALPHA_RULE) <= k) <= DELTA / m``, ``m`` being the
number of all (stratum, rule, cutoff) triples tested (Bonferroni).  The
strictest accepted cutoff of each rule is used; a rule with none is off in the
stratum.  With probability ``1 - DELTA`` all rules together falsely reject at
most ``ALPHA`` of the good texts of every stratum.

Edge cases: a null or empty text has no words and fails the base rules; a null
language and an empty one are one stratum; labels without a document, or with a null
id or quality, are ignored, and a document labelled twice counts twice; repeated
documents are judged alike; without labels every text that passes the base
rules is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded
from .common import clean_text, read_table, without, written

ALPHA = 0.05
DELTA = 0.05
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
MAX_STRATA_BROADCAST = 100_000

#: rule -> (numerator, denominator, candidate cutoffs in thousandths); a text
#: fails when 1000 * numerator > cutoff * denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars", (5, 10, 20, 50, 100, 200, 300, 400)),
    "dup_lines": ("n_dup_lines", "n_lines", (50, 100, 150, 200, 300, 400, 500, 700)),
    "repeats": ("n_repeat_words", "n_words", (20, 50, 75, 100, 150, 200, 250, 275)),
    "long_words": ("word_chars", "n_words", (7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000)),
}
ALPHA_RULE = ALPHA / len(RULES)

SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BLANK = "[\\x20\\x09-\\x0D]"
_NOT_BLANK = "[^\\x20\\x09-\\x0D]"


def _repeat_words() -> Column:
    """Words covered by the windows whose hash (in ``_w``) occurs again.

    The windows are sorted by hash, those equal to a neighbour keep their
    position, and the positions in order give the covered length.
    """
    k = REPEAT_WINDOW
    by_hash = F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.get(s, j)["h"] == x["h"]
        return F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))

    # a one-element array binds the sorted windows once
    at = F.flatten(F.transform(F.array(by_hash), lambda s: F.transform(repeated(s), lambda x: x["i"])))
    return F.aggregate(
        F.sort_array(at),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + k).alias("end"), (acc["n"] + p + k - F.greatest(acc["end"], p)).alias("n")),
        lambda acc: acc["n"],
    )


def quality_signals(docs: DataFrame) -> DataFrame:
    """Add the signals, ``n_lines`` (lines with a word) and ``base_failed``."""
    text = clean_text()
    k = REPEAT_WINDOW
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_NOT_BLANK))
    hashes = F.transform(F.array_remove(F.split(text, f"{_BLANK}+"), ""), lambda w: F.xxhash64(w))
    windows = F.transform(F.sequence(F.lit(1), F.size("_h") - (k - 1)), lambda i: F.xxhash64(F.slice("_h", i, k)))
    keep = without(docs, SIGNALS + ["n_lines", "base_failed", "_lines", "_h", "_w"])
    step = (
        keep.withColumn("_h", hashes)
        .withColumn("_lines", lines)
        .withColumn("_w", F.when(F.size("_h") > k, windows).otherwise(F.array().cast("array<bigint>")))
    )
    return step.select(
        *[F.col(f"`{c}`") for c in keep.columns],
        F.size("_h").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(text, f"{_BLANK}+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_w")) < F.size("_w"), _repeat_words()).otherwise(0).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """``P(Bin(n, p) <= k)`` for k below the mean ``n * p``; 1 from there on.

    Sums the exact terms, each from the one before it, in logarithms.
    """
    odds = math.log(p / (1 - p))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k),
        F.struct((n * math.log1p(-p)).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] + F.log(F.greatest(n - i, F.lit(0.5))) - F.log((i + 1).cast("double")) + odds).alias("term"),
            (acc["sum"] + F.exp(acc["term"])).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k < n * p, total).otherwise(F.lit(1.0))


def _stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _fails(rule: str, cutoff: Column) -> Column:
    num, den, _ = RULES[rule]
    return F.col(num) * 1000 > cutoff * F.col(den)


def choose_cutoffs(labelled: DataFrame, delta: float = DELTA) -> DataFrame:
    """One row per stratum: ``_stratum`` and an accepted cutoff (or null) per rule.

    ``labelled`` holds signals, ``lang`` and ``quality``.
    """
    good = labelled.where((F.col("quality") == 1) & ~F.col("base_failed"))
    rejects = [
        F.struct(
            F.lit(r).alias("rule"),
            F.lit(c).cast("bigint").alias("cutoff"),
            F.sum(_fails(r, F.lit(c)).cast("bigint")).alias("k"),
        )
        for r, (_, _, cutoffs) in RULES.items()
        for c in cutoffs
    ]
    counts = written(good.groupBy(_stratum().alias("_stratum")).agg(F.count("*").alias("n"), F.array(*rejects).alias("tests")), "holdout")
    tests = max(counts.count(), 1) * len(rejects)
    tested = counts.select("_stratum", "n", F.explode("tests").alias("t")).select("_stratum", "n", "t.*")
    accepted = tested.withColumn("p", binomial_tail(F.col("n").cast("double"), F.col("k"), ALPHA_RULE)).where(F.col("p") <= delta / tests)
    return accepted.groupBy("_stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])


def judge(signals: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add ``kept``: passes the base rules and every cutoff of its stratum."""
    table = broadcast_if_bounded(cutoffs.withColumnRenamed("_stratum", "_s"), MAX_STRATA_BROADCAST)
    joined = without(signals, ["kept"]).withColumn("_stratum", _stratum()).join(table, F.col("_stratum") == F.col("_s"), "left")
    rejected = F.col("base_failed")
    for r in RULES:
        rejected = rejected | F.coalesce(_fails(r, F.col(f"_cut_{r}")), F.lit(False))
    return joined.withColumn("kept", ~rejected).drop("_stratum", "_s", *[f"_cut_{r}" for r in RULES])


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` joined with the labels' ``quality`` on doc_id."""
    marks = labels.select(F.col("doc_id").alias("_label_id"), F.col("quality").alias("quality")).where(F.col("quality").isNotNull())
    return without(rows, ["quality"]).hint("merge").join(marks, F.col("doc_id") == F.col("_label_id")).drop("_label_id")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # written, so that the signals are computed once, whatever is filtered on them later
    signals = written(quality_signals(docs.select(row, "doc_id", "lang", "text")).drop("text"), "signals")
    cutoffs = choose_cutoffs(labelled_rows(signals.drop("_row"), labels))
    return judge(signals, written(cutoffs, "cutoffs")).where("kept").select("_row.*")


def op6_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    signals = written(quality_signals(docs).drop("text"), "signals")
    cutoffs = choose_cutoffs(labelled_rows(signals, read_table(spark, sf_dir, "labels")))
    return judge(signals, written(cutoffs, "cutoffs")).select("doc_id", *SIGNALS, "base_failed", "kept")


def quality_sql(docs: str = "documents") -> str:
    """DuckDB CTEs ending in ``judged`` over a relation with unique doc_id, lang, text."""
    tests = ", ".join(f"('{r}', {c})" for r, (_, _, cs) in RULES.items() for c in cs)
    fails = " ".join(f"when '{r}' then 1000 * {n} > cutoff * {d}" for r, (n, d, _) in RULES.items())
    return f"""
q_text as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from {docs}),
q_words as (select doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
                   [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as lines from q_text),
q_wins as (select doc_id, i, array_to_string(w[i : i + {REPEAT_WINDOW - 1}], ' ') as g
           from (select doc_id, w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) as i from q_words where len(w) >= {REPEAT_WINDOW})),
q_rep as (select doc_id, count(distinct p) as n from (
            select doc_id, unnest(range(i, i + {REPEAT_WINDOW})) as p
            from (select doc_id, i, count(*) over (partition by doc_id, g) as c from q_wins) where c > 1) group by doc_id),
signals as (select doc_id, lang, len(w)::bigint as n_words,
                   length(array_to_string(w, ''))::bigint as word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
                   (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                   coalesce(q_rep.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines
            from q_words left join q_rep using (doc_id)),
based as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed from signals),
tests as (select * from (values {tests}) as t(rule, cutoff)),
holdout as (select lang, rule, cutoff, count(*) as n,
                   count(*) filter (where case rule {fails} end) as k
            from based join labels using (doc_id), tests where quality = 1 and not base_failed group by lang, rule, cutoff),
tested as (select lang, rule, cutoff, n, k, (select count(*) from holdout) as m,
                  case when k < n * {ALPHA_RULE!r} then
                    list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA_RULE!r}) + (n - i) * ln(1 - {ALPHA_RULE!r}))
                              for i in range(0, k + 1)]) else 1 end as p
           from holdout),
cuts as (select lang, rule, min(cutoff) as cutoff from tested where p <= {DELTA!r} / m group by lang, rule),
judged as (select b.*, not (base_failed or exists (
             select 1 from cuts where cuts.lang = b.lang and case rule {fails} end)) as kept
           from based b)"""


OP6_SQL = f"with {quality_sql()} select doc_id, {', '.join(SIGNALS)}, base_failed, kept from judged"
