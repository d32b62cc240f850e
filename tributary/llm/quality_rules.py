"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Base columns count words, symbols, duplicate lines and repeated five-word
windows. On top, each metric of METRICS gets a cutoff per stratum: the lowest
value of its grid for which labelled holdouts certify that at most
``alpha / len(METRICS)`` of good documents score at or above it. The
certificate is the exact binomial (Clopper-Pearson) test at level ``delta``
divided by the number of tests made (Bonferroni over strata, metrics and grid
values), so with probability 1 - delta no stratum loses more than alpha of its
good documents to the cutoffs, whatever the rules' correlation. A stratum whose
holdouts are too few to certify a cutoff rejects nothing by it.

Edge cases: a null text counts as no words (base_failed); a null language is a
stratum of its own; labels that are null, repeated with the same value or of
unknown documents are ignored, and a document with any label other than good
doesn't count as good; equal rows are judged alike; an empty table gives an
empty result; no labels mean no cutoffs; very long texts are read whole; a score
that equals a cutoff is rejected. Extra input columns are not read; base_features()
called directly replaces columns that bear its own names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.session import materialize

#: The six white-space characters as a SQL literal, in which a form feed has no escape of its own.
WS = " \\t\\n\\u000b\\u000c\\r"
SYMBOLS = "#*$%&|<>"
#: Metric -> cutoffs tried, ascending; a document scoring at or above a cutoff is rejected.
METRICS: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_ratio": (0.02, 0.05, 0.1, 0.15),
    "caps_ratio": (0.1, 0.2, 0.3, 0.5, 0.7),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Strata up to this many are broadcast; more of them are joined by key.
BROADCAST_STRATA = 10_000


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts, base_failed and the metrics; working columns start with ``_q_``.

    All work is per row, so the plan is one scan without an exchange. Windows are
    told apart by a chained 64-bit hash of their five words.
    """
    ws = f"'{WS}'"
    d = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_q_trim", F.expr(f"trim(BOTH {ws} FROM _q_text)"))
    d = d.withColumn("_q_w", F.expr("CASE WHEN _q_trim = '' THEN CAST(array() AS array<string>) ELSE split(_q_trim, '[ \\\\t-\\\\r]+') END"))
    d = d.withColumn("_q_lines", F.expr(f"filter(split(_q_text, '\\n'), x -> trim(BOTH {ws} FROM x) <> '')"))
    d = d.withColumn("n_words", F.expr("CAST(size(_q_w) AS BIGINT)"))
    window = ", ".join(f"get(_q_w, i + {k})" for k in range(5))
    d = d.withColumn(
        "_q_h", F.expr(f"CASE WHEN size(_q_w) < 5 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(_q_w) - 5), i -> xxhash64({window})) END")
    )
    d = d.withColumn(
        "_q_s",
        F.expr(
            "CASE WHEN size(array_distinct(_q_h)) = size(_q_h) THEN CAST(array() AS array<struct<h:bigint,p:int>>)"
            " ELSE sort_array(transform(_q_h, (x, i) -> named_struct('h', x, 'p', i))) END"
        ),
    )
    d = d.withColumn(
        "_q_p",
        F.expr(
            "sort_array(filter(transform(_q_s, (e, i) -> CASE WHEN (i > 0 AND get(_q_s, i - 1).h = e.h) OR get(_q_s, i + 1).h = e.h THEN e.p END),"
            " p -> p IS NOT NULL))"
        ),
    )
    repeated = "aggregate(transform(_q_p, (p, i) -> CAST(least(5, coalesce(get(_q_p, i + 1) - p, 5)) AS BIGINT)), 0L, (a, x) -> a + x)"
    d = (
        d.withColumn("word_chars", F.expr("CAST(char_length(array_join(_q_w, '')) AS BIGINT)"))
        .withColumn("n_symbols", F.expr(f"CAST(char_length(_q_text) - char_length(translate(_q_text, '{SYMBOLS}', '')) AS BIGINT)"))
        .withColumn("n_dup_lines", F.expr("CAST(size(_q_lines) - size(array_distinct(_q_lines)) AS BIGINT)"))
        .withColumn("n_repeat_words", F.expr(repeated))
        .withColumn("_q_caps", F.expr("char_length(_q_text) - char_length(translate(_q_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))"))
        .withColumn("_q_nlines", F.expr("size(_q_lines)"))
    )
    d = d.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    d = (
        d.withColumn("symbol_ratio", F.expr("coalesce(n_symbols / nullif(word_chars, 0), 0e0)"))
        .withColumn("dup_line_ratio", F.expr("coalesce(n_dup_lines / nullif(_q_nlines, 0), 0e0)"))
        .withColumn("repeat_ratio", F.expr("coalesce(n_repeat_words / nullif(n_words, 0), 0e0)"))
        .withColumn("caps_ratio", F.expr("coalesce(_q_caps / nullif(word_chars, 0), 0e0)"))
    )
    return d.drop("_q_text", "_q_trim", "_q_w", "_q_lines", "_q_h", "_q_s", "_q_p", "_q_caps", "_q_nlines")


def _lgamma(x: str) -> str:
    """log gamma of x >= 1 by Stirling's series, shifted up by 8."""
    y = f"(({x}) + 8e0)"
    series = f"(({y} - 0.5e0) * ln({y}) - {y} + 0.9189385332046727e0 + 1e0/(12e0*{y}) - 1e0/(360e0*pow({y},3)) + 1e0/(1260e0*pow({y},5)) - 1e0/(1680e0*pow({y},7)))"
    return f"({series} - ln({' * '.join(f'(({x}) + {k}e0)' for k in range(8))}))"


def binomial_cdf(k: str, n: str, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n * p, 1 beyond, where it certifies nothing.

    Terms are summed downwards from k, where they shrink; after 20 standard
    deviations of them nothing is left at double precision.
    """
    steps = f"CAST(least({k}, 20 * sqrt({n}) + 50) AS BIGINT)"
    odds = f"{(1 - p) / p!r}e0"
    top = f"exp({_lgamma(f'{n} + 1e0')} - {_lgamma(f'{k} + 1e0')} - {_lgamma(f'{n} - {k} + 1e0')} + {k} * ln({p!r}e0) + ({n} - {k}) * ln({1 - p!r}e0))"
    tail = (
        f"CASE WHEN {k} = 0 THEN 1e0 ELSE aggregate(sequence(0L, {steps} - 1), named_struct('t', 1e0, 's', 1e0),"
        f" (a, j) -> named_struct('t', a.t * ({k} - j) * {odds} / ({n} - {k} + j + 1), 's', a.s + a.t * ({k} - j) * {odds} / ({n} - {k} + j + 1)),"
        " a -> a.s) END"
    )
    return F.expr(f"CASE WHEN {k} >= {n} * {p!r}e0 THEN 1e0 ELSE least(1e0, {top} * {tail}) END")


def certified_cutoffs(features: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per stratum with good holdouts: stratum and cut_<metric> (null: none certified).

    labels has doc_id and quality (1: good). Only good holdouts that pass the base
    rules count: they are what a cutoff can falsely reject.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.count_if(F.col("quality").isNull()).alias("unknown"))
    good = good.where("q = 1 AND unknown = 0").select("doc_id")
    f = features.where("NOT base_failed").select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), *METRICS)
    hits = [F.count_if(F.col(m) >= c).alias(f"k_{m}_{i}") for m, grid in METRICS.items() for i, c in enumerate(grid)]
    counts = materialize(f.join(good, "doc_id").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *hits), "holdouts")
    trials = ", ".join(f"named_struct('metric', '{m}', 'cutoff', {c!r}e0, 'k', k_{m}_{i})" for m, grid in METRICS.items() for i, c in enumerate(grid))
    tests = counts.selectExpr("stratum", "n", f"inline(array({trials}))")
    share = alpha / len(METRICS)
    level = delta / sum(map(len, METRICS.values())) / max(counts.count(), 1)
    passed = tests.withColumn("p", binomial_cdf("k", "n", share)).where(F.col("p") <= level)
    cuts = [F.min(F.when(F.col("metric") == m, F.col("cutoff"))).alias(f"cut_{m}") for m in METRICS]
    return passed.groupBy("stratum").agg(*cuts)


def verdicts(features: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add kept: not base_failed and below every certified cutoff of the row's stratum."""
    cut = [f"cut_{m}" for m in METRICS]
    d = features.withColumn("stratum", F.coalesce(F.col(stratum), F.lit("")))
    small = cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    d = d.join(F.broadcast(cutoffs) if small else cutoffs, "stratum", "left")
    fine = [F.coalesce(F.col(m) < F.col(f"cut_{m}"), F.lit(True)) for m in METRICS]
    # one CASE, so that no part of it moves below the join and is computed again there
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(reduce(and_, fine))
    return d.withColumn("kept", kept).drop("stratum", *cut)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One narrow row per document: doc_id, lang, the base counts, metrics, base_failed, kept."""
    f = base_features(docs.select("doc_id", "text", "lang"))
    f = materialize(f.select("doc_id", "lang", *COUNTS, *METRICS, "base_failed"), "quality")
    cuts = materialize(certified_cutoffs(f, labels, alpha=alpha, delta=delta), "cutoffs")
    return verdicts(f, cuts)


def filter_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of docs that are kept, with docs' columns.

    Cutoffs come from one pass over the narrow counts; the verdict is taken in a
    second pass beside the text, so that texts are never shuffled.
    """
    own = docs.columns
    f = base_features(docs.select("doc_id", "text", "lang"))
    f = materialize(f.select("doc_id", "lang", *METRICS, "base_failed"), "quality")
    cuts = materialize(certified_cutoffs(f, labels, alpha=alpha, delta=delta), "cutoffs")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("text"), F.col("lang"))
    return verdicts(base_features(packed), cuts).where("kept").select("row.*")
