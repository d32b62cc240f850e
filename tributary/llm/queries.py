"""The opN_ queries over the tables of a folder, and the SQL for those that SQL can express."""

from __future__ import annotations

from datetime import date, timedelta
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import classifier, decontaminate, langid, lm, packing, pii, quality_rules, records, simhash, urls

#: Entries of the dated list that op10 applies (rule, action, date).
_KNOWN_EVENTS = (
    ("ads-track.example.com", "add", "2024-01-01"),
    ("adult-x.example.com", "add", "2024-01-01"),
    ("spam-farm.example.org", "add", "2024-02-15"),
    ("spam-farm.example.org", "remove", "2024-09-01"),
    ("casino-win.example.net", "add", "2024-03-10"),
    ("cheap-pills.example.net", "add", "2024-04-20"),
    ("cheap-pills.example.net", "remove", "2024-06-01"),
    ("cheap-pills.example.net", "add", "2024-11-05"),
    ("tionsh.example.net/en", "add", "2024-07-01"),
    ("tionsh.example.net/en", "remove", "2024-07-15"),
)
_FIRST, _SECOND = ("ther", "thth", "tion"), ("an", "ble", "ed", "en", "er", "ha", "he", "in", "nt", "on", "or", "ou", "re", "sh", "st", "th", "tion", "wh")


def _listed() -> tuple[tuple[str, str, str], ...]:
    """The known entries and those of invented domains: each comes into force on a day of 2024, every third one ends, every sixth begins again."""
    out = list(_KNOWN_EVENTS)
    for i, (a, b, top) in enumerate(product(_FIRST, _SECOND, ("com", "net", "org"))):
        if i % 4 == 3:
            continue
        rule = f"{a}{b}.example.{top}" + ("/en" if i % 8 == 0 else "")
        day = date(2024, 1, 1) + timedelta(i * 37 % 250)
        out.append((rule, "add", day.isoformat()))
        if i % 3 == 0:
            out.append((rule, "remove", (day + timedelta(60)).isoformat()))
        if i % 6 == 0:
            out.append((rule, "add", (day + timedelta(90)).isoformat()))
    return tuple(out)


URL_EVENTS = _listed()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.fold("doc_id", 5) != 0))
    found = langid.identify(docs, model)
    return found.select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_and_read(_table(spark, sf_dir, "documents"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.fold("doc_id", 7) == 2)
    return lm.score_documents(docs)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time; the query gives each one by its page_id."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 37, 366) AS INT))").alias("fetched"))
    events = spark.createDataFrame(URL_EVENTS, "rule string, action string, date string").withColumn("date", F.col("date").cast("date"))
    return urls.judge(pages, events)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_simhash,
        op3_packing,
        op4_language_id,
        op5_quality_rules,
        op6_binary_records,
        op7_lattice_lm,
        op8_decontamination,
        op9_pii,
        op10_url_filters,
    )
}

_GRID = ", ".join(f"('{m}', {c!r}e0)" for m, grid in quality_rules.METRICS.items() for c in grid)
_TRIALS = sum(map(len, quality_rules.METRICS.values()))
_SHARE = 0.05 / len(quality_rules.METRICS)
_CASES = " AND ".join(f"coalesce({m} < cut_{m}, true)" for m in quality_rules.METRICS)
_CUTS = ", ".join(f"min(cutoff) FILTER (metric = '{m}') AS cut_{m}" for m in quality_rules.METRICS)
_VALUE = "CASE metric " + " ".join(f"WHEN '{m}' THEN {m}" for m in quality_rules.METRICS) + " END"
_WS = r"[ \t\n\x0B\f\r]"

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM rep) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  len(l) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_caps
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  coalesce(CAST(n_symbols AS DOUBLE) / nullif(word_chars, 0), 0e0) AS symbol_ratio,
  coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0), 0e0) AS dup_line_ratio,
  coalesce(CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0), 0e0) AS repeat_ratio,
  coalesce(CAST(n_caps AS DOUBLE) / nullif(word_chars, 0), 0e0) AS caps_ratio FROM c),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND count(*) = count(quality)),
h AS (SELECT f.* FROM f JOIN good ON good.doc_id = f.doc_id WHERE NOT base_failed),
grid(metric, cutoff) AS (VALUES {_GRID}),
tests AS (SELECT stratum, metric, cutoff, count(*) AS n, count(*) FILTER ({_VALUE} >= cutoff) AS k FROM h CROSS JOIN grid GROUP BY stratum, metric, cutoff),
p AS (SELECT *, CASE WHEN k >= n * {_SHARE!r}e0 THEN 1e0 ELSE list_sum(list_transform(range(0, k + 1),
  lambda i: exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) + i * ln({_SHARE!r}e0) + (n - i) * ln({1 - _SHARE!r}e0)))) END AS p,
  (SELECT count(DISTINCT stratum) FROM tests) AS strata FROM tests),
cuts AS (SELECT stratum, {_CUTS} FROM p WHERE p <= {0.05 / _TRIALS!r}e0 / strata GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_CASES} AS kept
FROM f LEFT JOIN cuts ON cuts.stratum = f.stratum
"""

_EVENTS = ", ".join(f"('{r}', '{a}', DATE '{d}')" for r, a, d in URL_EVENTS)

OP10_SQL = rf"""
WITH events(rule, action, date) AS (VALUES {_EVENTS}),
span AS (SELECT rule, action, date AS valid_from, lead(date) OVER (PARTITION BY rule ORDER BY date) AS valid_to FROM events),
c AS (SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
  lower(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1)) AS path FROM pages),
hit AS (SELECT page_id, rule FROM c JOIN span ON action = 'add' AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
  AND CASE WHEN contains(rule, '/') THEN starts_with(host || path || '/', rule || '/') ELSE host = rule OR ends_with(host, '.' || rule) END),
best AS (SELECT page_id, count(*) AS n_rules, arg_min(rule, (-length(rule), rule)) AS rule FROM hit GROUP BY page_id)
SELECT c.page_id, c.host, CAST(c.fetched AS DATE) AS fetched, coalesce(n_rules, 0) > 0 AS blocked, coalesce(n_rules, 0) AS n_rules, rule
FROM c LEFT JOIN best ON best.page_id = c.page_id
"""

ORACLE_SQL = {"op5_quality_rules": OP5_SQL, "op10_url_filters": OP10_SQL}
