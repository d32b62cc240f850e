"""URL filters against dated lists: every capture is judged by the entries in force when it was fetched.

A list is a table of dated events (rule, action, date): ``add`` puts a rule in
force from its date on, ``remove`` ends it. A rule is a domain, which covers its
subdomains, or a domain with a path, which covers that path and what lies below.
The events of a rule become validity intervals [valid_from, valid_to); each
capture is exploded into the rules that could cover it (its host's suffixes, and
the host with each leading part of its path) and joined as of its fetch time.

The intervals are broadcast if there are at most ``broadcast_rules`` of them;
more are joined by key, where adaptive execution splits a host with many rows.

Edge cases: a null or unparsable URL and a null fetch time are covered by no
rule; of events of a rule at the same time the remove wins; events with a null
are ignored; repeated captures are judged each; ties between rules in force go to
the longest, then the first in order; a very long path is matched by as many leading
segments as the deepest rule has; extra columns are not read. An empty list covers
nothing, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

BROADCAST_RULES = 100_000


def intervals(events: DataFrame) -> DataFrame:
    """(rule, valid_from, valid_to): when each rule is in force; valid_to null means still."""
    known = events.where("rule IS NOT NULL AND date IS NOT NULL AND action IN ('add', 'remove')")
    once = known.groupBy(F.lower("rule").alias("rule"), "date").agg(F.max("action").alias("action"))
    w = W.Window.partitionBy("rule").orderBy("date")
    d = once.withColumn("before", F.lag("action").over(w)).where("before IS NULL OR before <> action")
    d = d.withColumn("valid_to", F.lead("date").over(w))
    return d.where("action = 'add'").select("rule", F.col("date").alias("valid_from"), "valid_to")


def with_keys(captures: DataFrame, url: str = "url", depth: int = 1 << 30) -> DataFrame:
    """Add host and keys: the rules of at most ``depth`` path segments that could cover the URL."""
    d = captures.withColumn("host", F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)))
    d = d.withColumn("_path", F.regexp_extract(F.col(url), r"^[^:]+://[^/?#]*(/[^?#]*)", 1))
    d = d.withColumn("_labels", F.split("host", r"\."))
    d = d.withColumn("_parts", F.expr("filter(split(lower(_path), '/'), x -> x <> '')"))
    hosts = "transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, i, size(_labels) - i + 1), '.'))"
    paths = f"CASE WHEN least(size(_parts), {int(depth)}) = 0 THEN CAST(array() AS array<string>) ELSE transform(sequence(1, least(size(_parts), {int(depth)})), i -> concat(host, '/', array_join(slice(_parts, 1, i), '/'))) END"
    d = d.withColumn("keys", F.expr(f"CASE WHEN coalesce(host, '') = '' THEN CAST(array() AS array<string>) ELSE concat({hosts}, {paths}) END"))
    return d.drop("_path", "_labels", "_parts")


def judge(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched", page_id: str = "page_id", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, fetched, blocked, n_rules in force that cover it, and the longest such rule."""
    rules = intervals(events)
    # no rule is deeper, so a long path gives no longer keys
    depth = rules.agg(F.max(F.size(F.split("rule", "/")) - 1)).first()[0] or 0
    if rules.limit(broadcast_rules + 1).count() <= broadcast_rules:
        rules = F.broadcast(rules)
    c = with_keys(captures.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(fetched).alias("fetched")), depth=depth)
    c = c.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "fetched", F.explode_outer("keys").alias("rule"))
    in_force = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    hit = c.join(rules, "rule", "left").withColumn("rule", F.when(in_force, F.col("rule")))
    best = F.min_by("rule", F.when(F.col("rule").isNotNull(), F.struct(-F.length("rule"), F.col("rule")))).alias("rule")
    out = hit.groupBy("row", "page_id", "host", "fetched").agg(F.count("rule").alias("n_rules"), best)
    return out.select("page_id", "host", "fetched", (F.col("n_rules") > 0).alias("blocked"), "n_rules", "rule")
