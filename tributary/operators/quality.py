"""Network checks: each returns flags (flag_type, severity, member pipes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invert_conflicts(edges: DataFrame) -> DataFrame:
    """Edges whose upstream invert lies below the downstream one, both above zero; with the rise."""
    ok = (F.col("up_inv") > 0) & (F.col("dn_inv") > 0) & (F.col("up_inv") < F.col("dn_inv"))
    return edges.where(F.coalesce(ok, F.lit(False))).withColumn("rise", F.col("dn_inv") - F.col("up_inv"))


def slope_errors(edges: DataFrame, key: str = "pidx") -> DataFrame:
    """Negative slope and no invert conflict."""
    return edges.where("slope < 0").join(invert_conflicts(edges).select(key), key, "left_anti")


def missing_direction(pipes: DataFrame) -> DataFrame:
    return pipes.where("frommh IS NULL OR tomh IS NULL")


def isolated(points: DataFrame, pipes: DataFrame, key: str) -> DataFrame:
    """Points that no pipe names at either end."""
    named = pipes.select(F.col("frommh").alias(key)).union(pipes.select(F.col("tomh").alias(key)))
    return points.join(named, key, "left_anti")


def rollup(flags: DataFrame, key: str = "pidx") -> DataFrame:
    """(key, qa_flags, qa_status): each pipe's distinct flag types, in order, joined by commas."""
    d = flags.groupBy(key).agg(F.array_sort(F.collect_set("flag_type")).alias("f"))
    return d.select(key, F.array_join("f", ", ").alias("qa_flags"), F.lit("flagged").alias("qa_status"))


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, else NULL; an unknown condition doesn't hold."""
    out = None
    for name, cond in reasons:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def drop_report(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n): each row charged to the first reason; kept rows as "kept"."""
    return df.groupBy(F.coalesce(first_reason(reasons), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def whole_number(name: str) -> Column:
    """Text of digits without leading zeros, "0" for zeros only; NULL for other text."""
    digits = F.ltrim(F.col(name), F.lit("0"))
    return F.when(F.col(name).rlike(r"^\d+$"), F.when(digits == "", "0").otherwise(digits))


def match_facilityid(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(wanted, n_exact, n_number, status): exact text first, else as whole numbers without leading zeros."""
    k = known.select("fid", whole_number("fid").alias("num"))
    exact = wanted.join(k.select("fid"), F.col("wanted") == F.col("fid")).groupBy("wanted").agg(F.count(F.lit(1)).alias("n_exact"))
    loose = wanted.withColumn("num", whole_number("wanted")).join(k.select("num"), "num").groupBy("wanted").agg(F.count(F.lit(1)).alias("n_number"))
    d = wanted.join(exact, "wanted", "left").join(loose, "wanted", "left").na.fill(0)
    n = F.when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(F.col("n_number"))
    return d.withColumn("status", F.when(n == 0, "not_found").when(n > 1, "ambiguous").otherwise("ok"))


def facility_role(name: str, patterns: list[tuple[str, str]], default: str = "station") -> Column:
    """Role of the longest pattern found in the name, case ignored; the first of equals."""
    low = F.lower(F.col(name))
    out = None
    for pattern, role in sorted(patterns, key=lambda p: -len(p[0])):
        cond = low.contains(pattern.lower())
        out = F.when(cond, role) if out is None else out.when(cond, role)
    return F.lit(default) if out is None else out.otherwise(default)
