"""Rules for land units that another pipe competes for, on the measures that plans.delineate.annotate adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exclude(annotated: DataFrame, share: float, floor_area: float) -> DataFrame:
    """Add cp_excl: a border unit that the traced pipe doesn't touch and a foreign one crosses, or that the trace's buffer merely nicks."""
    crossed = (F.col("cp_pos") == "border") & (F.col("cp_din") > 0) & F.col("cp_cross")
    return annotated.withColumn("cp_excl", crossed | nicked(share, floor_area))


def nicked(share: float, floor_area: float) -> Column:
    """A border unit of which the trace's buffer covers a small share and a small area."""
    return F.coalesce((F.col("cp_pos") == "border") & (F.col("cp_cover") < share) & (F.col("cp_covar") < floor_area), F.lit(False))


def site_flags(sites: DataFrame, most_acres: float = 500.0, least_coverage: float = 0.5) -> DataFrame:
    """(site, flag_type) of sites (site, n_pipes, n_units, coverage, acres): early returns in the order given; an unknown coverage is no flag."""
    flag = (
        F.when(F.col("n_pipes") == 0, F.array(F.lit("no_upstream_found")))
        .when(F.col("n_units") == 0, F.array(F.lit("low_population_match")))
        .otherwise(F.array_compact(F.array(F.when(F.col("acres") > most_acres, "large_catchment"), F.when(F.col("coverage") < least_coverage, "low_population_match"))))
    )
    return sites.select("site", F.explode(flag).alias("flag_type"))


def decisions(annotated: DataFrame) -> DataFrame:
    """Contested units with what the rules decide: decision (exclude, split, keep or blank for a reviewer) and why.

    An excluded unit comes before a cut one, and that before buffer areas.
    """
    cut = F.col("cp_keep") < 1.0
    decision = F.when(F.col("cp_excl"), "exclude").when(cut, "split").otherwise(F.coalesce("cp_asgn", F.lit("")))
    why = (
        F.when(F.col("cp_excl"), "rule: at the border, and the trace hardly serves it")
        .when(cut, F.format_string("rule: cut at equal distance, %.0f %% kept", 100 * F.col("cp_keep")))
        .when(F.col("cp_asgn") == "exclude", "rule: foreign buffers cover more of it")
        .when(F.col("cp_asgn") == "keep", "rule: the trace's buffers cover as much of it or more")
        .otherwise("")
    )
    return annotated.where("cp_flag <> ''").withColumns({"decision": decision, "why": why})


#: How grave a contested unit is.
SEVERITY = {"review": "review_required", "warning": "warning"}


def competing_flags(annotated: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(site, flag_type, severity, uid, description, geom): one flag for each contested unit; names (pidx, fid) names foreign pipes."""
    d = annotated.where("cp_flag <> ''")
    d = d.withColumn("fid", F.lit(None).cast("string")) if names is None else d.join(names.select(F.col("pidx").alias("cp_fpidx"), F.col("fid").cast("string").alias("fid")), "cp_fpidx", "left")
    grave = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("cp_flag")]
    what = F.when(F.col("cp_cross"), "a foreign main crosses it").otherwise(F.format_string("a foreign main is %.0f ft away, the nearest traced one %.0f ft", "cp_dout", "cp_din"))
    text = F.concat(F.lit("unit "), F.col("uid").cast("string"), F.lit(": "), what, F.lit(" ("), F.coalesce("fid", F.col("cp_fpidx").cast("string"), F.lit("?")), F.lit(")"))
    return d.select("site", F.lit("competing_pipe").alias("flag_type"), grave.alias("severity"), "uid", text.alias("description"), "geom")


def owners(annotated: DataFrame, trace: DataFrame, names: DataFrame) -> DataFrame:
    """(site, uid, cp_owner) of contested units: the names (site, name) of the other sites whose trace (site, pidx) has the nearest foreign pipe, in order, joined by semicolons; blank if none."""
    held = trace.where("pidx IS NOT NULL").join(names.select("site", "name"), "site").groupBy(F.col("pidx").alias("cp_fpidx")).agg(F.collect_set("name").alias("all"))
    d = annotated.where("cp_flag <> ''").select("site", "uid", "cp_fpidx").join(held, "cp_fpidx", "left").join(names.select("site", "name"), "site", "left")
    rest = F.array_except(F.coalesce("all", F.array().cast("array<string>")), F.array(F.coalesce("name", F.lit(""))))
    return d.select("site", "uid", F.array_join(F.array_sort(rest), "; ").alias("cp_owner"))
