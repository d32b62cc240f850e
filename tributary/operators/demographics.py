"""Weighted aggregation of census units with error propagation.

Missing values are NULL throughout: a NULL count adds nothing, and a comparison
with NULL is false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tributary.functions import shapes
from tributary.operators import polygons
from tributary.operators.spatial import box_pairs
from tributary.session import materialize


def residential(use: str, prefixes: tuple[str, ...], tokens: tuple[str, ...], vacant: str = "VAC") -> Column:
    """Use starts with a prefix or contains a token (case counts), and doesn't start with the vacant prefix."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(use).startswith(p)
    for t in tokens:
        hit = hit | F.col(use).contains(t)
    return F.coalesce(hit & ~F.col(use).startswith(vacant), F.lit(False))


def clipped_fractions(boxes: DataFrame, site: DataFrame, box_id: str, site_id: str, cell: float) -> DataFrame:
    """(site, box, area, fraction): share of each box inside each site, 0 to 1."""
    p = box_pairs(boxes, site, box_id, site_id, cell).where("ow > 0 AND oh > 0")
    whole = boxes.select(F.col(box_id).alias("a_id"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("whole"))
    d = p.join(whole, "a_id").withColumn("area", F.col("ow") * F.col("oh"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("area") / F.nullif(F.col("whole"), F.lit(0.0))))
    return d.select(F.col("b_id").alias(site_id), F.col("a_id").alias(box_id), "area", share.alias("fraction"))


def dasymetric_weights(units: DataFrame, parcels: DataFrame, sites: DataFrame, unit_id: str, parcel_id: str, site_id: str, cell: float) -> DataFrame:
    """(site, unit, weight): residential area in unit and site over residential area in the unit.

    Areas are sums over parcels, so overlapping parcels count twice in both. The
    weight is at most 1, and 0 if the unit has no residential area.
    """
    c = ("x0", "y0", "x1", "y1")
    # equal boxes have equal overlaps: each is measured once, a parcel's as often as it occurs
    def spread(df: DataFrame) -> DataFrame:
        d = df.select(*c).where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").groupBy(*c).agg(F.count(F.lit(1)).alias("times"))
        return materialize(d.withColumn("box", F.monotonically_increasing_id()), "boxes")

    lots, places = spread(parcels), spread(units)
    pu = materialize(box_pairs(lots, places, "box", "box", cell).where("ow > 0 AND oh > 0").join(lots.select(F.col("box").alias("a_id"), "times"), "a_id"), "lots")
    total = pu.groupBy(F.col("b_id").alias("box")).agg(F.sum(F.col("ow") * F.col("oh") * F.col("times")).alias("denom"))
    us = materialize(box_pairs(places, sites, "box", site_id, cell).where("ow > 0 AND oh > 0").select(F.col("a_id").alias("box"), F.col("b_id").alias(site_id)), "sites")
    both = us.join(pu.select(F.col("a_id").alias("lot"), F.col("b_id").alias("box"), "times"), "box")
    for df, key, of, tag in ((places, "box", "box", "u"), (lots, "box", "lot", "p"), (sites, site_id, site_id, "s")):
        both = both.join(df.select(F.col(key).alias(of), *[F.col(x).alias(tag + x) for x in c]), of)
    w = F.least("ux1", "px1", "sx1") - F.greatest("ux0", "px0", "sx0")
    h = F.least("uy1", "py1", "sy1") - F.greatest("uy0", "py0", "sy0")
    inside = both.groupBy(site_id, "box").agg(F.sum(F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) * F.col("times")).alias("numer"))
    d = us.join(inside, [site_id, "box"], "left").join(total, "box", "left")
    weight = F.when(F.coalesce(F.col("denom"), F.lit(0.0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("numer"), F.lit(0.0)) / F.nullif(F.col("denom"), F.lit(0.0))))
    d = d.select(site_id, "box", weight.alias("weight")).join(places.drop("times"), "box")
    return d.join(units.select(unit_id, *c), [*c]).select(site_id, unit_id, "weight")


def apportion(weight: str, *codes: str) -> Column:
    """Weighted sum of the codes' counts."""
    value = F.lit(0.0)
    for c in codes:
        value = value + F.coalesce(F.col(c), F.lit(0))
    return F.coalesce(F.sum(F.col(weight) * value), F.lit(0.0))


def apportion_moe(weight: str, *moes: str) -> Column:
    """Margin of error of a weighted sum: root of the sum of squares, codes in quadrature."""
    square = F.lit(0.0)
    for m in moes:
        square = square + F.pow(F.col(weight) * F.coalesce(F.col(m), F.lit(0.0)), 2)
    return F.sqrt(F.coalesce(F.sum(square), F.lit(0.0)))


def proportion_moe(num: Column, den: Column, moe_num: Column, moe_den: Column) -> Column:
    """Margin of a proportion; the plus form where the minus form has a negative root; NULL without denominator."""
    p = num / F.nullif(den, F.lit(0.0))
    minus = moe_num * moe_num - p * p * moe_den * moe_den
    plus = moe_num * moe_num + p * p * moe_den * moe_den
    return F.when(den > 0, F.sqrt(F.when(minus >= 0, minus).otherwise(plus)) / F.nullif(den, F.lit(0.0)))


def pooled_median(bins: DataFrame, site: str = "site") -> DataFrame:
    """(site, median) of pooled histograms (site, lo, hi, n): interpolated in the bin that crosses half.

    An open bin (hi NULL) returns its lower bound; a bin of zero count its lower
    bound; a site without counts NULL.
    """
    w = W.Window.partitionBy(site).orderBy("lo")
    d = bins.groupBy(site, "lo", "hi").agg(F.sum("n").alias("n"))
    d = d.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.Window.partitionBy(site)))
    crossed = d.where("total > 0 AND cum >= total / 2e0").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    inside = F.col("lo") + (F.col("total") / 2.0 - (F.col("cum") - F.col("n"))) / F.nullif(F.col("n"), F.lit(0.0)) * (F.col("hi") - F.col("lo"))
    value = F.when(F.col("hi").isNull() | (F.col("n") == 0), F.col("lo")).otherwise(inside)
    return bins.select(site).distinct().join(crossed.select(site, value.cast("double").alias("median")), site, "left")


def property_stats(served: DataFrame, site: str = "site", value: str = "val", weight: str | None = "weight") -> DataFrame:
    """(site, n, total, mean, median): total and mean weighted, the median not."""
    w = F.col(weight) if weight else F.lit(1.0)
    d = served.where(F.col(value).isNotNull()).withColumn("w", w)
    return d.groupBy(site).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("w") * F.col(value)).alias("total"),
        (F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"),
        F.median(value).alias("median"),
    )


def block_groups(blocks: DataFrame, geoid: str, counts: tuple[str, ...] = ()) -> DataFrame:
    """(group_id, n_blocks, counts..., geom): blocks (geoid, geom) merged to groups by the first 12 digits of the zero-padded id."""
    key = F.substring(F.lpad(F.col(geoid), 15, "0"), 1, 12).alias("group_id")
    d = blocks.select(key, "geom", *counts)
    sums = d.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_blocks"), *[F.sum(c).alias(c) for c in counts])
    return sums.join(polygons.dissolve(d, "group_id"), "group_id", "left")


def with_counts(blocks: DataFrame, decennial: DataFrame, acs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, groups): blocks (geoid, geom) with the decennial table by GEOID20, and their groups with the survey's by the zero-padded GEOID.

    Blocks and groups without a row keep NULL counts.
    """
    b = blocks.select(F.lpad(F.col("geoid").cast("string"), 15, "0").alias("geoid"), "geom")
    groups = block_groups(b, "geoid").withColumnRenamed("group_id", "geoid")
    keyed = lambda d, key, n: d.select(F.lpad(F.col(key).cast("string"), n, "0").alias("geoid"), *[c for c in d.columns if c not in (key, "NAME")])
    dec, est = keyed(decennial, "GEOID20", 15), keyed(acs, "GEOID", 12)
    return b.join(dec, "geoid", "left"), groups.join(est, "geoid", "left")


def polygon_weights(units: DataFrame, homes: DataFrame, sites: DataFrame, cell: float = 500.0) -> DataFrame:
    """(site, geoid, weight) of units (geoid, geom) that meet sites (site, geom), by residential parcels (pid, geom).

    Residential area in unit and site over that in the unit, each a sum over
    parcels; at most 1, and 0 for a unit without any.
    """
    u, h = units.select("geoid", "geom"), homes.select("pid", "geom")
    part = polygons.overlaps(h, u, "pid", "geoid", cell)
    part = part.select("pid", "geoid", shapes.two("intersection", "a_geom", "b_geom").alias("geom")).where("geom IS NOT NULL")
    part = materialize(part.withColumn("area", shapes.measure("area", "geom")).where("area > 0"), "parts")
    total = part.groupBy("geoid").agg(F.sum("area").alias("denom"))
    us = polygons.overlaps(u, sites.select("site", "geom"), "geoid", "site", cell)
    us = us.where(shapes.measure("intersects", "a_geom", "b_geom") == 1).select("geoid", "site")
    inside = us.join(sites.select("site", F.col("geom").alias("s_geom")), "site").join(part, "geoid")
    inside = inside.groupBy("site", "geoid").agg(F.sum(shapes.measure("shared", "geom", "s_geom")).alias("numer"))
    d = us.join(inside, ["site", "geoid"], "left").join(total, "geoid", "left")
    share = F.least(F.lit(1.0), F.coalesce("numer", F.lit(0.0)) / F.col("denom"))
    return d.select("site", "geoid", F.when(F.col("denom") > 0, share).otherwise(0.0).alias("weight"))


def clipped_parcels(parcels: DataFrame, sites: DataFrame, cell: float = 500.0) -> DataFrame:
    """(site, pid, fraction) of parcels (pid, geom) that meet sites (site, geom): the part of each one's area inside, 0 to 1."""
    p = polygons.overlaps(parcels.select("pid", "geom"), sites.select("site", "geom"), "pid", "site", cell)
    p = p.where(shapes.measure("intersects", "a_geom", "b_geom") == 1)
    part = F.coalesce(shapes.measure("shared", "a_geom", "b_geom"), F.lit(0.0)) / F.nullif(shapes.measure("area", "a_geom"), F.lit(0.0))
    return p.select("site", "pid", F.least(F.lit(1.0), F.greatest(F.lit(0.0), part)).alias("fraction"))


@dataclass(frozen=True)
class Rate:
    """Codes of a survey rate; margins are optional."""

    num: tuple[str, ...]
    den: tuple[str, ...]
    num_moe: tuple[str, ...] = ()
    den_moe: tuple[str, ...] = ()


@dataclass(frozen=True)
class Spec:
    """What the columns of the census tables mean; income_bins are (code, lower, upper or None)."""

    total_pop: str
    race: dict[str, str]
    poverty: Rate
    snap: Rate
    income_bins: tuple[tuple[str, float, float | None], ...]
    ethnicity: dict[str, str] = field(default_factory=dict)
    value: str = "val"


def build_spec(settings: dict) -> Spec:
    """The Spec of a settings file's part ``demographics``; a single code may stand for a list of one."""
    roles = settings["roles"]
    codes = lambda x: () if x is None else (x,) if isinstance(x, str) else tuple(x)
    rate = lambda r: Rate(*(codes(r.get(k)) for k in ("num", "den", "num_moe", "den_moe")))
    bins = tuple((code, float(lo), None if hi is None else float(hi)) for code, lo, hi in roles["income_bins"])
    return Spec(roles["total_pop"], dict(roles["race"]), rate(roles["poverty"]), rate(roles["snap"]), bins, dict(roles.get("ethnicity") or {}), settings.get("property_value_col", "PARVAL"))


def rate_columns(name: str, universe: str, below: str, r: Rate) -> tuple[list[Column], list[Column]]:
    """(aggregates over weighted groups, columns of them) of a rate: its universe, its cases, the rate and its margin, both in percent."""
    aggs = [apportion("weight", *r.num).alias(f"_{name}_n"), apportion("weight", *r.den).alias(f"_{name}_d"), apportion_moe("weight", *r.num_moe).alias(f"_{name}_nm"), apportion_moe("weight", *r.den_moe).alias(f"_{name}_dm")]
    n, d, nm, dm = (F.col(f"_{name}_{k}") for k in ("n", "d", "nm", "dm"))
    moe = 100 * proportion_moe(n, d, nm, dm) if r.num_moe and r.den_moe else F.lit(None).cast("double")
    rate = 100 * n / F.nullif(d, F.lit(0.0))
    return aggs, [F.bround(d).cast("long").alias(universe), F.bround(n).cast("long").alias(below), rate.alias(f"{name}_rate"), moe.alias(f"{name}_rate_moe")]


def site_records(sites: DataFrame, blocks: DataFrame, groups: DataFrame, homes: DataFrame, parcels: DataFrame, spec: Spec, cell: float = 500.0) -> DataFrame:
    """One flat record per site (site, geom), of all sites at once.

    blocks and groups: (geoid, geom, codes...); homes: the residential parcels (pid,
    geom); parcels: (pid, geom, value). Counts are rounded half to even; shares and
    rates without a denominator are NULL; a median has no margin. Parcel values
    count by the part of the parcel inside, their median as they are.
    """
    shapes.register(sites.sparkSession)
    people = spec.race | spec.ethnicity
    bw = polygon_weights(blocks, homes, sites, cell).join(blocks.drop("geom"), "geoid")
    codes = {spec.total_pop, *people.values()}
    b = bw.groupBy("site").agg(*[apportion("weight", c).alias(f"_{c}") for c in sorted(codes)])
    total = F.col(f"_{spec.total_pop}")
    cols = [F.bround(F.coalesce(total, F.lit(0.0))).cast("long").alias("population")]
    for kind, part in (("race", spec.race), ("eth", spec.ethnicity)):
        for label, code in part.items():
            n = F.coalesce(F.col(f"_{code}"), F.lit(0.0))
            cols += [F.bround(n).cast("long").alias(f"{kind}_{label}"), (100 * n / F.nullif(total, F.lit(0.0))).alias(f"pct_{label}")]
    gw = materialize(polygon_weights(groups, homes, sites, cell).join(groups.drop("geom"), "geoid"), "groups")
    pov, pov_cols = rate_columns("poverty", "poverty_universe", "poverty_below", spec.poverty)
    snap, snap_cols = rate_columns("snap", "total_households", "snap_households", spec.snap)
    g = gw.groupBy("site").agg(F.count_if(F.col("weight") > 0).alias("n_block_groups"), *pov, *snap)
    row = lambda c, lo, hi: F.struct(F.lit(float(lo)).alias("lo"), F.lit(hi).cast("double").alias("hi"), (F.col("weight") * F.coalesce(F.col(c), F.lit(0))).cast("double").alias("n"))
    bins = gw.select("site", F.explode(F.array(*[row(*x) for x in spec.income_bins])).alias("b")).select("site", "b.*")
    income = pooled_median(bins).withColumnRenamed("median", "median_income")
    inside = clipped_parcels(parcels, sites, cell).join(parcels.select("pid", F.col(spec.value).cast("string").try_cast("double").alias("val")), "pid")
    w = F.when(F.col("val").isNotNull(), F.col("fraction"))
    worth = inside.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_parcels"),
        F.coalesce(F.sum(F.col("val") * F.col("fraction")), F.lit(0.0)).alias("prop_val_total"),
        (F.sum(F.col("val") * F.col("fraction")) / F.nullif(F.sum(w), F.lit(0.0))).alias("prop_val_mean"),
        F.median("val").alias("prop_val_median"),
    )
    own = [c for c in sites.columns if c != "geom"]
    d = sites.select(*own).join(b, "site", "left").join(g, "site", "left").join(income, "site", "left").join(worth, "site", "left").fillna(0, ["n_block_groups", "n_parcels"])
    zero = {f"_{k}_{x}": 0.0 for k in ("poverty", "snap") for x in ("n", "d", "nm", "dm")}
    d = d.fillna(zero)
    return d.select(*own, *cols, "n_block_groups", *pov_cols, *snap_cols, "median_income", F.lit(None).cast("double").alias("median_income_moe"), "n_parcels", "prop_val_total", "prop_val_mean", "prop_val_median")


#: Names of the record's columns in a table with names of ten letters at most.
SHORT_NAMES = {
    "population": "pop", "n_block_groups": "n_bg", "pct_two_plus": "pct_2plus", "pct_hispanic": "pct_hisp", "median_income": "med_inc", "poverty_rate": "pov_rate",
    "poverty_rate_moe": "pov_moe", "snap_rate_moe": "snap_moe", "prop_val_mean": "pval_mean", "prop_val_median": "pval_med",
}


def short_record(records: DataFrame, digits: int = 2) -> DataFrame:
    """The record's headline columns with names of ten letters at most, numbers rounded half to even."""
    keep = [c for c in records.columns if c in SHORT_NAMES or c == "site" or c in ("n_parcels", "snap_rate") or (c.startswith("pct_") and len(c) <= 10)]
    kind = dict(records.dtypes)
    return records.select(*[(F.bround(c, digits) if kind[c] == "double" else F.col(c)).alias(SHORT_NAMES.get(c, c)) for c in keep])
