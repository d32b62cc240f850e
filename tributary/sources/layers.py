"""Layers as the plans take them: pipes, manholes, land units, blocks, boundaries and truth, in the working projection."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import geo, shapes
from tributary.operators import polygons
from tributary.session import materialize
from tributary.sources import gpkg, shapefile
from tributary.sources.decisions import decode

WORKING, DEGREES = "working", "degrees"
#: Codes that settings may name them by.
CODES = {"EPSG:2264": WORKING, "EPSG:4269": DEGREES, "EPSG:4326": DEGREES}
#: The columns that name a land unit, the first that a layer has; the first one is of a unit's part.
UNIT_IDS = ("PARTID", "ALTPARNO", "GEOID20")


def _text(spark: SparkSession, path: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return decode(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))


def read_layer(spark: SparkSession, path: str, layer: str | None = None, declared: str | None = None, what: str = "layer", where: str | None = None) -> DataFrame:
    """A layer's rows with geom in the working projection; .shp, .gpkg, or anything else as Parquet.

    A shapefile's .prj tells degrees from the working projection; without one, and
    for other files, declared does, and ValueError is raised for a shapefile without
    both. where is SQL on the columns, which a .gpkg file applies itself.
    """
    shapes.register(spark)
    declared = CODES.get(str(declared).upper(), declared)
    if path.endswith(".shp"):
        prj = _text(spark, path.removesuffix(".shp") + ".prj")
        crs = declared if prj is None else DEGREES if prj.lstrip().upper().startswith("GEOGCS") else WORKING
        if not crs:
            raise ValueError(f"the {what} doesn't say what its coordinates are, and the settings don't either")
        d = shapefile.read_shapefile(spark, path)
        d = d.where(where) if where else d
    elif path.endswith(".gpkg"):
        crs, d = declared or WORKING, gpkg.read_layer(spark, path, layer or gpkg.layers(spark, path)[0], where)
    else:
        crs, d = declared or WORKING, spark.read.parquet(path)
        d = d.where(where) if where else d
    if crs not in (WORKING, DEGREES):
        raise ValueError(f"coordinates of {what} can't be {crs!r}; expected {WORKING} or {DEGREES}")
    return d.withColumn("geom", shapes.project("geom")) if crs == DEGREES else d


def load_population_units(spark: SparkSession, path: str, declared: str | None = None) -> DataFrame:
    """Parcels with a geometry."""
    return read_layer(spark, path, declared=declared, what="parcel layer").where("geom IS NOT NULL")


def load_census_blocks(spark: SparkSession, path: str | None, county: str | None = None, declared: str | None = None) -> DataFrame:
    """Census blocks with a geometry, of one county if the layer has COUNTYFP20; the county is picked before anything is projected."""
    if not path:
        raise ValueError("no census block layer is set")
    shapes.register(spark)
    probe = read_layer(spark, path, declared=declared, what="block layer")
    where = f"COUNTYFP20 = '{county}'" if county is not None and "COUNTYFP20" in probe.columns else None
    d = read_layer(spark, path, declared=declared, what="block layer", where=where) if where else probe
    return d.where("geom IS NOT NULL")


def unit_id(units: DataFrame) -> str | None:
    """The column that names a unit: its part's, else its record's, else None."""
    return next((c for c in UNIT_IDS if c in units.columns), None)


def explode_units(units: DataFrame) -> DataFrame:
    """Units with a row for each part and PARTID: the unit's id and the part's number within the id; without an id column a running number of rows and parts."""
    base = next((c for c in UNIT_IDS[1:] if c in units.columns), None)
    d = units if base else units.withColumn("_row", F.monotonically_increasing_id())
    out = polygons.explode_parts(d, base or "_row").withColumnRenamed("partid", "PARTID")
    return out.withColumnRenamed("base_id", base) if base else out.drop("base_id")


def load_units(spark: SparkSession, kind: str, path: str, county: str | None = None, declared: str | None = None, explode: bool = True) -> DataFrame:
    """parcels or blocks, with a row for each part unless explode is false; ValueError for other kinds."""
    if kind not in ("parcels", "blocks"):
        raise ValueError(f"unknown units {kind!r}; expected parcels or blocks")
    d = load_population_units(spark, path, declared) if kind == "parcels" else load_census_blocks(spark, path, county, declared)
    return explode_units(d) if explode else d


def load_pipes(layer: DataFrame, order: str = "fidx") -> DataFrame:
    """(pidx, fid, frommh, tomh, slope, up_inv, dn_inv, coords, geom) of a gravity-main layer; pidx is the row's ordinal. Columns that lack are NULL; inverts of zero or less say nothing."""
    text = lambda name: F.col(name).cast("string") if name in layer.columns else F.lit(None).cast("string")
    number = lambda name: text(name).try_cast("double")
    return layer.select(
        F.col(order).cast("long").alias("pidx"), text("FACILITYID").alias("fid"), text("FROMMH").alias("frommh"), text("TOMH").alias("tomh"),
        number("SLOPE").alias("slope"), number("UPSTREAMIN").alias("up_inv"), number("DOWNSTREAM").alias("dn_inv"), shapes.coords("geom").alias("coords"), "geom",
    )


def load_manholes(layer: DataFrame, order: str = "fidx") -> DataFrame:
    """(ord, fid, x, y) and the layer's other columns."""
    more = [c for c in layer.columns if c not in (order, "FACILITYID", "geom", "ord", "fid", "x", "y")]
    return layer.select(F.col(order).cast("long").alias("ord"), F.col("FACILITYID").cast("string").alias("fid"), shapes.measure("x", "geom").alias("x"), shapes.measure("y", "geom").alias("y"), *more)


def _plain_id(name: str) -> Column:
    text = F.trim(F.regexp_replace(F.col(name).cast("string"), r"\.0$", ""))
    return F.coalesce(F.when(text.rlike(r"^\d+$"), F.coalesce(F.nullif(F.ltrim(text, F.lit("0")), F.lit("")), F.lit("0"))), text)


def load_truth(polygons_: DataFrame, points: DataFrame, site_id: str = "SiteID", point_id: str = "AssetID_tx") -> DataFrame:
    """(site, geom, x, y): truth polygons joined to sampling points by id, whole numbers without leading zeros; the last row of an id counts where it occurs twice.

    ValueError with the ids of either side alone if fewer than 20 sites, or two less
    than there are polygons, find a point.
    """
    poly = polygons_.where("geom IS NOT NULL").groupBy(_plain_id(site_id).alias("site")).agg(F.last("geom").alias("geom"))
    at = points.where("geom IS NOT NULL").groupBy(_plain_id(point_id).alias("site")).agg(F.last(F.struct(shapes.measure("x", "geom").alias("x"), shapes.measure("y", "geom").alias("y"))).alias("p"))
    both = materialize(poly.join(at, "site").select("site", "geom", "p.x", "p.y"), "truth")
    n, wanted = both.count(), poly.count()
    if n < max(20, wanted - 2):
        lone = lambda a, b: sorted(r.site for r in a.select("site").subtract(b.select("site")).orderBy("site").limit(20).collect())
        raise ValueError(f"only {n} of {wanted} truth polygons have a point; polygons alone: {lone(poly, at)}, points alone: {lone(at, poly)}")
    return both


def load_boundaries(spark: SparkSession, path: str, layer: str, site_id: str, label: str | None = None) -> DataFrame:
    """(site, label, geom) of the final boundaries."""
    d = read_layer(spark, path, layer, what="boundary layer")
    return d.select(F.col(site_id).cast("string").alias("site"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"), "geom")


def load_labels(layer: DataFrame, site_id: str, label: str) -> DataFrame:
    """(site, name): what each site is called; the first in order of one called differently."""
    return layer.where(F.col(site_id).isNotNull()).groupBy(F.col(site_id).cast("string").alias("site")).agg(F.coalesce(F.min(F.col(label).cast("string")), F.lit("")).alias("name"))


def _rows(text: str) -> list[dict[str, str]]:
    return [{(k or "").strip().lower(): (v or "").strip() for k, v in r.items() if not isinstance(v, list)} for r in csv.DictReader(io.StringIO(text))]


SITES = "ord long, site string, label string, facilityid string, x double, y double"


def parse_sites(text: str) -> list[tuple]:
    """Rows of a site list as SITES: a place if x and y are given, else an id; ids stay text. ValueError without any usable row."""
    out = []
    for row in _rows(text):
        name = next((c for c in ("facilityid", "manhole", "siteid", "id") if c in row), None)
        called = next((c for c in ("siteid", "label", "name") if c in row), name)
        if row.get("x") and row.get("y"):
            place, who = (float(row["x"]), float(row["y"])), None
        elif name and row[name]:
            place, who = (None, None), row[name]
        else:
            continue
        out.append((len(out), (called and row[called]) or who or "site", row.get("tract", ""), who, *place))
    if not out:
        raise ValueError("a site list needs x and y, or an id, in at least one row")
    return out


def site_list(spark: SparkSession, file: str | None = None, ids: str | None = None, settings: dict | None = None) -> DataFrame:
    """Sites (SITES) of a file, else of ids joined by commas, else of the settings' one target; ValueError if none is given or two share a name."""
    inputs = settings or {}
    if file:
        rows = parse_sites(_text(spark, file) or "")
    elif ids:
        rows = [(k, i, "", i, None, None) for k, i in enumerate(x.strip() for x in ids.split(",") if x.strip())]
    elif inputs.get("manhole_id"):
        rows = [(0, str(inputs["manhole_id"]), "", str(inputs["manhole_id"]), None, None)]
    elif inputs.get("manhole_coordinate") is not None:
        x, y = map(float, inputs["manhole_coordinate"])
        rows = [(0, f"({x:.0f},{y:.0f})", "", None, x, y)]
    else:
        raise ValueError("no site is given: set a manhole or a place, or pass ids or a file")
    if len({r[1] for r in rows}) < len(rows):
        raise ValueError("two sites have one name")
    return spark.createDataFrame(rows, SITES)


def meter_targets(spark: SparkSession, path: str) -> DataFrame:
    """(site, x, y) of a meter list with LOCATION NAME, LATITUDE and LONGITUDE, in the working projection; the name is what follows the first underscore.

    FileNotFoundError without the file, ValueError without the columns or a row.
    """
    text = _text(spark, path)
    if text is None:
        raise FileNotFoundError(f"no meter list at {path}")
    rows = _rows(text)
    head = {h.strip().lower() for h in next(csv.reader(io.StringIO(text)), [])}
    if lack := {"location name", "latitude", "longitude"} - head:
        raise ValueError(f"{path}: columns {sorted(lack)} are missing")
    if not rows:
        raise ValueError(f"{path} has no meter")
    d = spark.createDataFrame([(r["location name"].split("_", 1)[-1] if "_" in r["location name"] else r["location name"], float(r["latitude"]), float(r["longitude"])) for r in rows], "site string, lat double, lon double")
    x, y = geo.lcc("lat", "lon")
    return d.select("site", x.alias("x"), y.alias("y"))


def write_csv(rows: DataFrame, path: str, order: str | None = None) -> int:
    """Write a report as one CSV on the driver's disk, with a byte-order mark for spreadsheets and the header even without rows; returns the rows written."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for r in (rows.orderBy(order) if order else rows).toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
            n += 1
    return n
