"""Known pump stations and plants against force-main ends, reviewers' rulings, and wiring into the network.

facilities: (fac, name, role, x, y), fac their order; termini: (comp, node, x, y,
contact, classification, ...), one row for each cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.components import connected_components
from tributary.operators.graph import SMALL_EDGES, strong_components
from tributary.operators.spatial import nearest, nearest_any, within
from tributary.session import materialize

PLANT, STATION = "plant", "station"


def match(facilities: DataFrame, termini: DataFrame, plant_tol: float = 1000.0, station_tol: float = 200.0) -> DataFrame:
    """(fac, name, role, node, dist, status): the nearest terminus of each plant and station within its role's tolerance.

    status is matched, or no_force_main without a node; dist is then that of the
    nearest terminus beyond the tolerance. Other roles are left out; ties go to the
    smallest node.
    """
    live = facilities.where(F.col("role").isin(PLANT, STATION))
    tol = F.when(F.col("role") == PLANT, plant_tol).otherwise(station_tol)
    near = within(live, termini, max(plant_tol, station_tol), "fac", "node").withColumnsRenamed({"a_id": "fac", "b_id": "node"})
    near = near.join(live.select("fac", tol.alias("tol")), "fac").where("dist <= tol")
    best = near.groupBy("fac").agg(F.min(F.struct("dist", "node")).alias("m")).select("fac", F.col("m.node").alias("node"), F.col("m.dist").alias("dist"))
    best = materialize(best, "matched")
    far = nearest_any(live.join(best, "fac", "left_anti"), termini, max(plant_tol, station_tol), "fac", "node").select(F.col("a_id").alias("fac"), F.col("dist").alias("far"))
    d = live.select("fac", "name", "role").join(best, "fac", "left").join(far, "fac", "left")
    return d.select("fac", "name", "role", "node", F.coalesce("dist", "far").alias("dist"), F.when(F.col("node").isNull(), "no_force_main").otherwise("matched").alias("status"))


def stamp(termini: DataFrame, matches: DataFrame) -> DataFrame:
    """Add facility_name, facility_role, facility_dist and facility_conflict to termini; the last facility of a terminus counts.

    A plant makes its terminus terminal. A station makes it a wet well, but where
    the network says discharge the two conflict and nothing is changed.
    """
    m = matches.where("status = 'matched'").groupBy("node").agg(F.max_by(F.struct("name", "role", "dist"), "fac").alias("m"))
    d = termini.join(m, "node", "left")
    role = F.coalesce(F.col("m.role"), F.lit(""))
    clash = (role == STATION) & F.col("classification").startswith("discharge")
    known = (role != "") & ~clash
    return d.withColumns({
        "facility_name": F.coalesce(F.col("m.name"), F.lit("")),
        "facility_role": role,
        "facility_dist": F.col("m.dist"),
        "facility_conflict": clash,
        "contact": F.when(known, "facility").otherwise(F.col("contact")),
        "classification": F.when(known, F.when(role == PLANT, "terminal").otherwise("wetwell")).otherwise(F.col("classification")),
    }).drop("m")


def flags(matches: DataFrame, termini: DataFrame) -> DataFrame:
    """(flag_type, name, role, dist) of facilities without a main and of stations on a discharge."""
    bare = matches.where("status = 'no_force_main'").select(F.lit("facility_no_force_main").alias("flag_type"), "name", "role", "dist")
    clash = termini.where("facility_conflict").select(F.lit("facility_direction_conflict").alias("flag_type"), F.col("facility_name").alias("name"), F.lit(STATION).alias("role"), F.col("facility_dist").alias("dist"))
    return bare.unionByName(clash)


def _claims(rows: pd.DataFrame) -> pd.DataFrame:
    """Claims of one group of stations that share clusters, in order of fac."""
    free = set(rows.loc[rows.free, "node"])
    out = []
    for fac, near in rows.sort_values(["fac", "dist", "node"]).groupby("fac", sort=True):
        taken = near.node.isin(free)
        open_ = near[~taken & (near.n_nbr >= 2)]
        if len(open_) and not (taken.any() and near.dist[taken].min() <= open_.dist.iloc[0]):
            free.add(open_.node.iloc[0])
            out.append((fac, open_.node.iloc[0], open_.dist.iloc[0]))
    return pd.DataFrame(out, columns=["fac", "node", "dist"])


def station_junctions(facilities: DataFrame, clusters: DataFrame, termini: DataFrame, station_tol: float = 200.0) -> DataFrame:
    """(fac, node, dist): the junction where each station feeds the mains, if it is nearer than any free end.

    clusters: (node, x, y, n_nbr), n_nbr the distinct neighbours. A cluster goes to
    one station, in order of fac, and is a free end for the later ones. Stations
    that share no cluster are settled apart.
    """
    near = within(facilities.where(F.col("role") == STATION), clusters, station_tol, "fac", "node").withColumnsRenamed({"a_id": "fac", "b_id": "node"})
    near = near.join(clusters.select("node", "n_nbr"), "node").join(termini.select("node", F.lit(True).alias("free")).distinct(), "node", "left")
    near = near.select(F.col("fac").cast("long"), F.col("node").cast("long"), "dist", "n_nbr", F.coalesce("free", F.lit(False)).alias("free"))
    # clusters are even, stations odd
    links = near.select((F.col("node") * 2).alias("u"), (F.col("fac") * 2 + 1).alias("v"))
    group = connected_components(links, small_edges=SMALL_EDGES).toDF("v", "g")
    near = near.withColumn("v", F.col("fac") * 2 + 1).join(group, "v").drop("v")
    return near.groupBy("g").applyInPandas(_claims, "fac long, node long, dist double")


def overrule(termini: DataFrame, rulings: DataFrame, tol: float = 25.0) -> DataFrame:
    """termini with each ruling (ord, x, y, classification) on the nearest terminus within tol; the last ruling of one counts.

    RuntimeError when the result is read if a ruling meets no terminus.
    """
    hit = nearest(rulings, termini, tol, "ord", "node").withColumnsRenamed({"a_id": "ord", "b_id": "node"})
    r = rulings.select("ord", "x", "y", F.col("classification").alias("ruled")).join(hit, "ord", "left")
    lost = F.raise_error(F.format_string("direction ruling at (%s, %s) meets no terminus", "x", "y"))
    r = r.select("ord", F.when(F.col("node").isNull(), lost.cast("long")).otherwise(F.col("node")).alias("node"), "ruled")
    r = r.groupBy("node").agg(F.max_by("ruled", "ord").alias("ruled"))
    d = termini.join(r, "node", "left")
    ruled = F.col("ruled").isNotNull()
    new: dict[str, Column] = {"classification": F.coalesce("ruled", "classification"), "contact": F.when(ruled, "facility").otherwise(F.col("contact"))}
    if "facility_conflict" in termini.columns:
        new["facility_conflict"] = F.col("facility_conflict") & ~ruled
    return d.withColumns(new).drop("ruled")


def station_adjacent(termini: DataFrame, mains: DataFrame, facilities: DataFrame, longest: float = 25.0, station_tol: float = 200.0) -> DataFrame:
    """Add station_adjacent: a connected discharge by a short main beside a station; its contact becomes candidate.

    mains: (a, b, length_ft). It stays where the component's confirmed wet wells
    bear names and none is the nearest station's.
    """
    near = nearest(termini, facilities.where(F.col("role") == STATION), station_tol, "node", "fac").select(F.col("a_id").alias("node"), F.col("b_id").alias("fac"))
    near = near.join(facilities.select("fac", F.col("name").alias("station")), "fac").drop("fac")
    ends = mains.select(F.col("a").alias("node"), "length_ft").union(mains.select("b", "length_ft")).groupBy("node").agg(F.min("length_ft").alias("shortest"))
    wells = termini.where("classification = 'wetwell' AND contact IN ('connected', 'facility') AND trim(facility_name) <> ''")
    named = wells.groupBy("comp").agg(F.collect_set("facility_name").alias("names"))
    d = termini.join(near, "node", "left").join(ends, "node", "left").join(named, "comp", "left")
    other = F.coalesce(~F.array_contains("names", F.col("station")), F.lit(False))
    is_ = F.col("classification").startswith("discharge") & (F.col("contact") == "connected") & (F.col("shortest") <= longest) & F.col("station").isNotNull() & ~other
    d = d.withColumn("station_adjacent", F.coalesce(is_, F.lit(False)))
    return d.withColumn("contact", F.when(F.col("station_adjacent"), "candidate").otherwise(F.col("contact"))).drop("station", "shortest", "names")


def wire(edges: DataFrame, links: DataFrame, nodes: DataFrame, tol: float = 10.0) -> DataFrame:
    """edges (u, v, pidx) and one edge without pidx for each link (comp, wet_x, wet_y, out_x, out_y) between the nearest nodes.

    Links whose ends meet the same node are skipped. RuntimeError when the result
    is read if an end has no node within tol.
    """
    side = lambda n, x, y: F.struct(F.lit(n).alias("side"), F.col(x).alias("x"), F.col(y).alias("y"))
    # a link's fields are its key, so that a recomputed id can't part its ends
    ends = links.distinct().select("comp", "wet_x", "wet_y", "out_x", "out_y", F.explode(F.array(side(0, "wet_x", "wet_y"), side(1, "out_x", "out_y"))).alias("e"))
    ends = ends.select(F.struct("comp", "wet_x", "wet_y", "out_x", "out_y", "e.side").alias("k"), "e.x", "e.y")
    hit = nearest(ends, nodes, tol, "k", "node_id").select(F.col("a_id").alias("k"), F.col("b_id").alias("node"))
    lost = F.raise_error(F.format_string("force-main edge of component %s has no node within tolerance", "k.comp")).cast("long")
    at = ends.join(hit, "k", "left").withColumn("node", F.when(F.col("node").isNull(), lost).otherwise(F.col("node")))
    pair = at.groupBy("k.comp", "k.wet_x", "k.wet_y", "k.out_x", "k.out_y").agg(F.max(F.when(F.col("k.side") == 0, F.col("node"))).alias("u"), F.max(F.when(F.col("k.side") == 1, F.col("node"))).alias("v"))
    return edges.select("u", "v", "pidx").unionByName(pair.where("u <> v").select("u", "v", F.lit(None).cast("long").alias("pidx")))


def loops_through_mains(wired: DataFrame) -> DataFrame:
    """(u, v, component) of force-main edges (no pidx) inside a cycle of two nodes or more."""
    scc = strong_components(wired.select("u", "v")).toDF("node", "component")
    big = scc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("component")
    inside = scc.join(big, "component", "left_semi")
    d = wired.where("pidx IS NULL").select("u", "v").join(inside.select(F.col("node").alias("u"), "component"), "u")
    return d.join(inside.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").where("component = c").select("u", "v", "component")
