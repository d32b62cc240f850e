"""What a person reads: summaries, counts, samples, checks of sampling sites, and flags in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tributary.functions import shapes
from tributary.operators.components import connected_components
from tributary.operators.graph import SMALL_EDGES, degrees, multiplicity, strong_components
from tributary.operators.spatial import nearest_any
from tributary.session import materialize

ACRE = 43560.0


def summarize_graph(edges: DataFrame, nodes: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """One row: nodes (node_id), edges, self-loops, parallel edges, sources, sinks, nodes without edges, weak components (those nodes are one each), strong components of two nodes or more and the largest one."""
    e = materialize(edges.select("u", "v"), "edges")
    deg = materialize(nodes.select(F.col("node_id").alias("node")).join(degrees(e), "node", "left").fillna(0, ["in_degree", "out_degree"]), "degrees")
    i, o = F.col("in_degree") > 0, F.col("out_degree") > 0
    a = deg.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(o & ~i).alias("n_sources"), F.count_if(i & ~o).alias("n_sinks"), F.count_if(~i & ~o).alias("n_isolated"))
    m = multiplicity(e).select(F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_self_loops", F.coalesce("n_parallel", F.lit(0)).alias("n_parallel"))
    c = connected_components(e, small_edges=small_edges).agg(F.count_distinct("component").alias("n_joined"))
    size = strong_components(e, small_edges).groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    s = size.agg(F.count(F.lit(1)).alias("n_sccs"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_scc"))
    d = a.join(F.broadcast(m)).join(F.broadcast(c)).join(F.broadcast(s))  # one row each
    return d.withColumn("weak_components", F.col("n_joined") + F.col("n_isolated")).drop("n_joined")


def largest_components(sizes: DataFrame, n: int = 10) -> DataFrame:
    """The n largest rows of (component, n_nodes, ...), numbered from 0; equal sizes by component."""
    return sizes.orderBy(F.desc("n_nodes"), "component").limit(n).withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("n_nodes"), "component")) - 1)


def worst_conflicts(conflicts: DataFrame, n: int = 5, key: str = "pidx") -> DataFrame:
    """The n conflicts that rise most; equal ones by key."""
    return conflicts.orderBy(F.desc("rise"), key).limit(n)


def deepest(points: DataFrame, by: str, depth: str, key: str, n: int) -> DataFrame:
    """The n points of each group with the least depth above zero; equal ones by key."""
    w = W.Window.partitionBy(by).orderBy(depth, key)
    return points.where(F.col(depth) > 0).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def percentiles(values: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row of interpolated percentiles, named p50 and so on."""
    return values.agg(*[F.percentile(column, q).alias(f"p{round(q * 100)}") for q in shares])


def flag_counts(flags: DataFrame) -> DataFrame:
    """(flag_type, severity, status, n); a flag without a status is open."""
    status = F.coalesce("status", F.lit("open")) if "status" in flags.columns else F.lit("open")
    return flags.groupBy("flag_type", "severity", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def sample_across_types(flags: DataFrame, n: int, order: str) -> DataFrame:
    """n flags, one of each type in turn: types by their first flag in order, flags of a type in order."""
    d = flags.withColumn("_turn", F.row_number().over(W.Window.partitionBy("flag_type").orderBy(order)))
    first = flags.groupBy("flag_type").agg(F.min(order).alias("_first"))
    return d.join(F.broadcast(first), "flag_type").orderBy("_turn", "_first").limit(n).drop("_turn", "_first")  # one row a type


def check_sites(samples: DataFrame, nodes: DataFrame, edges: DataFrame, near: float = 50.0, small: int = 50, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(site, node, snap_ft, in_deg, out_deg, comp_size, flags) of samples (site, x, y): the nearest node, and what is odd about it, joined by semicolons, else OK."""
    e = materialize(edges.select("u", "v"), "edges")
    at = nearest_any(samples, nodes, near, "site", "node_id").select(F.col("a_id").alias("site"), F.col("b_id").alias("node"), "dist")
    comp = connected_components(e, small_edges=small_edges)
    size = comp.join(comp.groupBy("component").agg(F.count(F.lit(1)).alias("comp_size")), "component").select("node", "comp_size")
    scc = strong_components(e, small_edges).select("node", F.lit(True).alias("in_scc")).distinct()
    loop = e.where("u = v").select(F.col("u").alias("node"), F.lit(True).alias("loop")).distinct()
    d = materialize(at, "samples").join(degrees(e), "node", "left").join(size, "node", "left").join(scc, "node", "left").join(loop, "node", "left")
    # a node without edges is a component of its own
    d = d.fillna(0, ["in_degree", "out_degree"]).fillna(1, ["comp_size"])
    odd = F.array(
        F.when(F.col("in_scc"), "IN_NONTRIVIAL_SCC"),
        F.when(F.col("loop"), "SELF_LOOP"),
        F.when(F.col("comp_size") < small, F.format_string("SMALL_COMPONENT(%d)", "comp_size")),
        F.when(F.col("dist") > near, F.format_string("FAR_SNAP(%.0fft)", "dist")),
        F.when(F.col("in_degree") == 0, "NO_UPSTREAM"),
    )
    text = F.array_join(F.array_compact(odd), ";")
    return d.select("site", "node", F.bround("dist", 1).alias("snap_ft"), F.col("in_degree").alias("in_deg"), F.col("out_degree").alias("out_deg"), "comp_size", F.when(text == "", "OK").otherwise(text).alias("flags"))


def layer_name(source: Column, flag_type: Column) -> Column:
    """The layer that a flag is written to: net_ or delin_ and its type, in lower-case letters, digits and single underscores."""
    name = F.concat(F.when(source == "network", "net_").otherwise("delin_"), flag_type)
    return F.lower(F.trim(F.regexp_replace(name, "[^0-9A-Za-z]+", "_"), F.lit("_")))


def normalise(network: DataFrame | None, sites: DataFrame | None) -> DataFrame:
    """(source, feat_id, flag_type, severity, review, descr, layer, geom) of network flags (pipe_id, ...) and of sites' flags (site or uid, ...); flags without geometry are left out.

    A unit's flag is named by the unit, a site's by the site.
    """
    out = None
    for source, d in (("network", network), ("delineation", sites)):
        if d is None:
            continue
        some = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in d.columns else F.lit("")  # noqa: E731,B023
        who = [F.col(c).cast("string") for c in (("pipe_id",) if source == "network" else ("uid", "site")) if c in d.columns]
        rows = d.where("geom IS NOT NULL").select(
            F.lit(source).alias("source"), F.coalesce(*who, F.lit("")).alias("feat_id"), "flag_type", some("severity").alias("severity"), some("status").alias("review"),
            some("description").alias("descr"), layer_name(F.lit(source), F.col("flag_type")).alias("layer"), "geom",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def catchment_frame(sites: DataFrame, units: DataFrame, trace: DataFrame, shapes_: DataFrame) -> DataFrame:
    """(manhole, area_acres, n_parcels, n_pipes, max_depth, geom) of the merged units (site, geom) of each site that has some; links count as pipes."""
    n = units.groupBy("site").agg(F.count(F.lit(1)).alias("n_parcels"))
    t = trace.groupBy("site").agg(F.count(F.lit(1)).alias("n_pipes"), F.max("depth").alias("max_depth"))
    d = sites.select("site").join(shapes_, "site").join(n, "site", "left").join(t, "site", "left")
    return d.select(F.col("site").cast("string").alias("manhole"), acres("geom").alias("area_acres"), "n_parcels", "n_pipes", "max_depth", "geom")


def boundary_frame(shapes_: DataFrame, method: str) -> DataFrame:
    """(manhole, area_acres, method, geom) of the final boundaries (site, geom)."""
    return shapes_.where("geom IS NOT NULL").select(F.col("site").cast("string").alias("manhole"), acres("geom").alias("area_acres"), F.lit(method).alias("method"), "geom")


def trace_frame(pipes: DataFrame, trace: DataFrame) -> DataFrame:
    """The traced pipes of each site with depth and manhole; links have no row among the pipes."""
    t = trace.where("pidx IS NOT NULL").select("site", "pidx", "depth")
    return pipes.join(t, "pidx").withColumn("manhole", F.col("site").cast("string")).drop("site")


def acres(geom: str) -> Column:
    """Area in acres to 2 places, half to even."""
    return F.bround(F.coalesce(shapes.measure("area", geom), F.lit(0.0)) / ACRE, 2)


def median_area(shapes_: DataFrame) -> DataFrame:
    """One row: n sites and the median of their acres."""
    return shapes_.agg(F.count(F.lit(1)).alias("n"), F.median(F.coalesce(shapes.measure("area", "geom"), F.lit(0.0)) / ACRE).alias("median_acres"))

