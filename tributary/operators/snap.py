"""Three-pass endpoint snapping and the node layer.

Endpoints are (ep_idx, pidx, is_start, fid, x, y), two for each pipe, with
ep_idx = 2 * pidx + (0 at the start, 1 at the end). Node ids are dense ranks by
the first endpoint of a node, so they don't depend on the order of merging.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tributary.operators.components import connected_components
from tributary.operators.graph import SMALL_EDGES
from tributary.operators.spatial import close_pairs, self_pairs, within
from tributary.session import materialize


def endpoints(pipes: DataFrame) -> DataFrame:
    """Both ends of pipes (pidx, fid, sx, sy, ex, ey)."""
    ends = F.array(
        F.struct(F.lit(True).alias("is_start"), F.col("sx").alias("x"), F.col("sy").alias("y")),
        F.struct(F.lit(False).alias("is_start"), F.col("ex").alias("x"), F.col("ey").alias("y")),
    )
    d = pipes.select("pidx", "fid", F.explode(ends).alias("e")).select("pidx", "fid", "e.*")
    return d.select((2 * F.col("pidx") + F.when(F.col("is_start"), 0).otherwise(1)).alias("ep_idx"), "pidx", "is_start", "fid", "x", "y")


def _clusters(points: DataFrame, pairs: DataFrame, key: str, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(key, first): the smallest key of the cluster that each point is merged into."""
    comp = connected_components(pairs.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")), small_edges=small_edges)
    return points.select(key).join(comp.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("first"))


def _summary(ep: DataFrame, by: str) -> DataFrame:
    return ep.groupBy(by).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.bool_or("is_start").alias("has_start"), F.bool_or(~F.col("is_start")).alias("has_end"))


def pure_ends(clusters: DataFrame) -> DataFrame:
    """Clusters where pipes only start or only end."""
    return clusters.where("has_start <> has_end")


def snap_endpoints(ep: DataFrame, tol: float, end_radius: float, manual: DataFrame | None = None, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(ep_idx, node_id): pass 1 merges endpoints within tol, pass 2 merges pass-1
    clusters of pure ends within end_radius, pass 3 applies manual snaps (x, y, radius).

    A manual snap that meets fewer than two clusters raises. Passes 2 and 3 measure
    pass-1 centroids.
    """
    ep = materialize(ep, "endpoints")
    one = materialize(_clusters(ep, close_pairs(ep, tol, "ep_idx"), "ep_idx", small_edges), "pass1")
    centre = materialize(_summary(ep.join(one, "ep_idx"), "first"), "pass1c")
    merges = close_pairs(pure_ends(centre), end_radius, "first")
    if manual is not None:
        m = materialize(manual.select("x", "y", F.col("radius").cast("double").alias("radius")).withColumn("snap", F.monotonically_increasing_id()), "manual")
        widest = m.agg(F.max("radius")).first()[0]
        if widest:
            hit = within(m, centre, widest, "snap", "first").join(m.select(F.col("snap").alias("a_id"), "radius"), "a_id").where("dist <= radius")
            per = materialize(m.select(F.col("snap").alias("a_id")).join(hit.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"), F.min("b_id").alias("low")), "a_id", "left"), "manualn")
            if bad := per.where("coalesce(n, 0) < 2").count():
                raise ValueError(f"{bad} manual snaps meet fewer than two clusters")
            merges = merges.union(hit.join(per, "a_id").where("b_id <> low").select(F.col("low").alias("a_id"), "b_id"))
    two = materialize(_clusters(centre, merges, "first", small_edges).withColumnRenamed("first", "pass1").toDF("pass1", "final"), "pass2")
    joined = one.withColumnRenamed("first", "pass1").join(two, "pass1").select("ep_idx", "final")
    # dense ids: number the nodes by ranges of their first endpoint, then shift by range
    return joined.join(dense_ids(two.select("final").distinct(), "final"), "final").select("ep_idx", "node_id")


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, node_id): 0-based ranks of distinct keys, without gathering them in one task."""
    parts = materialize(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()), "rank")
    size = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"))
    base = size.withColumn("base", F.sum("n").over(W.Window.orderBy("low").rowsBetween(W.Window.unboundedPreceding, -1))).select("part", F.coalesce("base", F.lit(0)).alias("base"))
    local = F.row_number().over(W.Window.partitionBy("part").orderBy(key)) - 1
    return parts.withColumn("local", local).join(F.broadcast(base), "part").select(key, (F.col("base") + F.col("local")).cast("long").alias("node_id"))


def sums_before(df: DataFrame, key: str, n: str) -> DataFrame:
    """(key, before): the sum of n over all smaller keys, without gathering the keys in one task; keys are distinct."""
    parts = materialize(df.select(key, n).repartitionByRange(key).withColumn("part", F.spark_partition_id()), "sums")
    base = parts.groupBy("part").agg(F.sum(n).alias("all"), F.min(key).alias("low"))
    base = base.withColumn("base", F.sum("all").over(W.Window.orderBy("low").rowsBetween(W.Window.unboundedPreceding, -1))).select("part", F.coalesce("base", F.lit(0)).alias("base"))
    local = F.coalesce(F.sum(n).over(W.Window.partitionBy("part").orderBy(key).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("local", local).join(F.broadcast(base), "part").select(key, (F.col("base") + F.col("local")).cast("long").alias("before"))


def node_layer(ep: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, x, y, n_pipes, fids, role): centroid of raw endpoints, distinct pipe ids as first seen."""
    d = ep.join(nodes, "ep_idx")
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ep_idx", "fid"))), lambda s: s["fid"]))
    out = d.groupBy("node_id").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count_distinct("pidx").alias("n_pipes"), seen.alias("fids"), F.bool_or("is_start").alias("s"), F.bool_or(~F.col("is_start")).alias("e")
    )
    role = F.when(F.col("s") & F.col("e"), "junction").when(F.col("s"), "start").otherwise("end")
    return out.withColumn("role", role).drop("s", "e")


def gap_band(layer: DataFrame, tol: float, radius: float, key: str = "node_id") -> DataFrame:
    """Pairs of the node layer's pure starts and ends further apart than tol and at most radius, as distance of coordinates rounded to 2 places."""
    p = layer.where("role <> 'junction'").withColumns({"x": F.bround("x", 2), "y": F.bround("y", 2)})
    return self_pairs(p, radius, key, above=tol)


def build_edges(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, pidx): one edge for each pipe from its start's node to its end's."""
    ends = nodes.withColumns({"pidx": F.floor(F.col("ep_idx") / 2).cast("long"), "at": F.col("ep_idx") % 2})
    g = ends.groupBy("pidx").agg(F.max(F.when(F.col("at") == 0, F.col("node_id"))).alias("u"), F.max(F.when(F.col("at") == 1, F.col("node_id"))).alias("v"))
    return g.join(pipes.select("pidx"), "pidx", "left_semi").select("u", "v", "pidx")
