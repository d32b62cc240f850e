"""All checks of a network in one table of flags, one of their pipes and one of the pipes' states."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import geo
from tributary.operators import graph, quality, snap
from tributary.operators.components import connected_components
from tributary.operators.spatial import close_pairs, nearest_any, self_pairs, within
from tributary.session import materialize


@dataclass(frozen=True)
class Settings:
    """Distances in feet, counts of nodes; the defaults are the published ones."""

    snap_tol: float = 1.0
    gap_radius: float = 10.0
    manhole_snap: float = 5.0
    cycle_nodes: int = 10
    fragment_nodes: int = 50


def _apart(pairs: DataFrame, pipes_of: DataFrame, key: str) -> DataFrame:
    """Pairs (a_id, b_id, dist) whose sides share no pipe; pipes_of is (key, pidx)."""
    a = pipes_of.select(F.col(key).alias("a_id"), "pidx")
    b = pipes_of.select(F.col(key).alias("b_id"), "pidx")
    shared = pairs.join(a, "a_id").join(b, ["b_id", "pidx"]).select("a_id", "b_id").distinct()
    return pairs.join(shared, ["a_id", "b_id"], "left_anti")


def _open_pairs(layer: DataFrame, radius: float, above: float) -> DataFrame:
    """Pairs (a_id < b_id, dist) of nodes further apart than ``above`` and at most radius, of which one or both are no junction.

    Only the ends look for others: two junctions near each other are never joined.
    """
    ends = materialize(layer.where("role <> 'junction'"), "ends")
    p = within(ends, layer, radius, "node_id", "node_id").where((F.col("a_id") != F.col("b_id")) & (F.col("dist") > above))
    both = ends.select(F.col("node_id").alias("b_id"), F.lit(True).alias("both"))
    p = p.join(both, "b_id", "left").where("both IS NULL OR a_id < b_id")
    return p.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "dist")


def _gap_rows(pairs: DataFrame, at: DataFrame, pipes_of: DataFrame, key: str, tier: str, severity: str) -> tuple[DataFrame, DataFrame]:
    p = materialize(pairs.withColumn("flag", F.format_string(f"{tier}_%d_%d", "a_id", "b_id")), "gaps")
    side = at.select(key, "x", "y")
    d = p.join(side.toDF("a_id", "ax", "ay"), "a_id").join(side.toDF("b_id", "bx", "by"), "b_id")
    rows = d.select("flag", F.lit("snap_gap").alias("flag_type"), F.lit(severity).alias("severity"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), "dist")
    ends = p.select("flag", F.explode(F.array("a_id", "b_id")).alias(key))
    return rows, ends.join(pipes_of, key).select("flag", "pidx").distinct()


def run_qa(
    pipes: DataFrame, manholes: DataFrame, settings: Settings = Settings(), manual: DataFrame | None = None, split_log: DataFrame | None = None, edit_log: DataFrame | None = None
) -> dict[str, DataFrame]:
    """flags, members and pipes.

    pipes: (pidx, fid, frommh, tomh, slope, up_inv, dn_inv, sx, sy, ex, ey), with
    coords where lines bend; manholes: (fid, x, y). flags: (flag, flag_type,
    severity, x, y, dist, description), dist the gap or how far an isolated manhole
    is from the nearest node; members: (flag, flag_type, pidx); pipes: qa_flags and
    qa_status. A pipe without one of its manholes is direction_inferrable, flagged or
    not. The logs of plans.network add a flag for each cut and each edit.
    """
    s = settings
    ep = materialize(snap.endpoints(pipes), "endpoints")
    node_of = materialize(snap.snap_endpoints(ep, s.snap_tol, s.gap_radius, manual), "nodes")
    edges = materialize(snap.build_edges(pipes, node_of), "edges")
    none = F.lit(None).cast("double")

    if "coords" in pipes.columns:
        (cx, cy), length = geo.line_centroid("coords"), geo.line_length("coords")
    else:
        cx, cy = (F.col("sx") + F.col("ex")) / 2, (F.col("sy") + F.col("ey")) / 2
        length = F.sqrt(F.pow(F.col("ex") - F.col("sx"), 2) + F.pow(F.col("ey") - F.col("sy"), 2))
    middle = pipes.select("pidx", F.coalesce(cx, "sx").alias("cx"), F.coalesce(cy, "sy").alias("cy"), length.alias("len"))

    def located(members: DataFrame) -> DataFrame:
        """One row for each flag of members, at the length-weighted middle of its pipes."""
        severity = F.when(F.col("flag_type").isin("directed_cycle", "large_cycle"), "review_required").otherwise("warning")
        d = members.join(middle, "pidx").groupBy("flag", "flag_type")
        mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("len")) / F.nullif(F.sum("len"), F.lit(0.0)), F.avg(c))
        return d.agg(mean("cx").alias("x"), mean("cy").alias("y")).select("flag", "flag_type", severity.alias("severity"), "x", "y", none.alias("dist"))

    def of_pipe(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(F.format_string(f"{kind}_%d", "pidx").alias("flag"), F.lit(kind).alias("flag_type"), "pidx")

    single = of_pipe(quality.missing_direction(pipes), "missing_direction").union(of_pipe(quality.invert_conflicts(pipes), "invert_conflict")).union(of_pipe(quality.slope_errors(pipes), "attribute_slope_error"))

    # gaps that the snap repaired, between clusters of its first pass, and gaps that are left
    first = snap._clusters(ep, close_pairs(ep, s.snap_tol, "ep_idx"), "ep_idx")
    tagged = materialize(ep.join(first, "ep_idx"), "pass1")
    ends = snap.pure_ends(snap._summary(tagged, "first"))
    near = tagged.select("first", "pidx").distinct()
    repaired = _gap_rows(_apart(self_pairs(ends, s.gap_radius, "first", above=s.snap_tol), near, "first"), ends, near, "first", "repaired_gap", "warning")
    layer = materialize(snap.node_layer(ep, node_of).select("node_id", "x", "y", "role"), "layer")
    at_node = edges.select(F.col("u").alias("node_id"), "pidx").union(edges.select("v", "pidx")).distinct()
    open_ = _gap_rows(_apart(_open_pairs(layer, 2 * s.gap_radius, s.snap_tol), at_node, "node_id"), layer, at_node, "node_id", "open_gap", "review_required")

    scc = materialize(graph.strong_components(edges), "scc")
    size = scc.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") > s.cycle_nodes, "large_cycle").otherwise("directed_cycle")
    cycles = at_node.join(scc.withColumnRenamed("node", "node_id"), "node_id").select("scc", "pidx").distinct().join(size, "scc")
    cycles = cycles.select(F.format_string("cycle_%d", "scc").alias("flag"), kind.alias("flag_type"), "pidx")

    comp = materialize(connected_components(edges, small_edges=graph.SMALL_EDGES), "comp")
    small = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    several = small.limit(2).count() > 1
    small = small.where((F.col("n") <= s.fragment_nodes) & F.lit(several)).select("component")
    fragments = edges.select(F.col("u").alias("node"), "pidx").join(comp, "node").join(small, "component", "left_semi")
    fragments = fragments.select(F.format_string("component_%d", "component").alias("flag"), F.lit("disconnected_component").alias("flag_type"), "pidx")

    alone = materialize(quality.isolated(manholes, pipes, "fid").where("x IS NOT NULL AND y IS NOT NULL").select(F.struct("fid", "x", "y").alias("k"), "fid", "x", "y"), "isolated")
    reach = nearest_any(alone, layer, s.manhole_snap, "k", "node_id").select(F.col("a_id").alias("k"), "dist")
    lone = alone.join(reach, "k", "left").select(F.concat(F.lit("isolated_"), "fid").alias("flag"), F.lit("isolated_manhole").alias("flag_type"), F.lit("warning").alias("severity"), "x", "y", "dist")
    logged, log_members = [], []
    for log, kind, key in ((split_log, "midspan_junction", "pidx"), (edit_log, "manual_edit", "pidx")):
        if log is not None:
            named = log.withColumn("flag", F.format_string(f"{kind}_%d", "ord")).withColumn("flag_type", F.lit(kind))
            logged.append(named.select("flag", "flag_type", F.lit("warning").alias("severity"), "x", "y", none.alias("dist")))
            log_members.append(named.select("flag", "flag_type", key))
    gaps = [rows.select("flag", "flag_type", "severity", "x", "y", "dist") for rows, _ in (repaired, open_)]
    members = reduce(DataFrame.union, [*log_members, single, *[m.select("flag", F.lit("snap_gap").alias("flag_type"), "pidx") for _, m in (repaired, open_)], cycles, fragments])
    members = materialize(members, "members")
    placed = members.where(~F.col("flag_type").isin("snap_gap", "midspan_junction", "manual_edit"))
    flags = reduce(DataFrame.union, [*logged, *gaps, located(placed), lone])
    flags = flags.withColumn("description", describe(s))
    state = pipes.join(quality.rollup(members.drop("flag")), "pidx", "left")
    inferrable = F.col("frommh").isNull() | F.col("tomh").isNull()
    status = F.when(inferrable, "direction_inferrable").otherwise(F.coalesce("qa_status", F.lit("original")))
    return {"flags": materialize(flags, "flags"), "members": members, "pipes": state.withColumns({"qa_flags": F.coalesce("qa_flags", F.lit("")), "qa_status": status})}


def suspects(members: DataFrame, pipes: DataFrame) -> DataFrame:
    """(flag, pidx, fid, reasons, ord) of the pipes of large cycles; reasons uphill_invert (any sign of the inverts) and negative_slope. ord numbers them by flag, those with a reason first, then by pipe."""
    up = F.when(F.coalesce(F.col("up_inv") < F.col("dn_inv"), F.lit(False)), "uphill_invert")
    neg = F.when(F.coalesce(F.col("slope") < 0, F.lit(False)), "negative_slope")
    d = members.where("flag_type = 'large_cycle'").join(pipes, "pidx").select("flag", "pidx", "fid", F.array_compact(F.array(up, neg)).alias("reasons"))
    d = materialize(d.withColumn("k", F.struct("flag", (F.size("reasons") == 0).alias("clean"), "pidx")), "suspects")
    return d.join(snap.dense_ids(d.select("k"), "k"), "k").drop("k").withColumnRenamed("node_id", "ord")


def describe(s: Settings) -> Column:
    """What a flag says, in words, from its type, severity and distance."""
    far = F.format_string("%.1f", "dist")
    words = {
        "midspan_junction": F.lit("a line or manhole ties in between this pipe's ends; it was cut there for the trace, and should be in the source"),
        "manual_edit": F.lit("a reviewer's edit was applied for the trace; make it in the source too"),
        "missing_direction": F.lit("an end's manhole isn't named; the drawn direction counts"),
        "invert_conflict": F.lit("the upstream invert lies below the downstream one"),
        "attribute_slope_error": F.lit("the slope is negative though the inverts aren't"),
        "snap_gap": F.concat(F.lit("pipe ends "), F.format_string("%.2f", "dist"), F.when(F.col("severity") == "warning", f" ft apart, joined for the trace as they lie within {s.gap_radius:g} ft").otherwise(" ft apart and not joined")),
        "directed_cycle": F.lit("pipes drawn so that flow returns to where it came from"),
        "large_cycle": F.lit("a cycle too large to show as one; see its suspects"),
        "disconnected_component": F.lit(f"a part of at most {s.fragment_nodes} nodes without connection to the rest"),
        "isolated_manhole": F.when(F.col("dist") <= s.manhole_snap, F.concat(F.lit("no pipe names it, but one ends "), far, F.lit(" ft away: the ids may differ"))).otherwise(F.concat(F.lit("no pipe names it, and the nearest pipe end is "), far, F.lit(" ft away"))),
    }
    out = F.lit("")
    for kind, text in words.items():
        out = F.when(F.col("flag_type") == kind, text).otherwise(out)
    return out
