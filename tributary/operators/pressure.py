"""Force mains: undirected topology, termini, contacts with gravity nodes, verdicts and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.components import connected_components
from tributary.operators.graph import SMALL_EDGES, degrees
from tributary.operators.snap import _clusters, dense_ids, endpoints
from tributary.operators.spatial import close_pairs, nearest, nearest_any, within
from tributary.session import materialize

MILE = 5280.0
#: Verdicts, contacts that count as real, and the questions of a review.
RESOLVED, TERMINAL = "resolved", "terminates_at_facility"
SETTLED = (RESOLVED, TERMINAL)
CONFIRMED = ("connected", "facility")
DIRECTION_OPEN = ("no_discharge", "no_wetwell", "multi_discharge")
JUNCTION, AMBIGUOUS = "fm_junction_candidate", "fm_direction_ambiguous"
NO_CONTACT, STATION_ADJACENT = "fm_no_gravity_contact", "fm_station_adjacent_discharge"


def components(mains: DataFrame) -> DataFrame:
    """mains (pidx, a, b, ...) with comp, the smallest cluster of the component."""
    comp = connected_components(mains.select(F.col("a").alias("u"), F.col("b").alias("v")), small_edges=SMALL_EDGES)
    return mains.join(comp.select(F.col("node").alias("a"), F.col("component").alias("comp")), "a")


def termini(mains: DataFrame) -> DataFrame:
    """Clusters with exactly one distinct neighbour, themselves excluded."""
    both = mains.select(F.col("a").alias("node"), F.col("b").alias("nbr")).union(mains.select("b", "a")).where("node <> nbr")
    return both.groupBy("node").agg(F.count_distinct("nbr").alias("n")).where("n = 1").select("node")


def cycle_rank(tagged: DataFrame) -> DataFrame:
    """(comp, n_edges, n_nodes, n_cycles): E - V + 1 of each component."""
    nodes = tagged.select("comp", F.col("a").alias("node")).union(tagged.select("comp", "b")).distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("n_nodes"))
    edges = tagged.groupBy("comp").agg(F.count(F.lit(1)).alias("n_edges"))
    return edges.join(nodes, "comp").select("comp", "n_edges", "n_nodes", (F.col("n_edges") - F.col("n_nodes") + 1).alias("n_cycles"))


def small_stubs(tagged: DataFrame, gaps: DataFrame, diameter: float, length: float, tol: float) -> DataFrame:
    """Components to prune: all diameters known and below, total length below, and no cluster within tol of gravity."""
    d = tagged.groupBy("comp").agg(F.bool_and(F.coalesce(F.col("diameter") < diameter, F.lit(False))).alias("thin"), F.sum("length_ft").alias("len"))
    g = gaps.groupBy("comp").agg(F.min("gap").alias("gap"))
    return d.join(g, "comp", "left").where((F.col("len") < length) & F.col("thin") & (F.coalesce("gap", F.lit(float("inf"))) > tol)).select("comp")


def distinct_neighbours(mains: DataFrame) -> DataFrame:
    """(node, n_nbr) of every cluster: how many others it meets, itself not counted."""
    both = mains.select(F.col("a").alias("node"), F.col("b").alias("nbr")).union(mains.select("b", "a"))
    return both.groupBy("node").agg(F.count_distinct(F.when(F.col("node") != F.col("nbr"), F.col("nbr"))).alias("n_nbr"))


def topology(mains: DataFrame, tol: float, joins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mains with a, b and comp, clusters (node, x, y, n_nbr, comp)) of mains (pidx, fid, sx, sy, ex, ey, ...).

    Ends within tol are one cluster, named by its first end (2 * pidx, one more for
    the line's end), whose place is the cluster's. A join (ord, x, y, radius) merges
    all clusters with an end in its reach, in order; one that finds fewer than two
    as merged so far raises. Joins are hand-written: only the clusters that they
    reach come to the driver.
    """
    ends = materialize(endpoints(mains), "ends")
    first = materialize(_clusters(ends, close_pairs(ends, tol, "ep_idx"), "ep_idx"), "clusters")
    if joins is not None:
        j = materialize(joins.select("ord", "x", "y", F.col("radius").cast("double").alias("radius")), "joins")
        widest = j.agg(F.max("radius")).first()[0]
        hit = within(j, ends, widest, "ord", "ep_idx").join(j.select(F.col("ord").alias("a_id"), "radius"), "a_id").where("dist <= radius") if widest else None
        met: dict[int, set[int]] = {r.ord: set() for r in j.collect()}
        for r in hit.join(first.withColumnRenamed("ep_idx", "b_id"), "b_id").select("a_id", "first").distinct().collect() if hit is not None else ():
            met[r.a_id].add(r["first"])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for ord_ in sorted(met):
            groups = sorted({find(x) for x in met[ord_]})
            if len(groups) < 2:
                raise ValueError(f"join {ord_} reaches {len(groups)} clusters of ends; it needs two to merge")
            root.update((g, groups[0]) for g in groups[1:])
        merged = first.sparkSession.createDataFrame([(x, find(x)) for x in root], "first long, joined long")
        first = materialize(first.join(F.broadcast(merged), "first", "left").select("ep_idx", F.coalesce("joined", "first").alias("first")), "joined")
    at = ends.select(F.col("ep_idx").alias("node"), "x", "y")
    side = first.select((F.col("ep_idx") % 2).alias("end"), F.expr("ep_idx div 2").alias("pidx"), "first")
    both = side.groupBy("pidx").agg(F.max(F.when(F.col("end") == 0, F.col("first"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("first"))).alias("b"))
    tagged = materialize(components(mains.join(both, "pidx")), "mains")
    comp = tagged.select(F.col("a").alias("node"), "comp").union(tagged.select("b", "comp")).distinct()
    return tagged, materialize(distinct_neighbours(tagged).join(comp, "node").join(at, "node"), "clusters")


def prune(mains: DataFrame, stubs: DataFrame) -> DataFrame:
    """mains without the components of stubs (comp), numbered afresh from 0 in the old order; old_pidx keeps the old number."""
    left = mains.join(stubs.select("comp"), "comp", "left_anti").drop("a", "b", "comp")
    return left.join(dense_ids(left.select("pidx"), "pidx"), "pidx").withColumnsRenamed({"pidx": "old_pidx", "node_id": "pidx"})


def at_gravity(ends: DataFrame, nodes: DataFrame, edges: DataFrame, review: float) -> DataFrame:
    """ends (node, x, y, ...) with the nearest gravity node, however far: gravity_node, gap (2 places), in_degree, out_degree, gravity_role, gravity_x, gravity_y."""
    near = nearest_any(ends, nodes, review, "node", "node_id").select(F.col("a_id").alias("node"), F.col("b_id").alias("gravity_node"), F.bround("dist", 2).alias("gap"), F.col("dist").alias("_dist"))
    deg = degrees(edges).withColumnRenamed("node", "gravity_node")
    place = nodes.select(F.col("node_id").alias("gravity_node"), F.col("x").alias("gravity_x"), F.col("y").alias("gravity_y"), F.col("role").alias("gravity_role"))
    return ends.join(near, "node", "left").join(deg, "gravity_node", "left").join(place, "gravity_node", "left").fillna(0, ["in_degree", "out_degree"])


def classify(ends: DataFrame, snap: float, review: float) -> DataFrame:
    """Add contact and classification to termini (comp, node, gap, out_degree of the nearest gravity node); the unrounded distance counts if there is one."""
    gap = F.col("_dist") if "_dist" in ends.columns else F.col("gap")
    contact = F.when(gap <= snap, "connected").when(gap <= review, "candidate").otherwise("none")
    kind = F.when(F.col("out_degree") > 0, "discharge").otherwise("wetwell")
    d = ends.withColumn("contact", contact).drop("_dist")
    return d.withColumn("classification", F.when(F.col("contact") == "connected", kind).when(F.col("contact") == "candidate", F.concat(kind, F.lit("?"))).otherwise("no_gravity_contact"))


def verdicts(classified: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """(comp, n_termini, n_discharge, n_wetwell, n_candidate, verdict): the first verdict that holds.

    With tagged mains also n_pipes, n_clusters, n_cycles and length_ft (1 place), and
    components without a terminus as well.
    """
    c, sure = F.col("classification"), F.col("contact").isin(*CONFIRMED)
    d = classified.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n_termini"),
        F.count_if(sure & (c == "discharge")).alias("n_discharge"),
        F.count_if(sure & (c == "wetwell")).alias("n_wetwell"),
        F.count_if(F.col("contact") == "candidate").alias("n_candidate"),
        F.count_if(c == "terminal").alias("n_terminal"),
    )
    if tagged is not None:
        size = tagged.groupBy("comp").agg(F.count(F.lit(1)).alias("n_pipes"), F.bround(F.sum("length_ft"), 1).alias("length_ft"))
        rank = cycle_rank(tagged).select("comp", F.col("n_nodes").alias("n_clusters"), "n_cycles")
        d = size.join(rank, "comp").join(d, "comp", "left").fillna(0, ["n_termini", "n_discharge", "n_wetwell", "n_candidate", "n_terminal"])
    none = (F.col("n_discharge") == 0) & (F.col("n_wetwell") == 0)
    v = (
        F.when(F.col("n_terminal") > 0, "terminates_at_facility")
        .when(none & (F.col("n_candidate") > 0), "unconnected_only")
        .when(none, "isolated")
        .when(F.col("n_discharge") == 0, "no_discharge")
        .when(F.col("n_discharge") > 1, "multi_discharge")
        .when(F.col("n_wetwell") == 0, "no_wetwell")
        .otherwise(RESOLVED)
    )
    return d.withColumn("verdict", v).drop("n_terminal")


def mileage(verdict_rows: DataFrame) -> DataFrame:
    """(verdict, n, miles, share, settled): components, length and part of all length by verdict."""
    d = verdict_rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), (F.sum("length_ft") / MILE).alias("miles"))
    total = verdict_rows.agg(F.coalesce(F.sum("length_ft") / MILE, F.lit(0.0)).alias("all"))
    d = d.join(F.broadcast(total))  # one row
    return d.select("verdict", "n", "miles", F.coalesce(F.col("miles") / F.nullif(F.col("all"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.col("verdict").isin(*SETTLED).alias("settled"))


def longest_open(verdict_rows: DataFrame, n: int = 5) -> DataFrame:
    """The n longest components that are still to be reviewed."""
    return verdict_rows.where(~F.col("verdict").isin(*SETTLED)).orderBy(F.desc("length_ft"), "comp").limit(n)


def main_edges(classified: DataFrame) -> DataFrame:
    """(comp, u, v): one edge from each wet well to the discharge of its resolved component."""
    ok = verdicts(classified).where(F.col("verdict") == RESOLVED).select("comp")
    d = classified.where(F.col("contact").isin(*CONFIRMED)).join(ok, "comp", "left_semi")
    wet = d.where("classification = 'wetwell'").select("comp", F.col("gravity").alias("u"))
    out = d.where("classification = 'discharge'").select("comp", F.col("gravity").alias("v"))
    return wet.join(out, "comp").where("u <> v")


def main_links(classified: DataFrame, verdict_rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, skipped) of termini with gravity_node, gravity_x and gravity_y.

    links: one row for each wet well of a settled component, with the gravity nodes'
    places rounded to 3 digits and the names (node, name, which) of the mains at both
    ends. skipped: (comp, verdict, n_pipes, length_ft, reason) of every component, or
    wet well, that isn't wired; a verdict that its confirmed termini don't bear out is
    skipped too.
    """
    sure = classified.where(F.col("contact").isin(*CONFIRMED))
    count = sure.groupBy("comp").agg(F.count_if(F.col("classification") == "discharge").alias("n_dis"), F.count_if(F.col("classification") == "wetwell").alias("n_wet"))
    v = verdict_rows.join(count, "comp", "left").fillna(0, ["n_dis", "n_wet"])
    why = (
        F.when(F.col("verdict") == TERMINAL, "ends at a plant, so nothing is traced through it")
        .when(F.col("verdict") != RESOLVED, F.concat(F.lit("direction isn't settled: "), F.col("verdict")))
        .when((F.col("n_dis") + F.col("n_wet")) == 0, "no confirmed terminus")
        .when((F.col("n_dis") != 1) | (F.col("n_wet") < 1), F.format_string("verdict and termini disagree: %d discharges, %d wet wells", "n_dis", "n_wet"))
    )
    v = materialize(v.withColumn("reason", why), "reasons")
    named = lambda side: names.select(F.col("node").alias(f"{side}_node"), F.col("name").alias(f"{side}_pipe"))
    at = lambda side: [F.col("node").alias(f"{side}_node"), F.col("gravity_node").alias(f"{side}_g"), F.bround("gravity_x", 3).alias(f"{side}_x"), F.bround("gravity_y", 3).alias(f"{side}_y"), F.col("contact").alias(f"{side}_contact")]
    fine = v.where("reason IS NULL").select("comp", "verdict", "n_pipes", "length_ft")
    wet = sure.where("classification = 'wetwell'").select("comp", *at("wetwell"))
    out = sure.where("classification = 'discharge'").select("comp", *at("discharge"))
    pair = fine.join(wet, "comp").join(out, "comp").join(named("wetwell"), "wetwell_node", "left").join(named("discharge"), "discharge_node", "left")
    pair = materialize(pair.fillna("FM:?", ["wetwell_pipe", "discharge_pipe"]), "pairs")
    rows = pair.where("wetwell_g <> discharge_g").select("comp", "wetwell_pipe", "discharge_pipe", "wetwell_x", "wetwell_y", "discharge_x", "discharge_y", "n_pipes", "length_ft", "wetwell_contact", "discharge_contact", F.lit("").alias("note"))
    same = pair.where("wetwell_g = discharge_g").select("comp", "verdict", "n_pipes", "length_ft", F.format_string("wet well %s and discharge are one gravity node, %d", "wetwell_pipe", "wetwell_g").alias("reason"))
    return rows, v.where("reason IS NOT NULL").select("comp", "verdict", "n_pipes", "length_ft", "reason").unionByName(same)


def wired_miles(links: DataFrame) -> DataFrame:
    """One row: comps and miles of the wired components, each counted once."""
    return links.dropDuplicates(["comp"]).agg(F.count(F.lit(1)).alias("comps"), F.coalesce(F.sum("length_ft") / MILE, F.lit(0.0)).alias("miles"))


def end_names(tagged: DataFrame) -> DataFrame:
    """(node, name, which): the first main at each cluster, with the mark FM:, and which of its ends lies there."""
    name = F.concat(F.lit("FM:"), F.coalesce(F.col("fid").cast("string"), F.lit("?")))
    both = tagged.select(F.col("a").alias("node"), name.alias("name"), F.lit("start").alias("which"), (2 * F.col("pidx")).alias("k")).union(tagged.select("b", name, F.lit("end"), 2 * F.col("pidx") + 1))
    return both.groupBy("node").agg(F.min_by(F.struct("name", "which"), "k").alias("m")).select("node", "m.name", "m.which")


def plain_spot(in_degree: Column, out_degree: Column) -> Column:
    """What a gravity pipe end looks like, in words."""
    return F.when((in_degree > 0) & (out_degree > 0), "flow passes on downstream").when(in_degree > 0, "flow arrives and goes no further").when(out_degree > 0, "flow begins, with nothing above it").otherwise("no gravity pipe leads anywhere")


#: What is open about a component, in words.
PLAIN_VERDICT = {
    "no_discharge": "nowhere does it empty into a gravity pipe",
    "no_wetwell": "the station that pumps into it isn't known",
    "multi_discharge": "several ends seem to empty into gravity pipes",
    "isolated": "no end comes near a gravity pipe",
    "unconnected_only": "its ends come near gravity pipes, but none is connected",
}


def plain_verdict(verdict: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in PLAIN_VERDICT.items() for x in kv])
    return F.coalesce(words[verdict], F.concat(F.lit("unresolved: "), verdict))


def review_queue(classified: DataFrame, prefilled_gap: float = 25.0) -> DataFrame:
    """One row per terminus with its search radius (blank beyond a gap of prefilled_gap), worst first by rank and gap."""
    radius = F.when(F.col("gap") <= prefilled_gap, F.greatest(F.col("gap") / 2 * 1.25, F.lit(1.0)))
    rank = F.when(F.col("contact") == "connected", 2).when(F.col("contact") == "candidate", 0).otherwise(1)
    return classified.select("comp", "node", "contact", "gap", radius.alias("radius_ft"), rank.alias("rank"))


def review_rows(classified: DataFrame, verdict_rows: DataFrame, tagged: DataFrame, prefilled_gap: float = 25.0) -> DataFrame:
    """What a reviewer is asked: a row for each terminus, and one for each component without any (a closed ring).

    flag_type: beside a station, no contact, direction open, or a junction to confirm,
    in this order; x and y lie half-way between the end and the gravity node;
    radius_ft reaches both with a quarter to spare, blank for gaps over prefilled_gap.
    ord numbers the rows: junctions, open directions, no contact and ends beside a
    station, each by gap; rows without a gap come last among theirs.
    """
    names = end_names(tagged)
    adjacent = F.col("station_adjacent") if "station_adjacent" in classified.columns else F.lit(False)
    facility = F.coalesce(F.nullif("facility_name", F.lit("")), F.lit("a known facility")) if "facility_name" in classified.columns else F.lit("a known facility")
    d = classified.join(verdict_rows.select("comp", "verdict"), "comp", "left").join(names, "node", "left").fillna("FM:?", ["name"])
    open_ = F.col("verdict").isin(*DIRECTION_OPEN)
    kind = F.when(adjacent, STATION_ADJACENT).when(F.col("contact") == "none", NO_CONTACT).when(open_, AMBIGUOUS).otherwise(JUNCTION)
    spot, gap = plain_spot(F.col("in_degree"), F.col("out_degree")), F.format_number("gap", 1)
    words = (
        F.when(adjacent, F.concat(F.lit("reads as a discharge "), gap, F.lit(" ft away, but by a short main beside a station: is it part of the station?")))
        .when(F.col("contact") == "none", F.concat(gap, F.lit(" ft from the nearest gravity pipe end: is a pipe missing, or this one drawn wrong?")))
        .when(open_ & (F.col("contact") == "facility"), F.concat(F.lit("this end is settled by "), facility, F.lit("; the system's other ends aren't: "), plain_verdict(F.col("verdict"))))
        .when(open_, F.concat(F.lit("of this system "), plain_verdict(F.col("verdict")), F.lit("; this end is "), gap, F.lit(" ft from where "), spot, F.lit(": which end pumps?")))
        .otherwise(F.concat(gap, F.lit(" ft from a gravity pipe end where "), spot, F.lit(", which reads as a "), F.when(F.col("classification").startswith("wetwell"), "wet well").otherwise("discharge"), F.lit(": connect them?")))
    )
    radius = F.when(F.col("gap") <= prefilled_gap, F.bround(F.greatest(F.col("gap") / 2 * 1.25, F.lit(1.0)), 2))
    mid = lambda c: F.bround((F.col(c) + F.col(f"gravity_{c}")) / 2, 3).alias(c)
    rows = d.select(
        kind.alias("flag_type"), F.col("name").alias("pipe_id"), mid("x"), mid("y"), F.lit("").alias("decision"), radius.alias("radius_ft"), F.lit("").alias("target"), words.alias("comment"),
        F.col("which").alias("fm_end"), "comp", F.col("verdict").alias("comp_verdict"), "classification", "contact", F.col("gap").alias("dist_ft"), "gravity_node", "gravity_role", F.bround("x", 3).alias("fm_x"), F.bround("y", 3).alias("fm_y"),
    )
    first = tagged.groupBy("comp").agg(F.min_by(F.coalesce(F.col("fid").cast("string"), F.lit("?")), "pidx").alias("fid"))
    ring = verdict_rows.where("n_termini = 0").join(first, "comp")
    none = lambda name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    say = F.concat(F.lit("closed ring of "), F.col("n_pipes").cast("string"), F.lit(" mains, "), F.format_number(F.col("length_ft") / MILE, 2), F.lit(" mi, without a free end: is a piece missing?"))
    rings = ring.select(
        F.lit(AMBIGUOUS).alias("flag_type"), F.concat(F.lit("FM:"), "fid").alias("pipe_id"), none("x"), none("y"), F.lit("").alias("decision"), none("radius_ft"), F.lit("").alias("target"), say.alias("comment"),
        F.lit("").alias("fm_end"), "comp", F.col("verdict").alias("comp_verdict"), F.lit("ring").alias("classification"), F.lit("none").alias("contact"), none("dist_ft"), none("gravity_node"), none("gravity_role"), none("fm_x"), none("fm_y"),
    )
    every = materialize(rows.unionByName(rings), "review")
    rank = F.when(F.col("flag_type") == JUNCTION, 0).when(F.col("flag_type") == AMBIGUOUS, 1).when(F.col("flag_type") == NO_CONTACT, 2).otherwise(3)
    key = F.struct(rank.alias("rank"), F.col("dist_ft").isNull().alias("no_gap"), F.coalesce("dist_ft", F.lit(0.0)).alias("gap"), "comp", F.coalesce("gravity_node", F.lit(-1)).alias("g"), F.coalesce("fm_x", F.lit(0.0)).alias("fx"), F.coalesce("fm_y", F.lit(0.0)).alias("fy"), "pipe_id", "fm_end")
    every = materialize(every.withColumn("_key", key), "reviewkey")
    return every.join(dense_ids(every.select("_key").distinct(), "_key"), "_key").drop("_key").withColumnRenamed("node_id", "ord")


def settle(rows: DataFrame, prior: DataFrame | None, auto_ft: float = 0.1, same_ft: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(open, settled) review rows; settled ones say how (settled_as, settled_why), once each.

    auto_accepted: a junction with a gap of at most auto_ft; facility_confirmed: an end
    that a facility pins; already_decided: a prior decision (fm_x, fm_y, note) within
    same_ft of the end, the nearest one's note.
    """
    if prior is not None and prior.limit(1).count():
        p = prior.groupBy("fm_x", "fm_y").agg(F.min("note").alias("note")).select(F.struct("fm_x", "fm_y").alias("at"), F.col("fm_x").alias("x"), F.col("fm_y").alias("y"), "note")
        ends = rows.select("ord", F.col("fm_x").alias("x"), F.col("fm_y").alias("y"))
        hit = nearest(ends, p, same_ft, "ord", "at").select(F.col("a_id").alias("ord"), F.col("b_id").alias("at")).join(p.select("at", "note"), "at").drop("at")
        d = rows.join(hit, "ord", "left")
    else:
        d = rows.withColumn("note", F.lit(None).cast("string"))
    auto = F.coalesce((F.col("flag_type") == JUNCTION) & (F.col("dist_ft") <= auto_ft), F.lit(False))
    how = F.when(auto, "auto_accepted").when(F.col("contact") == "facility", "facility_confirmed").when(F.col("note").isNotNull(), "already_decided")
    why = F.when(auto, f"gap of at most {auto_ft:g} ft").when(F.col("contact") == "facility", "a known facility pins this end").otherwise(F.col("note"))
    d = materialize(d.withColumns({"settled_as": how, "settled_why": why}).drop("note"), "settled")
    return d.where("settled_as IS NULL").drop("settled_as", "settled_why"), d.where("settled_as IS NOT NULL")
