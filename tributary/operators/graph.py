"""Directed multigraphs: edges (u, v, ...) from upstream u to downstream v."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.components import connected_components
from tributary.session import discard, materialize


#: Graphs of at most so many edges are traced from a broadcast table, and solved for components in one task.
SMALL_EDGES = 1_000_000


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree), parallel edges and self-loops counted."""
    ends = edges.select(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("v", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def roles(edges: DataFrame) -> DataFrame:
    """degrees() with role: source (nothing enters), sink (nothing leaves) or junction."""
    role = F.when(F.col("in_degree") == 0, "source").when(F.col("out_degree") == 0, "sink").otherwise("junction")
    return degrees(edges).withColumn("role", role)


def multiplicity(edges: DataFrame) -> DataFrame:
    """One row: n_edges, n_self_loops, and n_parallel (edges beyond the first of their end pair)."""
    pairs = edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.sum("n").alias("n_edges"),
        F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("n"))), F.lit(0)).alias("n_self_loops"),
        F.sum(F.col("n") - 1).alias("n_parallel"),
    )


def component_edges(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(component, n_nodes, n_edges) of the weak components."""
    comp = connected_components(edges, small_edges=small_edges)
    nodes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    lines = edges.join(comp.withColumnRenamed("node", "u"), "u").groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    return nodes.join(lines, "component", "left").select("component", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def dangling_edges(edges: DataFrame, most: int, pidx: str = "pidx") -> DataFrame:
    """pidx of the edges in weak components of at most ``most`` edges."""
    comp = connected_components(edges, small_edges=SMALL_EDGES)
    tagged = edges.join(comp.withColumnRenamed("node", "u"), "u").select("component", pidx)
    small = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    return tagged.join(small, "component", "left_semi").select(pidx)


def _trace_small(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The trace with the edge table broadcast: each task searches for its own sites."""
    up = defaultdict(list)
    for u, v, p in edges.select("u", "v", "pidx").collect():
        up[v].append((u, p))
    sent = edges.sparkSession.sparkContext.broadcast(dict(up))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for site, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                front, seen, depth, out = [target], {target}, 0, []
                while front:
                    depth, after = depth + 1, []
                    for v in front:
                        for u, p in sent.value.get(v, ()):
                            out.append((site, u, v, p, depth))
                            if u not in seen:
                                seen.add(u)
                                after.append(u)
                    front = after
                if out:
                    kinds = (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["site", "u", "v", "pidx", "depth"])

    rows = targets.select("site", F.col("node").cast("long")).distinct()
    return rows.mapInArrow(run, f"site {targets.schema['site'].dataType.simpleString()}, u long, v long, pidx long, depth int")


def _trace_levels(edges: DataFrame, seen: DataFrame, level: int) -> DataFrame:
    """Go on from what is seen (site, node, level), complete up to a level, one level a round."""
    up = edges.select("u", F.col("v").alias("node"))
    parts = [seen]
    frontier = seen.where(F.col("level") == level)
    while True:
        level += 1
        reached = frontier.join(up, "node").select("site", F.col("u").alias("node")).distinct()
        known = reduce(DataFrame.union, parts).select("site", "node")
        frontier = materialize(reached.join(known, ["site", "node"], "left_anti").withColumn("level", F.lit(level)), "front")
        if frontier.limit(1).count() == 0:
            return reduce(DataFrame.union, parts)
        parts.append(frontier)
        if len(parts) % 16 == 0:  # keeps the union short on deep networks
            parts = [materialize(reduce(DataFrame.union, parts), "front")]


def _reach(edges: DataFrame, targets: DataFrame, growth: int = 4) -> DataFrame:
    """(site, node, level): every node from which a target can be reached, with the fewest steps.

    What is known within n steps and all walks of exactly n steps give what is known
    within 2n, so the rounds grow with the logarithm of the depth. Where nearly all
    nodes have one way on, walks are no more than edges; once there are ``growth``
    times as many, the search goes on level by level.
    """
    hop = materialize(edges.select("v", "u").distinct(), "hop")
    seen = materialize(targets.select("site", "node").distinct().withColumn("level", F.lit(0)), "seen")
    most, n, step = growth * max(hop.count(), 1), seen.count(), 1
    while True:
        more = seen.join(hop, F.col("node") == F.col("v")).select("site", F.col("u").alias("node"), (F.col("level") + step).alias("level"))
        grown = materialize(seen.union(more).groupBy("site", "node").agg(F.min("level").alias("level")), "seen")
        discard(seen)
        seen, before = grown, n
        n = seen.count()
        if n == before:
            return seen
        step *= 2
        ways = hop.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(hop.groupBy(F.col("v").alias("u")).agg(F.count(F.lit(1)).alias("m")), "u")
        if (ways.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) > most:
            return _trace_levels(edges, seen, step - 1)
        # a walk's ends are enough, whatever lies between
        longer = materialize(hop.join(hop.select(F.col("v").alias("u"), F.col("u").alias("w")), "u").select("v", F.col("w").alias("u")).distinct(), "hop")
        discard(hop)
        hop = longer


def trace_upstream(edges: DataFrame, targets: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(site, u, v, pidx, depth): every edge that drains to each target (site, node), for all sites at once.

    An edge's depth is one more than the fewest steps from its head to the target;
    cycles end. At most ``small_edges`` edges are broadcast, if each site has one
    target, and searched by a task for each of its sites.
    """
    edges = materialize(edges.select(*[F.col(c).cast("long") for c in ("u", "v", "pidx")]), "edges")
    one_each = targets.groupBy("site").agg(F.count_distinct("node").alias("n")).where("n > 1").limit(1).count() == 0
    if one_each and edges.limit(small_edges + 1).count() <= small_edges:
        return _trace_small(edges, targets)
    heads = _reach(edges, targets).select("site", F.col("node").alias("v"), (F.col("level") + 1).alias("depth"))
    return heads.join(edges, "v").select("site", "u", "v", "pidx", "depth")


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The largest label that reaches each node along u -> v edges; labels is (node, label)."""
    while True:
        sent = edges.join(labels.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), "label")
        both = labels.select("node", "label", F.col("label").alias("old")).unionByName(sent.withColumn("old", F.lit(None).cast("long")))
        step = materialize(both.groupBy("node").agg(F.max("label").alias("label"), F.max("old").alias("old")), "colour")
        moved = step.where("label <> old").limit(1).count()
        discard(labels)
        path, labels = step._scratch, step.drop("old")
        labels._scratch = path
        if not moved:
            return labels


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges at nodes that lack an entering or a leaving edge, one layer of them."""
    core = edges.select(F.col("u").alias("node")).intersect(edges.select("v"))
    return edges.join(core.withColumnRenamed("node", "u"), "u", "left_semi").join(core.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v")


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, inner, rings): each way through nodes with one edge in and one out becomes one edge.

    inner: (node, a, b), the ends of the way that a node taken out lies on; rings:
    (node, ring) of closed ways, which are taken out whole, by their smallest node.
    Pointers along the ways are doubled, so the rounds grow with the logarithm of
    their length.
    """
    deg = degrees(edges)
    mid = materialize(deg.where("in_degree = 1 AND out_degree = 1").select("node"), "mid")
    if mid.limit(1).count() == 0:
        none = edges.sparkSession.createDataFrame([], "node long, a long, b long")
        return edges, none, none.select("node", F.col("a").alias("ring"))
    inside = mid.withColumnRenamed("node", "p").withColumn("on", F.lit(True))
    ways = {}
    for name, here, there in (("a", "v", "u"), ("b", "u", "v")):
        step = edges.select(F.col(here).alias("node"), F.col(there).alias("p")).join(mid, "node", "left_semi")
        step = materialize(step.join(inside, "p", "left").select("node", "p", F.coalesce("on", F.lit(False)).alias("on"), F.least("node", "p").alias("low")), "way")
        size, done = mid.count(), 1
        while done < size and step.where("on").limit(1).count():
            nxt = step.select(F.col("node").alias("p"), F.col("p").alias("q"), F.col("on").alias("q_on"), F.col("low").alias("q_low"))
            d = step.join(nxt, "p", "left")
            grown = materialize(d.select("node", F.when(F.col("on"), F.col("q")).otherwise(F.col("p")).alias("p"), (F.col("on") & F.coalesce("q_on", F.lit(False))).alias("on"), F.least("low", F.when(F.col("on"), F.col("q_low"))).alias("low")), "way")
            discard(step)
            step, done = grown, 2 * done
        ways[name] = step
    # a pointer that is still on a way after as many steps as there are nodes runs in a ring
    rings = materialize(ways["a"].where("on").select("node", F.col("low").alias("ring")), "rings")
    inner = materialize(ways["a"].where("NOT on").select("node", F.col("p").alias("a")).join(ways["b"].where("NOT on").select("node", F.col("p").alias("b")), "node"), "inner")
    out = edges.join(mid.withColumnRenamed("node", "u"), "u", "left_anti").join(mid.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v")
    return materialize(out.union(inner.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct(), "core"), inner, rings


def _scc_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tarjan's algorithm without recursion over all edges of a small graph."""
    out: dict[int, list[int]] = defaultdict(list)
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out[a].append(b)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    on, stack, found = set(), [], []
    for start in list(out):
        if start in order:
            continue
        work = [(start, iter(out.get(start, ())))]
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        while work:
            node, it = work[-1]
            for nxt in it:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    if len(group) > 1:
                        least = min(group)
                        found += [(n, least) for n in group]
    cols = list(zip(*found)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "scc"])


def strong_components(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(node, scc): members of strongly connected components of two nodes or more; scc is the smallest member.

    Trimming a layer and replacing unbranched ways by one edge, in turn, removes trees
    in logarithmically many rounds and takes plain rings out; what remains is coloured
    forwards by the largest node that reaches each node, and each colour's root
    collects, backwards within its colour, its component. The rest goes on. At most
    ``small_edges`` edges are solved in one task instead.
    """
    live = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "live")
    if live.limit(small_edges + 1).count() <= small_edges:
        return live.coalesce(1).mapInArrow(_scc_one_task, "node long, scc long")
    taken: list[DataFrame] = []  # nodes on ways, by the round that took them out
    loops: list[DataFrame] = []
    while True:
        n = live.count()
        cut = materialize(_trim(live), "trim")
        live, inner, rings = _compress(cut)
        taken.append(inner)
        loops.append(rings)
        live = materialize(live.where("u <> v"), "live")
        if live.count() == n or live.limit(1).count() == 0:
            break
    found = _coloured(live)
    member = reduce(DataFrame.union, [found, *loops]) if loops else found
    member = materialize(member.toDF("node", "scc"), "scc")
    # backwards: a node on a way belongs to its ends' component, if they have one, and ends that are one node with it
    for inner in reversed(taken):
        ends = inner.join(member.select(F.col("node").alias("a"), F.col("scc").alias("sa")), "a", "left").join(member.select(F.col("node").alias("b"), F.col("scc").alias("sb")), "b", "left")
        own = ends.where("a = b OR (sa IS NOT NULL AND sa = sb)").select("node", "a", F.coalesce("sa", "a").alias("scc"))
        alone = own.select(F.col("a").alias("node"), "scc").distinct().join(member.select("node"), "node", "left_anti")
        member = materialize(member.union(own.select("node", "scc")).union(alone.select("node", "scc")), "scc")
    least = member.groupBy("scc").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return member.join(least, "scc").select("node", F.col("least").alias("scc"))


def _coloured(live: DataFrame) -> DataFrame:
    """(node, scc) of strong components of two nodes or more; scc is one of their nodes."""
    found = []
    while live.limit(1).count():
        n = live.count()
        live = materialize(_trim(live), "trim")
        if live.count() < n:
            continue
        nodes = live.select(F.col("u").alias("node")).union(live.select("v")).distinct()
        colour = _spread(materialize(nodes.withColumn("label", F.col("node")), "colour"), live)
        a, b = (colour.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "uv")
        same = materialize(live.join(a, "u").join(b, "v").where("lu = lv").select("u", "v", F.col("lu").alias("root")), "same")
        member = materialize(colour.where("node = label").select("node", F.col("label").alias("root")), "member")
        parts = [member]
        while True:
            back = same.join(member.select(F.col("node").alias("v"), "root"), ["v", "root"]).select(F.col("u").alias("node"), "root").distinct()
            member = materialize(back.join(reduce(DataFrame.union, parts), ["node", "root"], "left_anti"), "member")
            if member.limit(1).count() == 0:
                break
            parts.append(member)
        done = materialize(reduce(DataFrame.union, parts), "scc")
        found.append(done)
        gone = done.select("node")
        rest = live.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti")
        live = materialize(rest.select("u", "v"), "live")
    if not found:
        return live.sparkSession.createDataFrame([], "node long, scc long")
    every = reduce(DataFrame.union, found)
    return every.join(every.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "root").select("node", F.col("root").alias("scc"))


def cycle_flags(edges: DataFrame, large: int) -> DataFrame:
    """(scc, n_nodes, n_pipes, flag): pipes touching a component's nodes; large_cycle above ``large`` nodes."""
    member = strong_components(edges)
    u, v = (member.select(F.col("node").alias(c), F.col("scc").alias("scc")) for c in "uv")
    touch = edges.join(u, "u").select("pidx", "scc").union(edges.join(v, "v").select("pidx", "scc")).distinct()
    size = member.groupBy("scc").agg(F.count(F.lit(1)).alias("n_nodes"))
    pipes = touch.groupBy("scc").agg(F.count(F.lit(1)).alias("n_pipes"))
    return size.join(pipes, "scc").withColumn("flag", F.when(F.col("n_nodes") > large, "large_cycle").otherwise("directed_cycle"))


def ranked_components(member: DataFrame) -> DataFrame:
    """(scc, n_nodes, scc_id): components (node, scc) numbered from 0 by size, the largest first; equal ones by their smallest node."""
    size = materialize(member.groupBy("scc").agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("k", F.struct((-F.col("n_nodes")).alias("neg"), "scc")), "sizes")
    from tributary.operators.snap import dense_ids

    return size.join(dense_ids(size.select("k"), "k"), "k").select("scc", "n_nodes", F.col("node_id").alias("scc_id"))
