"""Connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import discard, materialize


def _jump(parent: DataFrame) -> DataFrame:
    """Follow parents until each node points at the root of its hook tree."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = materialize(
            parent.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")),
            "jump",
        )
        moved = step.where("moved").limit(1).count()
        discard(parent)
        parent, kept = step.drop("moved"), step._scratch
        parent._scratch = kept
        if not moved:
            return parent


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a small graph; the root is the smallest member."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", small_edges: int = 0) -> DataFrame:
    """Return (node, component) for every node of edges; component is its smallest member.

    Each round hooks every node to its smallest neighbour, jumps pointers to the
    roots (local minima) and contracts the graph to them. A component keeps at
    most half of its nodes a round, so chains take logarithmically many rounds.
    Every join reads two tables at rest, so adaptive execution can split hubs.
    Null ends are ignored; a self-loop makes its node a component. A graph of at
    most ``small_edges`` distinct edges is solved in one task instead.
    """
    live = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    live = materialize(live.select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "edges")
    if small_edges and live.limit(small_edges + 1).count() <= small_edges:
        return live.coalesce(1).mapInArrow(_one_task, "node long, component long")
    total = None
    while True:
        both = live.union(live.select("v", "u"))
        hooked = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        parent = _jump(materialize(hooked.select("node", F.least("node", "low").alias("parent")), "hook"))
        if total is None:
            total = parent
        else:
            step = parent.select(F.col("node").alias("component"), F.col("parent").alias("root"))
            grown = materialize(
                total.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "label"
            )
            discard(total)
            total = grown
        if "parent" in total.columns:
            path = total._scratch
            total = total.withColumnRenamed("parent", "component")
            total._scratch = path
        a = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        shrunk = live.join(a, "u").join(b, "v").where("pu <> pv")
        shrunk = materialize(shrunk.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        discard(live)
        live = shrunk
        if live.limit(1).count() == 0:
            discard(live)
            return total
