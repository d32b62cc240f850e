"""Pipe geometry edits: midspan splits, welds and reviewers' edits. Pipes have coords, an array of struct<x,y>."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.geo import line_length, substring
from tributary.operators.snap import sums_before
from tributary.session import materialize


def merge_cuts(cuts: DataFrame, tol: float) -> DataFrame:
    """(pidx, cuts): each pipe's cut distances in order, a cut nearer than tol to the kept one before it left out."""
    d = cuts.groupBy("pidx").agg(F.array_sort(F.collect_list(F.col("along").cast("double"))).alias("all"))
    kept = f"aggregate(all, CAST(array() AS array<double>), (a, x) -> CASE WHEN size(a) = 0 OR x - element_at(a, -1) >= {float(tol)!r}e0 THEN concat(a, array(x)) ELSE a END)"
    return d.select("pidx", F.expr(kept).alias("cuts"))


def split_pipes(pipes: DataFrame, cuts: DataFrame, tol: float) -> DataFrame:
    """Pipes cut at distances (pidx, along): the first piece keeps pidx, the others get
    the next free ones in order of (pidx, distance). Adds parent and piece (from 0).
    """
    merged = merge_cuts(cuts, tol)
    d = pipes.join(merged, "pidx", "left").withColumn("_len", line_length("coords"))
    d = d.withColumn("_cuts", F.expr("filter(coalesce(cuts, CAST(array() AS array<double>)), c -> c > 0 AND c < _len)"))
    # pieces are numbered by their line's place among all lines: only lines are ranked, not pieces
    d = materialize(d.drop("cuts"), "cutlines")
    before = sums_before(d.select("pidx", F.size("_cuts").alias("n")).where("n > 0"), "pidx", "n")
    d = d.join(before.withColumnRenamed("before", "_before"), "pidx", "left")
    ends = d.withColumn("_piece", F.expr("explode(transform(sequence(0, size(_cuts)), i -> named_struct('i', i, 'a', coalesce(get(_cuts, i - 1), 0e0), 'b', coalesce(get(_cuts, i), _len))))"))
    whole = F.size("_cuts") == 0
    ends = ends.withColumn("coords", F.when(whole, F.col("coords")).otherwise(substring("coords", "_piece.a", "_piece.b")))
    top = pipes.agg((F.max("pidx") + 1).alias("n")).first()["n"] or 0
    out = ends.withColumn("parent", F.col("pidx")).withColumn("piece", F.col("_piece.i"))
    out = out.withColumn("pidx", F.when(F.col("piece") > 0, F.col("_before") + F.col("piece") - 1 + F.lit(top)).otherwise(F.col("pidx")).cast("long"))
    return out.select(*pipes.columns, "parent", "piece")


def apply_edits(pipes: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (ord, pidx, verb, x, y) in order: flip reverses, delete empties, extend moves the nearer end to (x, y).

    Later edits of a pipe see the earlier ones; of equally near ends the start moves.
    """
    per = edits.groupBy("pidx").agg(F.array_sort(F.collect_list(F.struct("ord", "verb", "x", "y"))).alias("_e"))
    near = "pow(element_at(c, 1).x - e.x, 2) + pow(element_at(c, 1).y - e.y, 2) <= pow(element_at(c, -1).x - e.x, 2) + pow(element_at(c, -1).y - e.y, 2)"
    p = "array(named_struct('x', e.x, 'y', e.y))"
    step = (
        "CASE WHEN size(c) = 0 THEN c WHEN e.verb = 'flip' THEN reverse(c) WHEN e.verb = 'delete' THEN slice(c, 1, 0)"
        f" WHEN e.verb = 'extend' AND {near} THEN concat({p}, slice(c, 2, size(c))) WHEN e.verb = 'extend' THEN concat(slice(c, 1, size(c) - 1), {p}) ELSE c END"
    )
    d = pipes.join(per, "pidx", "left")
    return d.withColumn("coords", F.expr(f"CASE WHEN _e IS NULL THEN coords ELSE aggregate(_e, coords, (c, e) -> {step}) END")).select(*pipes.columns)


def weld(endpoints: DataFrame, cuts: DataFrame, tol: float) -> DataFrame:
    """Endpoints within tol of a cut (ord, x, y) move onto it; of several the last in order wins."""
    from tributary.operators.spatial import within

    hit = within(endpoints, cuts, tol, "ep_idx", "ord", cell=4 * tol).groupBy("a_id").agg(F.max("b_id").alias("ord"))
    to = hit.join(cuts.select("ord", F.col("x").alias("cx"), F.col("y").alias("cy")), "ord").select(F.col("a_id").alias("ep_idx"), "cx", "cy")
    d = endpoints.join(to, "ep_idx", "left")
    return d.withColumns({"x": F.coalesce("cx", "x"), "y": F.coalesce("cy", "y")}).select(*endpoints.columns)
