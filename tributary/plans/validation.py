"""Catchments scored against drawn ones: every method, selection radius and second parameter, and what is left of the best one's score on sites it wasn't chosen by."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import shapes
from tributary.operators import polygons, scoring
from tributary.session import materialize

#: Which second parameter a method has.
SECOND = {"concave": "ratio", "blocks_dissolve": None, "block_fill": "share", "delaunay": "edge", "morph_close": "close", "hybrid": "close"}


def sweep(units: DataFrame, traced: DataFrame, truth: DataFrame, methods: Iterable[str], radii: Iterable[float], grids: dict[str, tuple[float, ...]], blocks: DataFrame | None = None, cell: float = 500.0) -> DataFrame:
    """(site, method, sel_r, param2, iou) of all sites at once.

    units: (uid, geom); traced: pipes (site, pidx, geom); truth: (site, geom). grids
    gives a second parameter's values by its name; a method without one has NULL.
    Units are selected once for each radius and used by all methods; a site without
    units scores 0.
    """
    shapes.register(units.sparkSession)
    own = truth.select("site", "geom")
    out = []
    for radius in radii:
        served = polygons.served(units, traced, radius, cell).join(units.select("uid", "geom"), "uid").select("site", "geom")
        served = materialize(served, "served")
        for method in methods:
            name = SECOND[method]
            for value in grids.get(name, ()) if name else (None,):
                more = {name: value} if name else {}
                shape = polygons.boundary(served, method, blocks, **more)
                scored = polygons.iou(own, shape).select("site", F.lit(method).alias("method"), F.lit(float(radius)).alias("sel_r"), F.lit(value).cast("double").alias("param2"), "iou")
                out.append(materialize(scored, "scores"))
    return reduce(DataFrame.unionByName, out)


def leave_one_out(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folds, wins, summary) of sweep rows.

    folds: the best combination without each site, and the site's score with it; wins:
    how many sites each combination is best without; summary, one row: the best
    median over all sites, the median of the folds' scores, and their difference.
    """
    combo = ("method", "sel_r", "param2")
    # a missing second parameter is a group like any other
    filled = rows.withColumn("param2", F.coalesce("param2", F.lit(-1.0)))
    folds = materialize(scoring.leave_one_out(filled, combo), "folds")
    wins = folds.groupBy(*combo).agg(F.count(F.lit(1)).alias("wins"))
    best = scoring.summarize(filled, combo).agg(F.max(F.struct("median_iou", "n_ge")).alias("m")).select(F.col("m.median_iou").alias("in_sample"))
    held = folds.agg(F.median("iou").alias("held_out"), F.count(F.lit(1)).alias("folds"))
    both = best.join(F.broadcast(held))  # one row each
    blank = lambda d: d.withColumn("param2", F.nullif("param2", F.lit(-1.0)))
    return blank(folds), blank(wins), both.withColumn("optimism", F.col("in_sample") - F.col("held_out"))
