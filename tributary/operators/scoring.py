"""Validation scores: intersection over union, sweeps and leave-one-out."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tributary.operators.spatial import box_pairs


def iou_boxes(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float) -> DataFrame:
    """(a_id, b_id, iou) of boxes that overlap."""
    area = lambda df, key: df.select(F.col(key), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    p = box_pairs(a, b, a_id, b_id, cell).where("ow > 0 AND oh > 0").withColumn("inter", F.col("ow") * F.col("oh"))
    p = p.join(area(a, a_id).toDF("a_id", "aa"), "a_id").join(area(b, b_id).toDF("b_id", "ba"), "b_id")
    return p.select("a_id", "b_id", (F.col("inter") / (F.col("aa") + F.col("ba") - F.col("inter"))).alias("iou"))


def summarize(sweep: DataFrame, combo: tuple[str, ...]) -> DataFrame:
    """Median, mean, sites at 0.5 or more, and sites, of each combination."""
    return sweep.groupBy(*combo).agg(
        F.median("iou").alias("median_iou"), F.avg("iou").alias("mean_iou"), F.count_if(F.col("iou") >= 0.5).alias("n_ge"), F.count(F.lit(1)).alias("n")
    )


def leave_one_out(sweep: DataFrame, combo: tuple[str, ...], site: str = "site") -> DataFrame:
    """(held, combo..., iou): the best combination on the other sites, and the held site's score with it.

    Best is by median, then sites at 0.5 or more, then combination order. A grid
    that lacks a combination for a site raises. The median without one score
    follows from the score's rank among all, so no site is joined with the others.
    """
    full = sweep.agg(F.count_distinct(site).alias("s"), F.count_distinct(*combo).alias("c"), F.count(F.lit(1)).alias("n")).first()
    if full.s * full.c != full.n:
        raise ValueError(f"incomplete grid: {full.n} rows for {full.s} sites and {full.c} combinations")
    n = full.s
    rank = F.row_number().over(W.Window.partitionBy(*combo).orderBy("iou", site))
    ranked = sweep.select(F.col(site).alias("held"), *combo, "iou", rank.alias("rank"))
    # without one of n scores the middle ones have these ranks, one higher from the left-out one on
    low, high = n // 2, (n + 1) // 2
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("iou")))
    middle = ranked.groupBy(*[F.col(c).alias(f"m_{c}") for c in combo]).agg(*[at(k).alias(f"v{k}") for k in sorted({low, low + 1, high, high + 1})], F.count_if(F.col("iou") >= 0.5).alias("ge"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in combo])
    d = ranked.join(middle, same)
    pick = lambda k: F.when(F.col("rank") <= k, F.col(f"v{k + 1}")).otherwise(F.col(f"v{k}"))
    d = d.withColumns({"m": (pick(low) + pick(high)) / 2, "g": F.col("ge") - F.when(F.col("iou") >= 0.5, 1).otherwise(0)})
    best = F.min_by(F.struct(*combo, "iou"), F.struct(-F.col("m"), -F.col("g"), *combo)).alias("best")
    return d.groupBy("held").agg(best).select("held", "best.*")


def capture(reached: DataFrame) -> DataFrame:
    """(site, n, share, dominant, dominant_share) of reached points (site, expected, basin)."""
    per = reached.groupBy("site", "basin").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("expected") == F.col("basin")).alias("hit"))
    d = per.groupBy("site").agg(F.sum("k").alias("n"), F.sum("hit").alias("h"), F.min(F.struct((-F.col("k")).alias("k"), F.col("basin").alias("b"))).alias("top"))
    return d.select("site", "n", (F.col("h") / F.col("n")).alias("share"), F.col("top.b").alias("dominant"), (-F.col("top.k") / F.col("n")).alias("dominant_share"))
