"""Reviewers' decisions applied to flags: by exact key, else nearest first with each decision used once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.components import connected_components
from tributary.operators.graph import SMALL_EDGES
from tributary.operators.spatial import within


def apply_review(flags: DataFrame, decisions: DataFrame, radius: float) -> DataFrame:
    """flags (flag_id, flag_type, pipe_id, x, y) with status and decision_ord.

    A decision (ord, flag_type, pipe_id, x, y, decision) matches flags of its type
    and pipe exactly; the last in order wins. Flags left take, in order of
    flag_id, the nearest unused decision without a pipe within radius; decisions
    or flags without coordinates take no part in that. Flags and decisions that
    share none are settled apart.
    """
    d = decisions.where("decision IN ('resolved', 'keep', 'dismiss')")
    exact = d.where("pipe_id IS NOT NULL").groupBy("flag_type", "pipe_id").agg(F.max("ord").alias("decision_ord"))
    tagged = flags.join(exact, ["flag_type", "pipe_id"], "left")
    points = d.where("pipe_id IS NULL AND x IS NOT NULL AND y IS NOT NULL").select("flag_type", "ord", "x", "y")
    loose = tagged.where("decision_ord IS NULL AND x IS NOT NULL AND y IS NOT NULL").select("flag_type", "flag_id", "x", "y")
    near = within(loose, points, radius, "flag_id", "ord").withColumnsRenamed({"a_id": "flag_id", "b_id": "ord"})
    near = near.join(loose.select("flag_id", "flag_type"), "flag_id").join(points.select("ord", "flag_type"), ["ord", "flag_type"])
    # flags are even, decisions odd
    group = connected_components(near.select((F.col("flag_id") * 2).alias("u"), (F.col("ord") * 2 + 1).alias("v")), small_edges=SMALL_EDGES).toDF("u", "g")
    near = near.withColumn("u", F.col("flag_id") * 2).join(group, "u").select("g", "flag_id", "ord", "dist")

    def greedy(pairs: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for flag, own in pairs.sort_values(["flag_id", "dist", "ord"]).groupby("flag_id", sort=True):
            for o in own["ord"]:
                if o not in used:
                    used.add(o)
                    out.append((flag, o))
                    break
        return pd.DataFrame(out, columns=["flag_id", "near_ord"])

    loose = near.groupBy("g").applyInPandas(greedy, "flag_id long, near_ord long")
    out = tagged.join(loose, "flag_id", "left").withColumn("decision_ord", F.coalesce("decision_ord", "near_ord")).drop("near_ord")
    named = out.join(decisions.select(F.col("ord").alias("decision_ord"), "decision"), "decision_ord", "left")
    return named.withColumn("status", F.coalesce("decision", F.lit("open"))).select(*flags.columns, "status", "decision_ord")
