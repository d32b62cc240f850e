"""Distance and overlap joins by grid cells: every join is an equi-join on a cell."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.session import discard, materialize


def _cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(size)))


def within(a: DataFrame, b: DataFrame, radius: float, a_id: str = "id", b_id: str = "id", a_xy: tuple[str, str] = ("x", "y"), b_xy: tuple[str, str] = ("x", "y"), cell: float | None = None) -> DataFrame:
    """(a_id, b_id, dist) of all pairs with distance <= radius; points without coordinates match nothing.

    b is copied to the nine cells around each of its points, a stays in its own. With
    a ``cell`` wider than the radius b is copied only to the cells that it reaches.
    """
    left = a.select(F.col(a_id).alias("a_id"), F.col(a_xy[0]).alias("ax"), F.col(a_xy[1]).alias("ay")).where("ax IS NOT NULL AND ay IS NOT NULL")
    right = b.select(F.col(b_id).alias("b_id"), F.col(b_xy[0]).alias("bx"), F.col(b_xy[1]).alias("by")).where("bx IS NOT NULL AND by IS NOT NULL")
    left = left.withColumns({"cx": _cell("ax", cell or radius), "cy": _cell("ay", cell or radius)})
    if cell:
        far = radius * (1 + 1e-9)  # a hair more, for rounding
        right = _explode_cells(right, F.col("bx") - far, F.col("by") - far, F.col("bx") + far, F.col("by") + far, cell)
    else:
        near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        right = right.withColumn("n", F.explode(near)).withColumns({"cx": _cell("bx", radius) + F.col("n.i"), "cy": _cell("by", radius) + F.col("n.j")}).drop("n")
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return left.join(right, ["cx", "cy"]).where(d2 <= radius * radius).select("a_id", "b_id", F.sqrt(d2).alias("dist"))


def self_pairs(points: DataFrame, radius: float, key: str = "id", above: float | None = None) -> DataFrame:
    """Pairs a_id < b_id within radius; with ``above`` only those further apart than it."""
    p = within(points, points, radius, key, key).where("a_id < b_id")
    return p if above is None else p.where(F.col("dist") > above)


def nearest(a: DataFrame, b: DataFrame, radius: float, a_id: str = "id", b_id: str = "id") -> DataFrame:
    """(a_id, b_id, dist): the nearest point of b within radius of each of a; ties go to the smallest b_id."""
    p = within(a, b, radius, a_id, b_id)
    best = F.min(F.struct("dist", "b_id")).alias("m")
    return p.groupBy("a_id").agg(best).select("a_id", F.col("m.b_id").alias("b_id"), F.col("m.dist").alias("dist"))


def close_pairs(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """Pairs (a_id, b_id) that link the same points together as all pairs within radius do: equal places are linked to their least key, and that one to other places."""
    place = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min(key).alias("rep"))
    apart = self_pairs(place, radius, "rep").select("a_id", "b_id")
    same = points.select(key, "x", "y").join(place, ["x", "y"]).where(F.col(key) != F.col("rep"))
    return apart.unionByName(same.select(F.col("rep").alias("a_id"), F.col(key).alias("b_id")))


def nearest_any(a: DataFrame, b: DataFrame, start: float, a_id: str = "id", b_id: str = "id") -> DataFrame:
    """(a_id, b_id, dist): the nearest point of b of each of a, however far; ties go to the smallest b_id.

    Rounds with growing radius settle the points that have one in reach. A round
    first bounds the distance by the cells of b, an eighth of the radius wide, and
    then measures the points of those cells only that may hold the nearest one.
    """
    pts = b.select(F.col(b_id).alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by")).where("bx IS NOT NULL AND by IS NOT NULL")
    left = materialize(a.select(F.col(a_id).alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay")).where("ax IS NOT NULL AND ay IS NOT NULL"), "left")
    kind = {f.name: f.dataType for f in left.schema} | {f.name: f.dataType for f in pts.schema}
    found = [left.sparkSession.createDataFrame([], f"a_id {kind['a_id'].simpleString()}, b_id {kind['b_id'].simpleString()}, dist double")]
    if pts.limit(1).count() == 0:
        return found[0]
    radius = float(start)
    while left.limit(1).count():
        size = radius / 8
        half = size * math.sqrt(0.5) * (1 + 1e-9)
        dealt = pts.withColumns({"cx": _cell("bx", size), "cy": _cell("by", size)})
        cells = dealt.select("cx", "cy").distinct().select(F.struct("cx", "cy").alias("cell"), ((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"))
        near = within(left.select("a_id", F.col("ax").alias("x"), F.col("ay").alias("y")), cells, radius + half, "a_id", "cell")
        least = near.groupBy("a_id").agg((F.min("dist") + half).alias("bound")).where(F.col("bound") <= radius)
        some = near.join(least, "a_id").where(F.col("dist") - half <= F.col("bound")).select("a_id", "b_id.cx", "b_id.cy")
        d = some.join(dealt, ["cx", "cy"]).join(left, "a_id")
        dist = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
        best = d.groupBy("a_id").agg(F.min(F.struct(dist.alias("dist"), "b_id")).alias("m")).select("a_id", "m.b_id", "m.dist")
        found.append(materialize(best, "nearest"))
        rest = materialize(left.join(found[-1], "a_id", "left_anti"), "left")
        discard(left)
        left = rest
        radius *= 4
    return reduce(DataFrame.unionByName, found)


def segment_projection(px: Column, py: Column, sx: Column, sy: Column, ex: Column, ey: Column) -> tuple[Column, Column]:
    """(distance to the segment, distance along it of the nearest point)."""
    dx, dy = ex - sx, ey - sy
    ll = dx * dx + dy * dy
    t = F.when(ll > 0, ((px - sx) * dx + (py - sy) * dy) / F.nullif(ll, F.lit(0.0))).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    # from the start, as the SQL of the queries has it: of lines through one point rounding decides
    gx, gy = (px - sx) - t * dx, (py - sy) - t * dy
    return F.sqrt(gx * gx + gy * gy), t * F.sqrt(ll)


def _explode_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    d = df.withColumn("cx", F.explode(F.sequence(_cell(x0, size), _cell(x1, size))))
    return d.withColumn("cy", F.explode(F.sequence(_cell(y0, size), _cell(y1, size))))


def points_near_segments(points: DataFrame, segments: DataFrame, radius: float, p_id: str = "id", s_id: str = "pidx", cell: float | None = None, p_more: tuple[str, ...] = (), s_more: tuple[str, ...] = ()) -> DataFrame:
    """(p_id, s_id, dist, along) of points within radius of segments (sx, sy, ex, ey), with the columns p_more of the points and s_more of the segments.

    A long segment has a row for each cell it runs through, so cells are some times the radius wide.
    """
    size = cell or max(radius * 12, 1.0)
    s = segments.select(F.col(s_id).alias("s_id"), "sx", "sy", "ex", "ey", *s_more)
    s = s.withColumn("cx", F.explode(F.sequence(_cell(F.least("sx", "ex") - radius, size), _cell(F.greatest("sx", "ex") + radius, size))))
    # in a column of cells only the heights that the segment has there
    run = F.nullif(F.col("ex") - F.col("sx"), F.lit(0.0))
    at = lambda x: F.when(run.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("sx")) / run)))
    y = lambda t, else_: F.coalesce(F.col("sy") + t * (F.col("ey") - F.col("sy")), F.col(else_))
    ya, yb = y(at(F.col("cx") * size - radius), "sy"), y(at((F.col("cx") + 1) * size + radius), "ey")
    # a hair more than the radius, for rounding
    s = s.withColumn("cy", F.explode(F.sequence(_cell(F.least(ya, yb) - radius * (1 + 1e-9), size), _cell(F.greatest(ya, yb) + radius * (1 + 1e-9), size))))
    # what depends on the segment alone comes before the join: the expressions after it stay small enough to be compiled
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    s = s.withColumns({"dx": dx, "dy": dy, "ll": F.nullif(dx * dx + dy * dy, F.lit(0.0)), "run": F.sqrt(dx * dx + dy * dy)})
    # no nearer to the line than to the segment; with more than rounding to spare
    s = s.withColumn("strip", radius * F.col("run") * (1 + 1e-6) + F.col("run") * F.col("run") * 1e-12)
    s = s.select("s_id", "cx", "cy", *dict.fromkeys(["sx", "sy", *s_more]), "dx", "dy", "ll", "run", "strip")
    p = points.select(F.col(p_id).alias("p_id"), F.col("x").alias("px"), F.col("y").alias("py"), *p_more).withColumns({"cx": _cell("px", size), "cy": _cell("py", size)})
    x, y = F.col("px") - F.col("sx"), F.col("py") - F.col("sy")
    near = p.join(s, ["cx", "cy"]).where(F.abs(x * F.col("dy") - y * F.col("dx")) <= F.col("strip"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((x * F.col("dx") + y * F.col("dy")) / F.col("ll"), F.lit(0.0))))
    # as in segment_projection()
    gx, gy = x - t * F.col("dx"), y - t * F.col("dy")
    return near.select("p_id", "s_id", F.sqrt(gx * gx + gy * gy).alias("dist"), (t * F.col("run")).alias("along"), *p_more, *s_more).where(F.col("dist") <= radius)


def box_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float, grow: float = 0.0) -> DataFrame:
    """(a_id, b_id, ow, oh) of boxes (x0, y0, x1, y1) that meet when a is grown by ``grow``.

    ow and oh are the overlap's width and height without growth (negative: a gap).
    A pair is reported only in the cell of its overlap's lower corner, so no
    distinct is needed.
    """
    x = a.select(F.col(a_id).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    y = b.select(F.col(b_id).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    x = _explode_cells(x, F.col("a_x0") - grow, F.col("a_y0") - grow, F.col("a_x1") + grow, F.col("a_y1") + grow, cell)
    y = _explode_cells(y, F.col("b_x0"), F.col("b_y0"), F.col("b_x1"), F.col("b_y1"), cell)
    j = x.join(y, ["cx", "cy"])
    own = (F.col("cx") == _cell(F.greatest(F.col("a_x0") - grow, F.col("b_x0")), cell)) & (F.col("cy") == _cell(F.greatest(F.col("a_y0") - grow, F.col("b_y0")), cell))
    ow = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    oh = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    return j.where(own).select("a_id", "b_id", ow.alias("ow"), oh.alias("oh")).where((F.col("ow") >= -grow) & (F.col("oh") >= -grow))


def segment_box_distance(sx: Column, sy: Column, ey: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a vertical segment (x = sx, from sy to ey) and a box; 0 if they meet."""
    gx = F.greatest(x0 - sx, sx - x1, F.lit(0.0))
    gy = F.greatest(y0 - F.greatest(sy, ey), F.least(sy, ey) - y1, F.lit(0.0))
    return F.sqrt(gx * gx + gy * gy)
