"""Where points lie near lines, for masses of both: whole lines are dealt by place, each with the points about it.

A join of points and segments by cells has a row for each cell that a line runs
through, and what it finds must be dealt again by line. Here lines stay whole: they
are grouped by the middle of their bounds, a group gets the points of the cells its
lines run through, and what a line meets is found and used where it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a group, cells along each side of the extent, and what is measured at a time: row ranges, hits and buckets.
LINES, GRID = 8192, 128
RANGES, HITS, BUCKETS = 40_000, 1_000_000, 4_000_000

_COORDS = "array<struct<x:double,y:double>>"


def _cell(c: Column, low: float, size: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor((c - F.lit(low)) / F.lit(size)))).cast("int")


def deal(points: DataFrame, lines: DataFrame, radius: float) -> DataFrame | None:
    """Points (rank columns rule, n, t; x, y; others) and lines (pidx, coords; others), by group: its points in order of rank, then its lines.

    Columns: group, kind (0: point, 1: line), those of the points, those of the
    lines with pidx as n. None if there are no lines.
    """
    axis = lambda a, f: F.expr(f"{f}(transform(coords, p -> p.{a}))")
    d = lines.where("size(coords) > 1").withColumns({f"{a}{k}": axis(a, f) for a in "xy" for k, f in enumerate(("array_min", "array_max"))})
    low_x, high_x, low_y, high_y = d.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    if low_x is None:
        return None
    size = {"x": max((high_x - low_x) / GRID, 2.0 * radius), "y": max((high_y - low_y) / GRID, 2.0 * radius)}
    low = {"x": low_x, "y": low_y}
    cell = lambda c, a: _cell(c, low[a], size[a])
    d = d.withColumns({"gx": cell((F.col("x0") + F.col("x1")) / 2, "x"), "gy": cell((F.col("y0") + F.col("y1")) / 2, "y")}).drop("x0", "x1", "y0", "y1")
    # neighbouring cells make a group, as long as it has few lines; a cell of many lines makes several
    made, group, room = [], 0, LINES
    for gx, gy, n in sorted(map(tuple, d.groupBy("gx", "gy").count().collect())):
        if n > room and room < LINES:
            group, room = group + 1, LINES
        parts = -(-n // LINES)
        made.append((gx, gy, group, parts))
        group, room = (group + parts, LINES) if parts > 1 else (group, room - n)
    spark = lines.sparkSession
    of = F.broadcast(spark.createDataFrame(made, "gx int, gy int, first int, parts int"))
    d = d.join(of, ["gx", "gy"]).withColumn("group", F.col("first") + F.pmod(F.hash("pidx"), F.col("parts"))).drop("gx", "gy", "first", "parts")
    # the cells that a group's lines run through
    s = d.select("group", F.explode(F.expr("transform(sequence(0, size(coords) - 2), i -> named_struct('a', coords[i], 'b', coords[i + 1]))")).alias("s")).selectExpr("group", "s.a.x AS ax", "s.a.y AS ay", "s.b.x AS bx", "s.b.y AS by")
    far = radius * (1 + 1e-9) + 1e-6
    s = s.where("ax + ay + bx + by IS NOT NULL").withColumn("cx", F.explode(F.sequence(cell(F.least("ax", "bx") - far, "x"), cell(F.greatest("ax", "bx") + far, "x"))))
    run = F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    at = lambda c: F.when(run.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - F.col("ax")) / run)))
    edge = F.col("cx") * F.lit(size["x"]) + F.lit(low["x"])
    y = lambda c, else_: F.coalesce(F.col("ay") + at(c) * (F.col("by") - F.col("ay")), F.col(else_))
    # cells at the rim hold what lies beyond it, as far as a line reaches
    ya, yb = y(edge - far, "ay"), y(edge + F.lit(size["x"]) + far, "by")
    s = s.withColumn("cy", F.explode(F.sequence(cell(F.least(ya, yb) - far, "y"), cell(F.greatest(ya, yb) + far, "y")))).select("group", "cx", "cy").distinct()
    p = points.where("x IS NOT NULL AND y IS NOT NULL").withColumns({"cx": cell(F.col("x"), "x"), "cy": cell(F.col("y"), "y")}).join(s, ["cx", "cy"]).drop("cx", "cy")
    p = p.withColumn("kind", F.lit(0))
    both = p.unionByName(d.withColumnRenamed("pidx", "n").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("group").sortWithinPartitions("group", "kind", "rule", "n", "t")


class Places:
    """Points in rows of a height, each row in order of x."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float):
        self.x, self.y, self.radius, self.high = x, y, radius, 2.0 * radius
        self.x0, self.y0 = (x.min(), y.min()) if len(x) else (0.0, 0.0)
        self.width = (x.max() - self.x0 if len(x) else 0.0) + 1.0
        row = np.floor((y - self.y0) / self.high)
        self.rows = int(row.max()) + 1 if len(x) else 0
        key = row * self.width + (x - self.x0)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        # a hair more than the radius, for rounding
        self.far = radius * (1 + 1e-9) + 1e-6 + self.rows * self.width * 1e-14 * 1e3

    def near(self, sx: np.ndarray, sy: np.ndarray, ex: np.ndarray, ey: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(segment, point, dist, t) of points within the radius of segments, some segments at a time."""
        far, high = self.far, self.high
        lo = np.clip(np.floor((np.minimum(sy, ey) - far - self.y0) / high), 0, self.rows)
        hi = np.clip(np.floor((np.maximum(sy, ey) + far - self.y0) / high), -1, self.rows - 1)
        count = np.maximum(hi - lo + 1, 0)
        count[~np.isfinite(count)] = 0
        count = count.astype(np.int64)
        ends = np.cumsum(count)
        at = 0
        while at < len(sx):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RANGES)))
            yield self._some(np.arange(at, to), count[at:to], lo[at:to], sx, sy, ex, ey)
            at = to

    def _some(self, segs, count, lo, sx, sy, ex, ey):
        s = np.repeat(segs, count)
        row = np.repeat(lo, count) + (np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count))
        ax, ay, dx, dy = sx[s], sy[s], ex[s] - sx[s], ey[s] - sy[s]
        # the x that a segment has in the row
        level = dy == 0
        slope = dx / np.where(level, 1.0, dy)
        foot = self.y0 + row * self.high - self.far
        u, v = ax + (foot - ay) * slope, ax + (foot + self.high + 2 * self.far - ay) * slope
        bx = ax + dx
        left, right = np.minimum(ax, bx), np.maximum(ax, bx)
        a = np.where(level, left, np.clip(np.minimum(u, v), left, right)) - self.far - self.x0
        b = np.where(level, right, np.clip(np.maximum(u, v), left, right)) + self.far - self.x0
        base = row * self.width
        i = np.searchsorted(self.key, base + np.clip(a, 0.0, None))
        j = np.searchsorted(self.key, base + np.minimum(b, self.width - 0.5), "right")
        n = np.maximum(j - i, 0)
        n[(a > self.width - 0.5) | (b < 0)] = 0
        p = self.order[np.repeat(i - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        s = np.repeat(s, n)
        dx, dy = ex - sx, ey - sy
        ll = dx * dx + dy * dy
        x, y, dx, dy = self.x[p] - sx[s], self.y[p] - sy[s], dx[s], dy[s]
        some = np.abs(x * dy - y * dx) <= (self.radius * np.sqrt(ll) * (1 + 1e-6) + ll * 1e-12)[s]
        s, p, x, y, dx, dy = s[some], p[some], x[some], y[some], dx[some], dy[some]
        t = np.clip((x * dx + y * dy) / np.where(ll > 0, ll, 1.0)[s], 0.0, 1.0)
        x, y = x - t * dx, y - t * dy
        dist = np.sqrt(x * x + y * y)
        some = dist <= self.radius
        return s[some], p[some], dist[some], t[some]


class Lines:
    """Segments of a batch of lines."""

    def __init__(self, batch: pa.RecordBatch):
        coords = batch.column("coords")
        size = coords.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = coords.flatten()
        x, y = (pc.struct_field(flat, a).to_numpy(zero_copy_only=False).astype(np.float64) for a in "xy")
        last = np.cumsum(size) - 1
        first = last - size + 1
        head = np.ones(len(x), bool)
        head[last] = False
        v = np.nonzero(head)[0]
        self.n, self.batch = len(size), batch
        self.line = np.repeat(np.arange(self.n), size - 1)
        self.sx, self.sy, self.ex, self.ey = x[v], y[v], x[v + 1], y[v + 1]
        self.run = np.sqrt((self.ex - self.sx) * (self.ex - self.sx) + (self.ey - self.sy) * (self.ey - self.sy))
        self.base = np.zeros(len(v))
        self.at = np.cumsum(size - 1) - (size - 1)  # each line's first segment
        length = np.nan_to_num(self.run)
        for k in np.nonzero(size > 2)[0]:
            a, b = self.at[k], self.at[k] + size[k] - 1
            self.base[a + 1 : b] = np.cumsum(length[a : b - 1])
        tail = self.at + size - 2
        self.length = self.base[tail] + length[tail]
        self.x0, self.y0, self.x1, self.y1 = x[first], y[first], x[last], y[last]
        self.several = bool((size > 2).any())


def by_group(use: Callable[[pa.RecordBatch, Lines, Places], Iterator[pa.RecordBatch]], radius: float):
    """The kernel over dealt rows: ``use`` gets the points of a group, lines of it and the points by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, points, places = None, [], None, None
        for batch in batches:
            group, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "kind"))
            cut = np.nonzero((group[1:] != group[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
            for a, b in zip([0, *cut], [*cut, len(group)]):
                if a == b:
                    continue
                if group[a] != now:
                    now, parts, places = group[a], [], None
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    parts.append(rows.drop_columns(["coords"]))
                    continue
                if not parts:
                    continue
                if places is None:
                    points = pa.Table.from_batches(parts).combine_chunks()
                    places = Places(*(points.column(c).to_numpy().astype(np.float64) for c in "xy"), radius)
                yield from use(points, Lines(rows), places)

    return run


def pairs(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """(p_id, s_id, dist, along, len) of points (id, x, y) within radius of straight lines (pidx, sx, sy, ex, ey)."""
    at = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    lines = segments.select("pidx", F.array(at("sx", "sy"), at("ex", "ey")).alias("coords"))
    p = points.select(F.lit(0).alias("rule"), F.col("id").cast("long").alias("n"), F.lit("").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = "p_id long, s_id long, dist double, along double, len double"
    dealt = deal(p, lines, radius)
    if dealt is None:
        return points.sparkSession.createDataFrame([], schema)

    def use(points, lines, places):
        ids, pidx = points.column("n").to_numpy(), lines.batch.column("n").to_numpy()
        for s, p, dist, t in places.near(lines.sx, lines.sy, lines.ex, lines.ey):
            run = lines.run[s]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[p], pidx[s], dist, t * run, run)], ["p_id", "s_id", "dist", "along", "len"])

    return dealt.mapInArrow(by_group(use, radius), schema)


def _first_come(c: np.ndarray, start: np.ndarray, count: np.ndarray, b: np.ndarray, buckets: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances c of each line (from start on, in order of arrival) that become places: none before lies nearer than tol. By bucket: the distance and the arrival."""
    at, of = np.full(buckets, np.inf), np.full(buckets, len(c))
    around = np.arange(-2, 3)[:, None]
    longest = np.argsort(-count, kind="stable")
    start, count = start[longest], count[longest]
    j = 0
    # one arrival of every line at a time, as long as there are some lines
    for active in np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right"):
        if active < 8:
            break
        h = start[:active] + j
        new = h[np.abs(at[b[h] + around] - c[h]).min(axis=0) >= tol]
        at[b[new]], of[b[new]] = c[new], new
        j += 1
    for s, n in zip(start.tolist(), count.tolist()):
        if n <= j:
            break
        for h, k, x in zip(range(s + j, s + n), b[s + j : s + n].tolist(), c[s + j : s + n].tolist()):
            if not (np.abs(at[k - 2 : k + 3] - x) < tol).any():
                at[k], of[k] = x, h
    return at, of


def _cut_lines(lines: Lines, places: Places, tol: float, exclusion: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(line, point, segment, t, along, place, assigned) of some lines at a time: what ties in, by line and in order of arrival; the arrivals that make places, by distance; each arrival's place."""

    def merge(s, p, dist, t):
        line, along = lines.line[s], lines.base[s] + t * lines.run[s]
        key = line * np.int64(len(places.x)) + p
        o = np.lexsort((along, dist, key)) if lines.several else np.argsort(key)
        if lines.several:  # another segment of the line, further away
            o = o[np.concatenate([[True], key[o][1:] != key[o][:-1]])]
        s, p, t, line, along = s[o], p[o], t[o], line[o], along[o]
        start = np.nonzero(np.concatenate([[True], line[1:] != line[:-1]]))[0]
        count = np.diff(np.append(start, len(line)))
        # narrower than tol, so that no two places share a bucket
        width = tol * (1 - 1e-9)
        room = np.floor(lines.length[line[start]] / width).astype(np.int64) + 6
        b = np.repeat(np.cumsum(room) - room + 2, count) + np.floor(along / width).astype(np.int64)
        at, of = _first_come(along, start, count, b, int(room.sum()), tol)
        made = of[of < len(along)]
        number = np.empty(len(along) + 1, np.int64)
        number[made] = np.arange(len(made))
        assigned, around = np.empty(len(along), np.int64), np.arange(-2, 3)[:, None]
        for i in range(0, len(along), RANGES):
            k = b[i : i + RANGES] + around
            # the first such place to have been found
            assigned[i : i + RANGES] = number[np.where(np.abs(at[k] - along[i : i + RANGES]) < tol, of[k], len(along)).min(axis=0)]
        return line, p, s, t, along, made, assigned

    held: list[tuple] = []
    hits = 0
    for s, p, dist, t in places.near(lines.sx, lines.sy, lines.ex, lines.ey):
        k = lines.line[s]
        apart = lambda a, b: np.sqrt((places.x[p] - a[k]) * (places.x[p] - a[k]) + (places.y[p] - b[k]) * (places.y[p] - b[k])) > exclusion
        some = (dist < tol) & apart(lines.x0, lines.y0) & apart(lines.x1, lines.y1)
        if not some.any():
            continue
        held.append((s[some], p[some], dist[some], t[some]))
        hits += int(some.sum())
        if hits > HITS:
            rows = [np.concatenate(c) for c in zip(*held)]
            line = lines.line[rows[0]]
            done = line < line.max()  # the last line may go on
            if done.any():
                yield merge(*(c[done] for c in rows))
            held = [tuple(c[~done] for c in rows)]
            hits = int((~done).sum())
    if hits:
        yield merge(*(np.concatenate(c) for c in zip(*held)))


def cut_counts(dealt: DataFrame, tol: float, exclusion: float) -> DataFrame:
    """(pidx, n): how many places each line of dealt rows is to be cut at, where it is any."""

    def use(points, lines, places):
        pidx = lines.batch.column("n").to_numpy()
        for line, _, _, _, _, made, _ in _cut_lines(lines, places, tol, exclusion):
            k, n = np.unique(line[made], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pidx[k]), pa.array(n)], ["pidx", "n"])

    return dealt.mapInArrow(by_group(use, tol), "pidx long, n long")


def cuts(dealt: DataFrame, tol: float, exclusion: float) -> DataFrame:
    """(pidx, ord, along, x, y, ends, holes): the places that lines of dealt rows are to be cut at, numbered from the line's ``before`` on, with the arrivals of each rule that meet there.

    Points have the columns ends and holes: how many arrivals of each rule they are.
    """

    def use(points, lines, places):
        pidx, before = (lines.batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "before"))
        weight = [points.column(c).to_numpy().astype(np.float64) for c in ("ends", "holes")]
        for line, p, s, t, along, made, assigned in _cut_lines(lines, places, tol, exclusion):
            k, g, u = line[made], s[made], t[made]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            n = np.arange(len(k)) - np.nonzero(first)[0][np.cumsum(first) - 1]
            x, y = lines.sx[g] + u * (lines.ex[g] - lines.sx[g]), lines.sy[g] + u * (lines.ey[g] - lines.sy[g])
            ends, holes = (np.bincount(assigned, w[p], len(made)).astype(np.int64) for w in weight)
            for i in range(0, len(k), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in (pidx[k], before[k] + n, along[made], x, y, ends, holes)], ["pidx", "ord", "along", "x", "y", "ends", "holes"])

    return dealt.mapInArrow(by_group(use, tol), "pidx long, ord long, along double, x double, y double, ends long, holes long")


#: Cuts of a tile, about.
TILE_CUTS = 150_000


def _tile(x, y, low: tuple[float, float], size: float):
    """A tile's number; of columns or of arrays."""
    floor = F.floor if isinstance(x, Column) else lambda v: np.floor(v).astype(np.int64)
    a, b = floor((x - low[0]) / size), floor((y - low[1]) / size)
    return (a.cast("long") if isinstance(x, Column) else a) * (1 << 31) + b


def welded(dealt: DataFrame, ends: DataFrame, tol: float, exclusion: float, top: int, low: tuple[float, float], size: float) -> DataFrame:
    """(pidx, side, x, y) of both ends of each piece: ``ends`` (pidx, side, x, y) of the lines as drawn and those at the cuts of dealt rows, moved onto the last cut within tol.

    A cut ends one piece and starts the next, whose pidx is ``top`` and the cut's
    number. Cuts go to the tiles that they reach, in runs along a segment: the
    segment and how far along it each cut lies.
    """
    far = tol * (1 + 1e-9) + 1e-6

    def deal_cuts(points, lines, places):
        pidx, before = (lines.batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "before"))
        for line, _, s, t, _, made, _ in _cut_lines(lines, places, tol, exclusion):
            k, g, u = line[made], s[made], t[made]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            n = before[k] + np.arange(len(k)) - np.nonzero(first)[0][np.cumsum(first) - 1]
            x, y = lines.sx[g] + u * (lines.ex[g] - lines.sx[g]), lines.sy[g] + u * (lines.ey[g] - lines.sy[g])
            corner = np.sort(np.stack([_tile(x + i * far, y + j * far, low, size) for i in (-1, 1) for j in (-1, 1)]), axis=0)
            new = np.concatenate([np.ones((1, len(x)), bool), corner[1:] != corner[:-1]])
            tile, cut = corner[new], np.broadcast_to(np.arange(len(x)), corner.shape)[new]
            o = np.lexsort((cut, tile, g[cut]))
            tile, cut = tile[o], cut[o]
            begin = np.nonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (cut[1:] != cut[:-1] + 1) | (g[cut[1:]] != g[cut[:-1]])]))[0]
            head, upto = cut[begin], np.append(begin, len(cut))
            h, seg = k[head], g[head]
            for i in range(0, len(begin), 5000):
                to = min(i + 5000, len(begin))
                part = slice(i, to)
                lists = pa.ListArray.from_arrays(pa.array((upto[i : to + 1] - upto[i]).astype(np.int32)), pa.array(u[cut[upto[i] : upto[to]]]))
                one = [pa.array(c) for c in (tile[begin[part]], pidx[h[part]], before[h[part]], n[head[part]], lines.sx[seg[part]], lines.sy[seg[part]], lines.ex[seg[part]], lines.ey[seg[part]])]
                yield pa.RecordBatch.from_arrays([*one, lists], ["tile", "pidx", "before", "ord", "x", "y", "ex", "ey", "t"])

    runs = dealt.mapInArrow(by_group(deal_cuts, tol), "tile long, pidx long, before long, ord long, x double, y double, ex double, ey double, t array<double>")
    e = ends.select(F.coalesce(_tile(F.col("x"), F.col("y"), low, size), F.lit(0)).alias("tile"), "pidx", F.col("side").cast("long").alias("before"), "x", "y")
    both = runs.unionByName(e, allowMissingColumns=True).repartition("tile").sortWithinPartitions("tile")

    def weld(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        tile = rows.column("tile")[0].as_py()
        is_run = pc.is_valid(rows.column("t"))
        r, e = rows.filter(is_run), rows.filter(pc.invert(is_run))
        take = lambda d, *names: (d.column(c).to_numpy() for c in names)
        size_ = pc.list_value_length(r.column("t")).to_numpy().astype(np.int64)
        t = pc.list_flatten(r.column("t")).to_numpy()
        of = np.repeat(np.arange(len(size_)), size_)
        pidx, before, ord_, sx, sy, ex, ey = take(r, "pidx", "before", "ord", "x", "y", "ex", "ey")
        cut = ord_[of] + np.arange(len(of)) - np.repeat(np.cumsum(size_) - size_, size_)
        x, y = sx[of] + t * (ex - sx)[of], sy[of] + t * (ey - sy)[of]
        back = np.argsort(-cut)  # the last cut first
        x, y, cut, of = x[back], y[back], cut[back], of[back]
        own = np.nonzero(_tile(x, y, low, size) == tile)[0]
        line, side, qx, qy = take(e, "pidx", "before", "x", "y")
        ax, ay = np.concatenate([x[own], qx.astype(np.float64)]), np.concatenate([y[own], qy.astype(np.float64)])
        to = np.full(len(ax), -1)
        if len(x):
            # each cell, as wide as the tolerance, has the cuts around it, the last one first
            x0, y0 = x.min() - far, y.min() - far
            cx, cy = np.floor((x - x0) / far).astype(np.int64), np.floor((y - y0) / far).astype(np.int64)
            wide = int(cy.max()) + 3
            cells = (int(cx.max()) + 3) * wide
            cell = np.concatenate([(cx + i) * wide + cy + j for i in (0, 1, 2) for j in (0, 1, 2)])
            which = np.tile(np.arange(len(x)), 9)
            o = np.lexsort((which, cell))
            which, begin = which[o], np.searchsorted(cell[o], np.arange(cells + 1))
            a, b = np.floor((ax - x0) / far) + 1, np.floor((ay - y0) / far) + 1
            left = np.nonzero((a >= 0) & (b >= 0) & (a < cells // wide) & (b < wide))[0]
            place = (a[left] * wide + b[left]).astype(np.int64)
            k, end = begin[place], begin[place + 1]
            while len(left):
                some = k < end
                left, k, end = left[some], k[some], end[some]
                c = which[k]
                dx, dy = ax[left] - x[c], ay[left] - y[c]
                hit = dx * dx + dy * dy <= tol * tol
                to[left[hit]] = c[hit]
                left, k, end = left[~hit], k[~hit] + 1, end[~hit]
        moved = to >= 0
        ax[moved], ay[moved] = x[to[moved]], y[to[moved]]
        n, c = len(own), cut[own]
        piece = np.where(c == before[of[own]], pidx[of[own]], top + c - 1)
        for ids, s, i in ((piece, np.ones(n, np.int64), slice(0, n)), (top + c, np.zeros(n, np.int64), slice(0, n)), (line, side, slice(n, None))):
            u, v = ax[i], ay[i]
            for j in range(0, len(ids), 50_000):
                p = slice(j, j + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(s[p]), pa.array(u[p], from_pandas=True), pa.array(v[p], from_pandas=True)], ["pidx", "side", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            tile = batch.column("tile").to_numpy()
            cut = np.nonzero(tile[1:] != tile[:-1])[0] + 1
            for a, b in zip([0, *cut], [*cut, len(tile)]):
                if a < b:
                    if parts and parts[0].column("tile")[0].as_py() != tile[a]:
                        yield from weld(parts)
                        parts = []
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield from weld(parts)

    return both.mapInArrow(run, "pidx long, side long, x double, y double")
