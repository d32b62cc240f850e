"""Geometry as column expressions: projection, polylines (arrays of struct<x,y>) and rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the working projection: GRS80, parallels 34 20 and 36 10, origin 33 45 N 79 W, false easting in metres, US survey foot.
A, INV_F = 6378137.0, 298.257222101
LAT1, LAT2, LAT0, LON0 = 34 + 20 / 60, 36 + 10 / 60, 33.75, -79.0
FALSE_EASTING_M, FOOT_M = 609601.22, 1200 / 3937

_E = math.sqrt(2 / INV_F - 1 / INV_F**2)


def _t(phi: float) -> float:
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


_P1, _P2, _P0 = (math.radians(x) for x in (LAT1, LAT2, LAT0))
_N = (math.log(_m(_P1)) - math.log(_m(_P2))) / (math.log(_t(_P1)) - math.log(_t(_P2)))
_F = _m(_P1) / (_N * _t(_P1) ** _N)
_RHO0 = A * _F * _t(_P0) ** _N
#: The projection's constants as the shape kernels take them.
CONIC = (A * _F, _N, _RHO0, _E, LON0, FALSE_EASTING_M, FOOT_M)


def lcc_sql(lat: str, lon: str) -> tuple[str, str]:
    """SQL text for x and y in feet of a latitude and longitude in degrees (Lambert conformal conic, two parallels)."""
    phi = f"radians({lat})"
    s = f"({_E!r}e0*sin({phi}))"
    t = f"(tan({math.pi / 4!r}e0-{phi}/2e0)/pow((1e0-{s})/(1e0+{s}),{_E / 2!r}e0))"
    rho = f"({A * _F!r}e0*pow({t},{_N!r}e0))"
    theta = f"({_N!r}e0*radians(({lon})-({LON0!r}e0)))"
    return f"(({FALSE_EASTING_M!r}e0+{rho}*sin({theta}))/{FOOT_M!r}e0)", f"(({_RHO0!r}e0-{rho}*cos({theta}))/{FOOT_M!r}e0)"


def lcc(lat: str, lon: str) -> tuple[Column, Column]:
    x, y = lcc_sql(lat, lon)
    return F.expr(x), F.expr(y)


def line_length(coords: str) -> Column:
    """Length of a polyline; 0 for fewer than two points, NULL for NULL."""
    return F.expr(
        f"aggregate(transform({coords}, (p, i) -> coalesce(sqrt(pow(p.x - get({coords}, i - 1).x, 2) + pow(p.y - get({coords}, i - 1).y, 2)), 0e0)), 0e0, (a, d) -> a + d)"
    )


def ring_area(coords: str) -> Column:
    """Area of a ring by the shoelace formula; the last point may repeat the first."""
    nxt = f"coalesce(get({coords}, i + 1), get({coords}, 0))"
    return F.expr(f"abs(aggregate(transform({coords}, (p, i) -> p.x * {nxt}.y - {nxt}.x * p.y), 0e0, (a, d) -> a + d)) / 2e0")


def line_centroid(coords: str) -> tuple[Column, Column]:
    """Length-weighted mean of the segments' midpoints."""

    def mean(axis: str) -> Column:
        d = f"coalesce(sqrt(pow(p.x - get({coords}, i - 1).x, 2) + pow(p.y - get({coords}, i - 1).y, 2)), 0e0)"
        mid = f"coalesce((p.{axis} + get({coords}, i - 1).{axis}) / 2e0, 0e0)"
        total = F.expr(f"aggregate(transform({coords}, (p, i) -> {d} * {mid}), 0e0, (a, z) -> a + z)")
        return total / F.nullif(line_length(coords), F.lit(0.0))

    return mean("x"), mean("y")


def substring(coords: str, start: str, end: str) -> Column:
    """The polyline from distance start to distance end along it (start < end)."""
    seg = f"sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))"
    cut = lambda at: f"named_struct('x', p.x + (q.x - p.x) * ({at} - d) / nullif({seg}, 0e0), 'y', p.y + (q.y - p.y) * ({at} - d) / nullif({seg}, 0e0))"
    # one state per segment: distance so far, previous point and the points gathered
    step = (
        f"CASE WHEN a.p IS NULL THEN named_struct('d', 0e0, 'p', q, 'out', CASE WHEN {start} <= 0 THEN array(q) ELSE a.out END) ELSE"
        f" named_struct('d', a.d + {seg.replace('p.', 'a.p.')}, 'p', q, 'out', concat(a.out,"
        f" CASE WHEN {start} > a.d AND {start} < a.d + {seg.replace('p.', 'a.p.')} THEN array({cut(start).replace('p.', 'a.p.').replace('- d', '- a.d')}) ELSE CAST(array() AS array<struct<x:double,y:double>>) END,"
        f" CASE WHEN {end} > a.d AND {end} < a.d + {seg.replace('p.', 'a.p.')} THEN array({cut(end).replace('p.', 'a.p.').replace('- d', '- a.d')})"
        f" WHEN a.d + {seg.replace('p.', 'a.p.')} >= {start} AND a.d + {seg.replace('p.', 'a.p.')} <= {end} THEN array(q) ELSE CAST(array() AS array<struct<x:double,y:double>>) END)) END"
    )
    zero = "named_struct('d', 0e0, 'p', CAST(NULL AS struct<x:double,y:double>), 'out', CAST(array() AS array<struct<x:double,y:double>>))"
    return F.expr(f"aggregate({coords}, {zero}, (a, q) -> {step}, a -> a.out)")
