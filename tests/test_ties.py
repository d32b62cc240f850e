"""Lines near a point: rounding as in SQL, and ties found line by line."""

import math
import random

import pytest

from tributary.plans import network

LINES = "pidx long, fid string, coords array<struct<x:double,y:double>>"


@pytest.mark.parametrize("named", [False, True])
def test_of_lines_through_an_edit_the_one_that_sql_finds_nearest(spark, named):
    """Distances of about 1e-14 decide; measured from the line's nearest place instead of its start, the other line was found."""
    # x of the edit, y, both lines' starts and ends, the line that (x-sx-t*(ex-sx)) makes the nearest
    cases = [
        (200.55 / 5.5, 27.0, (31.93, 117.21), (31.3, 118.26), 0), (191.75 / 5.5, 75.0, (27.26, 135.1), (19.9, 94.18), 0), (669.29 / 5.5, 40.0, (12.18, 237.96), (4.82, 123.56), 0),
        (746.61 / 5.5, 51.0, (9.82, 226.28), (9.63, 148.09), 1), (198.6 / 5.5, 77.0, (34.67, 186.85), (6.37, 102.24), 0), (884.95 / 5.5, 32.0, (101.12, 198.12), (146.88, 294.36), 0),
    ]
    pipes = spark.createDataFrame([(2 * i + k, f"P{i}", [(c[2 + k][0], c[1]), (c[2 + k][1], c[1])]) for i, c in enumerate(cases) for k in (0, 1)], LINES)
    wanted = spark.createDataFrame([(i, "flip", f"P{i}" if named else None, c[0], c[1], None) for i, c in enumerate(cases)], "ord long, decision string, pipe_id string, x double, y double, target string")
    holes = spark.createDataFrame([], "fid string, x double, y double")
    found = {r.ord: r.pidx for r in network.locate_edits(pipes, wanted, holes, 600.0).collect()}
    assert found == {i: 2 * i + c[4] for i, c in enumerate(cases)}


def test_lines_are_dealt_whole_and_no_near_point_is_lost(spark, monkeypatch):
    """A line had a row for each cell it runs through, and what it met was joined and tested pair by pair: 536 million pairs at 1 GB weren't found in time."""
    from tributary import catalog
    from tributary.operators import spatial, ties

    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-900, 900), rnd.uniform(-900, 900)) for i in range(3000)] + [(5000, 7.0, 7.0), (5001, 7.0, 9.0), (5002, None, 1.0)]
    segs = [(i, *(rnd.uniform(-800, 800) for _ in range(4))) for i in range(60)] + [(90, 7.0, 7.0, 7.0, 7.0), (91, -950.0, 3.0, 950.0, 3.0), (92, 4.0, 950.0, 4.0, -950.0)]
    p, s = spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(segs, "pidx long, sx double, sy double, ex double, ey double")
    want = {}
    for i, x, y in pts:
        for k, sx, sy, ex, ey in segs if x is not None else ():
            dx, dy = ex - sx, ey - sy
            t = max(0.0, min(1.0, ((x - sx) * dx + (y - sy) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            if (d := math.hypot(x - sx - t * dx, y - sy - t * dy)) <= 2:
                want[i, k] = (pytest.approx(d), pytest.approx(t * math.hypot(dx, dy)), pytest.approx(math.hypot(dx, dy)))
    monkeypatch.setattr(ties, "LINES", 7)
    monkeypatch.setattr(ties, "RANGES", 50)
    got = ties.pairs(p, s, 2.0).collect()
    assert len(got) == len(want) and {(r.p_id, r.s_id): (r.dist, r.along, r.len) for r in got} == want
    monkeypatch.setattr(spatial, "points_near_segments", lambda *a, **b: pytest.fail("pairs by cells"))
    assert catalog.QUERIES["midspan_candidates"](spark, "/root/testdata/sf0.001").count() >= 0
    assert ties.pairs(p, s.limit(0), 2.0).count() == 0 and ties.pairs(p.limit(0), s, 2.0).count() == 0


def test_cuts_are_counted_and_numbered_without_storing_what_ties_in(spark, monkeypatch):
    """Each tie was dealt by line with its place and the name of its source: more than 4.3 GB at 1 GB."""
    from tributary import catalog
    from tributary.operators import ties

    rnd = random.Random(8)
    rows = [(3 * i, f"P{i}", [(rnd.uniform(0, 300), float(rnd.randrange(100))) for _ in range(2 + i % 3 % 2)]) for i in range(150)]
    rows += [(1000, "M", [(0.0, 50.0), (150.0, 50.0), (300.0, 50.0)])] + [(2000 + i, f"L{i}", [(x, 90.0), (x, 50.5)]) for i, x in enumerate(rnd.uniform(15, 285) for _ in range(300))]
    pipes = spark.createDataFrame(rows + [(9000, "dot", [(1.0, 1.0)])], LINES)
    holes = spark.createDataFrame([(i, f"H{i}", rnd.uniform(0, 300), float(rnd.randrange(100))) for i in range(80)] + [(80, "H", None, 1.0)], "ord long, fid string, x double, y double")
    want = [(r.ord, r.pidx, r.along, r.x, r.y, r.trigger, len(r.sources.split("; ")), r.new_pidx) for r in network.split_log(pipes, holes).orderBy("ord").collect()]
    for name, n in (("LINES", 40), ("RANGES", 60), ("HITS", 100)):
        monkeypatch.setattr(ties, name, n)
    near = lambda r: [*r[:2], *(pytest.approx(v, abs=1e-7) for v in r[2:5]), *r[5:]]
    assert len(want) > 500 and [list(r) for r in network.split_places(pipes, holes).orderBy("ord").collect()] == [near(r) for r in want]
    assert network.split_places(pipes.limit(0), holes).count() == 0
    monkeypatch.setattr(network, "_junctions", lambda *a: pytest.fail("ties dealt by line"))
    assert catalog.QUERIES["midspan_splits"](spark, "/root/testdata/sf0.001").count() >= 0


def test_ends_are_welded_tile_by_tile_without_storing_pieces(spark, monkeypatch):
    """Cuts and pieces were stored, and each end met every cut within the tolerance: more than 4.3 GB at 1 GB."""
    from tributary import catalog
    from tributary.operators import snap, ties

    rnd = random.Random(12)
    rows = [(3 * i, f"P{i}", [(rnd.uniform(0, 200), float(rnd.randrange(80))) for _ in range(2 + i % 3 % 2)]) for i in range(120)] + [(9000, "dot", [(1.0, 1.0)]), (9001, "far", [(5000.0, 5.0), (5000.0, 900.0)])]
    pipes = spark.createDataFrame(rows, LINES)
    holes = spark.createDataFrame([(i, f"H{i}", rnd.uniform(0, 200), float(rnd.randrange(80))) for i in range(60)], "ord long, fid string, x double, y double")
    ends = snap.endpoints(network.line_ends(network.split_midspan(pipes, holes)[0]))
    want = {(r.pidx, 0 if r.is_start else 1): (pytest.approx(r.x, abs=1e-7), pytest.approx(r.y, abs=1e-7)) for r in ends.collect()}
    for name, n in (("LINES", 30), ("HITS", 100), ("TILE_CUTS", 5)):
        monkeypatch.setattr(ties, name, n)
    got = network.welded_ends(pipes, holes).collect()
    assert len(got) == len(want) > 1000 and {(r.pidx, r.side): (r.x, r.y) for r in got} == want
    assert network.welded_ends(pipes.limit(0), holes).count() == 0 and network.welded_ends(pipes.where("pidx = 9001"), holes).count() == 2
    monkeypatch.setattr(network, "split_midspan", lambda *a: pytest.fail("pieces stored"))
    assert catalog.QUERIES["welded_ends"](spark, "/root/testdata/sf0.001").count() > 0
