"""Larger tables and odd shapes: the ways that hold where rows meet in masses."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.functions import shapes
from tributary.operators import demographics as demo
from tributary.operators import graph, polygons, snap, spatial
from tributary.plans import delineate, network, network_qa


def test_sums_before_add_what_smaller_keys_have(spark):
    rows = [(k, k % 5 + 1) for k in random.Random(3).sample(range(10_000), 500)]
    want, total = {}, 0
    for k, n in sorted(rows):
        want[k], total = total, total + n
    assert {r.k: r.before for r in snap.sums_before(spark.createDataFrame(rows, "k long, n long"), "k", "n").collect()} == want


def test_a_line_with_thousands_of_ties_is_cut_in_order_of_arrival(spark):
    """Ends of 3,000 laterals on one line: merging them place by place, each against all places, took minutes."""
    rnd = random.Random(5)
    at = [rnd.uniform(20, 5980) for _ in range(3000)]
    lines = [(0, "MAIN", [(0.0, 0.0), (3000.0, 0.0), (6000.0, 0.0)])] + [(i + 1, f"L{i}", [(x, 50.0), (x, 0.5)]) for i, x in enumerate(at)]
    pipes = spark.createDataFrame(lines, "pidx long, fid string, coords array<struct<x:double,y:double>>")
    holes = spark.createDataFrame([], "fid string, x double, y double")
    want: list[float] = []
    for x in at:
        if not any(abs(p - x) < 2 for p in want):
            want.append(x)
    found = network.midspan_junctions(pipes, holes).where("pidx = 0").orderBy("along").collect()
    assert [r.along for r in found] == pytest.approx(sorted(want), abs=1e-6)
    assert [r.x for r in found] == pytest.approx([r.along for r in found]) and {r.trigger for r in found} == {"endpoint"}
    assert sum(r.sources.count("pipe ") for r in found) == 3000
    plan = network.midspan_junctions(pipes, holes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 4


def test_points_near_segments_keep_columns_and_lose_none(spark):
    rnd = random.Random(7)
    pts = [(i, rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for i in range(300)]
    segs = [(i, *(rnd.uniform(-60, 60) for _ in range(4)), f"s{i}") for i in range(40)] + [(90, 3.0, 3.0, 3.0, 3.0, "dot")]
    got = spatial.points_near_segments(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(segs, "pidx long, sx double, sy double, ex double, ey double, tag string"), 2.0, s_more=("tag",))
    want = {}
    for i, x, y in pts:
        for s, sx, sy, ex, ey, tag in segs:
            dx, dy = ex - sx, ey - sy
            t = max(0.0, min(1.0, ((x - sx) * dx + (y - sy) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            if (d := math.hypot(x - sx - t * dx, y - sy - t * dy)) <= 2:
                want[i, s, tag] = (pytest.approx(d), pytest.approx(t * math.hypot(dx, dy)))
    assert {(r.p_id, r.s_id, r.tag): (r.dist, r.along) for r in got.collect()} == want


def test_within_by_wider_cells_finds_the_same_pairs(spark):
    rnd = random.Random(9)
    pts = spark.createDataFrame([(i, float(rnd.randrange(-30, 30)), float(rnd.randrange(-30, 30))) for i in range(300)], "id long, x double, y double")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(spatial.within(pts, pts, 2.0, cell=8.0)) == rows(spatial.within(pts, pts, 2.0))


def test_weights_measure_equal_boxes_once(spark, monkeypatch):
    seen = []
    pairs = demo.box_pairs
    monkeypatch.setattr(demo, "box_pairs", lambda a, b, *rest: seen.append((a.count(), b.count())) or pairs(a, b, *rest))
    box = "x0 double, y0 double, x1 double, y1 double"
    units = spark.createDataFrame([(i, 0.0, 0.0, 10.0, 10.0) for i in range(60)] + [(99, 10.0, 0.0, 20.0, 10.0), (100, 40.0, 0.0, 50.0, 10.0)], f"uid long, {box}")
    parcels = spark.createDataFrame([(i, 0.0, 0.0, 4.0, 5.0) for i in range(30)] + [(50, 4.0, 0.0, 12.0, 5.0)], f"pid long, {box}")
    sites = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 10.0), (2, 5.0, 0.0, 45.0, 10.0)], f"sid long, {box}")
    got = {(r.sid, r.uid): r.weight for r in demo.dasymetric_weights(units, parcels, sites, "uid", "pid", "sid", 5.0).collect()}
    whole = 30 * 20 + 30
    assert got == {(1, u): pytest.approx(300 / whole) for u in range(60)} | {(2, u): pytest.approx(25 / whole) for u in range(60)} | {(2, 99): 1.0, (2, 100): 0.0}
    assert max(a * b for a, b in seen) <= 3 * 2


def test_units_of_one_shape_are_annotated_once(spark, monkeypatch):
    seen = []
    pairs = polygons.overlaps
    monkeypatch.setattr(polygons, "overlaps", lambda a, b, *rest, **more: seen.append(a.count()) or pairs(a, b, *rest, **more))
    shapes.register(spark)
    box = "x0 double, y0 double, x1 double, y1 double"
    units = spark.createDataFrame([(i, 0.0, 0.0, 50.0, 50.0) for i in range(40)] + [(77, 50.0, 0.0, 100.0, 50.0)], f"uid long, {box}").select("uid", shapes.box().alias("geom"))
    lines = spark.createDataFrame([(0, 20.0), (1, 90.0)], "pidx long, sx double").select("pidx", shapes.segment("sx", F.lit(-99.0), "sx", F.lit(99.0)).alias("geom"))
    trace = spark.createDataFrame([(5, 0)], "site long, pidx long")
    served = polygons.served(units, trace.join(lines, "pidx"), 30.0, 200.0)
    assert served.count() == 41
    s = delineate.Settings(selection_radius=30.0, border_ring=20.0, border_expose=0.3, cell=200.0)
    got = {r.uid: (r.cp_din, r.cp_cross, r.cp_flag, r.cp_pos) for r in delineate.annotate(units, lines, served, trace, lines.select("pidx").limit(0), s).collect()}
    assert got == {i: (0.0, False, "", "border") for i in range(40)} | {77: (30.0, True, "review", "border")}
    assert max(seen) == 2


def test_edits_by_place_meet_few_lines(spark, monkeypatch):
    """Two hundred lines lie within the tolerance of each edit: it is held against those about as near as the nearest."""
    widest = []
    near = network.points_near_segments
    monkeypatch.setattr(network, "points_near_segments", lambda points, segs, radius, *rest, **more: widest.append(radius) or near(points, segs, radius, *rest, **more))
    pipes = spark.createDataFrame([(i, f"P{i}", [(0.0, 3.0 * i), (500.0, 3.0 * i)]) for i in range(200)], "pidx long, fid string, coords array<struct<x:double,y:double>>")
    wanted = spark.createDataFrame([(i, "flip", None, 250.0, 3.0 * i + 1.5 - 0.5 * (i % 4), None) for i in range(20)], "ord long, decision string, pipe_id string, x double, y double, target string")
    holes = spark.createDataFrame([], "fid string, x double, y double")
    found = {r.ord: r.pidx for r in network.locate_edits(pipes, wanted, holes, 600.0).collect()}
    assert found == {i: i + 1 if i % 4 == 0 else i for i in range(20)}
    assert max(widest) <= 4


def test_a_large_strong_component_is_named_once(monkeypatch):
    """The least member of a component was sought again for each of its members."""
    seen = []
    monkeypatch.setattr(graph, "min", lambda *a: (seen.append(len(a[0]) if len(a) == 1 else 0), min(*a))[1], raising=False)
    n = 2000
    ring = pa.RecordBatch.from_arrays([pa.array(range(5, n + 5)), pa.array([*range(6, n + 5), 5])], ["u", "v"])
    (found,) = graph._scc_one_task(iter([ring]))
    assert sorted(zip(*(c.to_pylist() for c in found.columns))) == [(i, 5) for i in range(5, n + 5)]
    assert sum(seen) <= n


def test_only_ends_look_for_open_gaps(spark, monkeypatch):
    """Pairs of junctions, nearly all there are on a dense network, were made and then dropped."""
    seen = []
    near = network_qa.within
    monkeypatch.setattr(network_qa, "within", lambda a, b, *rest: seen.append(a.count()) or near(a, b, *rest))
    rnd = random.Random(11)
    rows = [(i, rnd.uniform(0, 60), rnd.uniform(0, 60), ("start", "end")[i % 2] if i % 20 < 2 else "junction") for i in range(400)]
    got = network_qa._open_pairs(spark.createDataFrame(rows, "node_id long, x double, y double, role string"), 20.0, 1.0)
    want = {}
    for a, ax, ay, ra in rows:
        for b, bx, by, rb in rows:
            if a < b and (ra != "junction" or rb != "junction") and 1 < (d := math.hypot(ax - bx, ay - by)) <= 20:
                want[a, b] = pytest.approx(d)
    found = [(r.a_id, r.b_id, r.dist) for r in got.collect()]
    assert len(found) == len(want) and {(a, b): d for a, b, d in found} == want
    assert seen == [40]


def test_the_checks_link_ends_at_one_place_once(spark, monkeypatch):
    """Two hundred pipes start at one place: the first pass of the gap checks paired all their ends."""
    from tributary.operators import components

    seen = []
    join = components.connected_components
    monkeypatch.setattr(snap, "connected_components", lambda edges, **more: seen.append(edges.count()) or join(edges, **more))
    rows = [(i, f"P{i}", "A", f"B{i}", 1.0, 5.0, 4.0, 0.0, 0.0, 100.0 * (i + 1), 50.0) for i in range(200)]
    pipes = spark.createDataFrame(rows, "pidx long, fid string, frommh string, tomh string, slope double, up_inv double, dn_inv double, sx double, sy double, ex double, ey double")
    holes = spark.createDataFrame([], "fid string, x double, y double")
    out = network_qa.run_qa(pipes, holes)
    assert out["flags"].count() == 0 and out["pipes"].where("qa_status = 'original'").count() == 200
    assert len(seen) == 3 and max(seen) == 199
