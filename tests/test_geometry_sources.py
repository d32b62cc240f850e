import sqlite3
import struct

import pytest

from tributary.functions import geo
from tributary.operators import edits, snap
from tributary.sources import census, config, decisions, gpkg


def pipes(spark, *lines):
    return spark.createDataFrame([(i, f"P{i}", [(float(x), float(y)) for x, y in c]) for i, c in enumerate(lines)], "pidx long, fid string, coords array<struct<x:double,y:double>>")


def coords(df):
    return {r.pidx: [(p.x, p.y) for p in r.coords] for r in df.collect()}


# fixed value: a published anchor of the projection
def test_projection_anchor(spark):
    x, y = geo.lcc("35.999688e0", "-78.903643e0")
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 2028502.464) < 0.01 and abs(r.y - 818798.599) < 0.01


def test_lines(spark):
    p = pipes(spark, [(0, 0), (3, 4), (3, 10)], [(1, 1)])
    assert [r[0] for r in p.select(geo.line_length("coords")).collect()] == [11.0, 0.0]
    ring = pipes(spark, [(0, 0), (2, 0), (2, 2), (0, 2)])
    assert ring.select(geo.ring_area("coords")).first()[0] == 4.0
    cx, cy = geo.line_centroid("coords")
    assert tuple(pipes(spark, [(0, 0), (10, 0)]).select(cx, cy).first()) == (5.0, 0.0)


def test_split_keeps_ids(spark):
    p = pipes(spark, [(0, 0), (100, 0)], [(0, 5), (10, 5)])
    cuts = spark.createDataFrame([(0, 50.0), (0, 51.0), (0, 80.0)], "pidx long, along double")
    assert coords(edits.split_pipes(p, cuts, 2.0)) == {0: [(0, 0), (50, 0)], 1: [(0, 5), (10, 5)], 2: [(50, 0), (80, 0)], 3: [(80, 0), (100, 0)]}


def test_edits_in_order(spark):
    p = pipes(spark, [(0, 0), (10, 0)], [(0, 5), (10, 5)], [(1, 1), (2, 2)])
    e = spark.createDataFrame([(0, 0, "flip", None, None), (1, 0, "extend", 12.0, 0.0), (2, 1, "delete", None, None)], "ord long, pidx long, verb string, x double, y double")
    assert coords(edits.apply_edits(p, e)) == {0: [(12, 0), (0, 0)], 1: [], 2: [(1, 1), (2, 2)]}


def test_manual_snap(spark):
    p = spark.createDataFrame([(0, "A", 0.0, 0.0, 10.0, 0.0), (1, "B", 14.0, 0.0, 30.0, 0.0)], "pidx long, fid string, sx double, sy double, ex double, ey double")
    ep = snap.endpoints(p)
    at = lambda m: {r.ep_idx: r.node_id for r in snap.snap_endpoints(ep, 1.0, 1.0, m).collect()}
    manual = lambda x: spark.createDataFrame([(x, 0.0, 5.0)], "x double, y double, radius double")
    assert at(manual(12.0)) == {0: 0, 1: 1, 2: 1, 3: 2}
    with pytest.raises(ValueError):
        at(manual(500.0))


def test_weld_last_cut_wins(spark):
    ep = spark.createDataFrame([(0, 1.0, 1.0), (1, 9.0, 9.0)], "ep_idx long, x double, y double")
    cuts = spark.createDataFrame([(0, 1.5, 1.0), (1, 1.0, 1.5)], "ord long, x double, y double")
    assert {r.ep_idx: (r.x, r.y) for r in edits.weld(ep, cuts, 1.0).collect()} == {0: (1.0, 1.5), 1: (9.0, 9.0)}


def test_decisions(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_bytes("flag_type,pipe_id,x,y,decision,radius_ft,target,comment\nsnap_gap,,1,2,snap,0,,caf\xe9\n,,,,,,,\n,P1,,,flip,,,\n".encode("cp1252"))
    d = decisions.read_decisions(spark, str(f))
    assert [r.decision for r in d.orderBy("ord").collect()] == ["snap", "flip"]
    assert tuple(decisions.manual_snaps(d).first()) == (1.0, 2.0, 5.0)
    with pytest.raises(ValueError, match="line 2"):
        decisions.parse_decisions("decision\nblow_up\n")


def test_census(spark):
    d = census.read_response(spark, '[["B","state","tract"],["12","37","000100"],["-666666666","37","000200"],["x","37","000300"]]', ("B",), ("state", "tract"), "GEOID")
    assert {r.GEOID: r.B for r in d.collect()} == {"37000100": 12.0, "37000200": None, "37000300": None}


def test_geopackage_round_trip(spark, tmp_path):
    wkb = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    rows = spark.createDataFrame([(1, "a", wkb), (2, None, None)], "id long, name string, geom binary")
    path = str(tmp_path / "x.gpkg")
    assert gpkg.write_layer(rows, path, "pts") == 2
    gpkg.write_layer(rows.where("id = 1"), path, "other")
    assert gpkg.layers(spark, path) == ["other", "pts"]
    got = {r.id: (r.name, r.geom and bytes(r.geom)) for r in gpkg.read_layer(spark, path, "pts").collect()}
    assert got == {1: ("a", wkb), 2: (None, None)}
    assert sqlite3.connect(path).execute("SELECT substr(geom, 1, 2) FROM pts WHERE id = 1").fetchone()[0] == b"GP"


def test_config_collects_errors(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("inputs: {manholes_shapefile: m.shp}\nparameters: {snap_ft: -1}\n")
    with pytest.raises(ValueError) as e:
        config.load_config(str(f))
    assert "gravity_main_shapefile" in str(e.value) and "crs" in str(e.value) and "snap_ft" in str(e.value)


