import pytest

from tributary.operators import facilities, pressure
from tributary.plans import force_mains
from tributary.sources import mains as src

MAIN = "pidx long, fid string, diameter double, sx double, sy double, ex double, ey double"


def mains(spark, *rows):
    d = spark.createDataFrame([(i, f"F{i}", 12.0 if len(r) < 5 else r[4], *map(float, r[:4])) for i, r in enumerate(rows)], MAIN)
    return d.selectExpr("*", "sqrt(pow(ex - sx, 2) + pow(ey - sy, 2)) AS length_ft")


def gravity(spark, places, links):
    nodes = spark.createDataFrame([(i, float(x), float(y), "junction") for i, x, y in places], "node_id long, x double, y double, role string")
    return nodes, spark.createDataFrame([(u, v, k) for k, (u, v) in enumerate(links)], "u long, v long, pidx long")


def test_clusters_and_joins_in_order(spark):
    m = mains(spark, (0, 0, 100, 0), (103, 0, 200, 0), (206, 0, 300, 0), (300.5, 0, 400, 0), (0, 900, 50, 900), (50, 900, 0, 900))
    tagged, clusters = pressure.topology(m, 1.0)
    assert {r.pidx: (r.a, r.b, r.comp) for r in tagged.collect()} == {0: (0, 1, 0), 1: (2, 3, 2), 2: (4, 5, 4), 3: (5, 7, 4), 4: (8, 9, 8), 5: (9, 8, 8)}
    assert {r.node: r.n_nbr for r in clusters.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 7: 1, 8: 1, 9: 1}
    joins = lambda *j: spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(j)], "ord long, x double, y double, radius double")
    tagged, clusters = pressure.topology(m, 1.0, joins((101, 0, 3), (203, 0, 4)))
    assert {r.pidx: r.comp for r in tagged.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 8, 5: 8}
    assert {r.node: (r.x, r.n_nbr) for r in clusters.collect()}[1] == (100.0, 2)
    with pytest.raises(ValueError, match="join 1 reaches 1"):  # the first join has merged what the second finds
        pressure.topology(m, 1.0, joins((101, 0, 3), (102, 0, 4)))
    with pytest.raises(ValueError, match="join 0 reaches 0"):
        pressure.topology(m, 1.0, joins((5000, 0, 3)))


def test_from_mains_to_links_and_questions(spark):
    # 0: pumped from a sink to a passing node; 1: two ends that pass on; 2: far from all; 3: a ring; 4: a stub; 5: both ends at one node
    m = mains(spark, (0, 0, 500, 0), (0, 2000, 500, 2000), (0, 9000, 500, 9000), (0, 4000, 90, 4000), (90, 4000, 90, 4090), (90, 4090, 0, 4000), (700, 700, 704, 700, 2.0), (500, 6000, 500, 6001.5))
    places = [(1, 0, 5), (2, -100, 5), (3, 500.05, 0), (4, 600, 0), (5, 0, 2000), (6, 500, 2003), (7, 900, 2000), (8, 500, 6000.5)]
    nodes, edges = gravity(spark, places, [(2, 1), (3, 4), (5, 7), (6, 7), (4, 8)])
    prior = spark.createDataFrame([(0.4, 2000.0, "left as it is"), (0.0, 9000.0, None)], "fm_x double, fm_y double, note string").where("note IS NOT NULL")
    out = force_mains.review(m, nodes, edges, prior=prior)
    assert {r.fid: r.pidx for r in out["mains"].collect()} == {"F0": 0, "F1": 1, "F2": 2, "F3": 3, "F4": 4, "F5": 5, "F7": 6}
    verdict = {r.comp: (r.verdict, r.n_termini, r.n_pipes, r.n_cycles) for r in out["verdicts"].collect()}
    assert verdict == {0: ("resolved", 2, 1, 0), 2: ("multi_discharge", 2, 1, 0), 4: ("isolated", 2, 1, 0), 6: ("isolated", 0, 3, 1), 12: ("no_discharge", 2, 1, 0)}
    links = out["links"].collect()
    assert [(r.comp, r.wetwell_pipe, r.discharge_pipe, r.wetwell_x, r.discharge_x) for r in links] == [(0, "FM:F0", "FM:F0", 0.0, 500.05)]
    assert {r.comp for r in out["skipped"].collect()} == {2, 4, 6, 12} and all(r.reason for r in out["skipped"].collect())
    open_ = out["open"].orderBy("ord").collect()
    assert [r.flag_type for r in open_] == ["fm_junction_candidate"] + ["fm_direction_ambiguous"] * 4 + ["fm_no_gravity_contact"] * 2
    assert [(r.dist_ft, r.radius_ft) for r in open_][0] == (5.0, 3.12) and open_[-1].radius_ft is None
    ring = [r for r in open_ if r.classification == "ring"]
    assert len(ring) == 1 and ring[0].pipe_id == "FM:F3" and ring[0].x is None and "3 mains" in ring[0].comment
    assert {(r.settled_as, r.settled_why, r.pipe_id) for r in out["settled"].collect()} == {("auto_accepted", "gap of at most 0.1 ft", "FM:F0"), ("already_decided", "left as it is", "FM:F1")}
    wired = facilities.wire(edges, force_mains.to_wire(out["links"]), nodes)
    assert {(r.u, r.v) for r in wired.where("pidx IS NULL").collect()} == {(1, 3)}
    miles = {r.verdict: (r.n, round(r.miles, 4), r.settled) for r in pressure.mileage(out["verdicts"]).collect()}
    assert miles["resolved"] == (1, round(500 / 5280, 4), True) and miles["isolated"][0] == 2
    assert [r.comp for r in pressure.longest_open(out["verdicts"], 2).collect()] == [2, 4]
    assert pressure.wired_miles(out["links"]).first().comps == 1


def test_plants_stations_and_rulings_speak_in_turn(spark):
    m = mains(spark, (0, 0, 500, 0), (0, 3000, 500, 3000))
    nodes, edges = gravity(spark, [(1, 0, 0), (2, 900, 0), (3, 500, 3), (4, 0, 3000), (5, 500, 3000), (6, 900, 3000)], [(1, 2), (3, 2), (4, 6), (5, 6)])
    fac = spark.createDataFrame([(0, "P", "plant", 520.0, 0.0), (1, "S", "station", 0.0, 3050.0)], "fac long, name string, role string, x double, y double")
    out = force_mains.review(m, nodes, edges, facilities=fac)
    assert {r.comp: r.verdict for r in out["verdicts"].collect()} == {0: "terminates_at_facility", 2: "multi_discharge"}
    assert {r.flag_type for r in out["flags"].collect()} == {"facility_direction_conflict"}
    rule = spark.createDataFrame([(0, 1.0, 3000.0, "wetwell")], "ord long, x double, y double, classification string")
    out = force_mains.review(m, nodes, edges, facilities=fac, rulings=rule)
    assert {r.comp: r.verdict for r in out["verdicts"].collect()}[2] == "resolved"
    assert [(r.comp, r.wetwell_contact) for r in out["links"].collect()] == [(2, "facility")]
    assert "ends at a plant" in out["skipped"].where("comp = 0").first().reason
    assert "facility_confirmed" in {r.settled_as for r in out["settled"].collect()}


def test_layers_rules_charge_the_first_reason(spark):
    rows = [("a", "Active", "X", "12", None, b"1"), ("b", "Gone", "PVT", "0", None, b"1"), ("c", "Active", "PVT", "0", None, b"1"), ("d", "Active", None, "0", None, b"1"), ("e", "Active", "X", "x", None, b"1"), ("f", "Active", "X", "3", None, b"1"), ("g", "Active", "X", "6", "An Emergency BYPASS here", b"1"), ("h", None, "X", "6", None, b"1"), ("i", "Active", "X", "6", None, None), ("j", "Active", "X", "6", "100% by.pass", b"1")]
    layer = spark.createDataFrame(rows, "FACILITYID string, LIFECYCLES string, OWNER string, DIAMETER string, COMMENT string, geom binary")
    kept, gone = src.load_mains(layer)
    assert {r.FACILITYID for r in kept.collect()} == {"a", "j"} and kept.columns == layer.columns
    assert [(r.facilityids, r.n) for r in gone.orderBy("ord").collect()] == [("b, h", 2), ("c", 1), ("e", 1), ("d", 1), ("f", 1), ("g", 1), ("i", 1)]
    kept, gone = src.load_mains(layer, src.Rules(lifecycle=(), exclude_owner=(), min_diameter_in=None, exclude_comment=("%", "y.p"), exclude_facilityid=("a",)))
    assert {r.FACILITYID for r in kept.collect()} == {"b", "c", "d", "e", "f", "g", "h"} and gone.count() == 3


def test_hand_written_lists(spark, tmp_path):
    at = lambda name, text: str((tmp_path / name).write_bytes(text.encode("cp1252")) and tmp_path / name)
    j = src.read_joins(spark, at("j.csv", "x,y,radius_ft,note\n1,2,,caf\xe9\n\n3,4,0,\n5,6,7,\n"))
    assert [tuple(r) for r in j.orderBy("ord").collect()] == [(0, 1, 2, 5), (1, 3, 4, 5), (2, 5, 6, 7)]
    assert src.read_joins(spark, None).count() == src.read_joins(spark, str(tmp_path / "none.csv")).count() == 0
    with pytest.raises(ValueError, match="line 2"):
        src.read_joins(spark, at("b.csv", "x,y\n1,q\n"))
    r = src.read_rulings(spark, at("r.csv", "x,y,classification\n1,2,wetwell\n3,4,\n"))
    assert [(x.x, x.classification) for x in r.collect()] == [(1.0, "wetwell")]
    with pytest.raises(ValueError, match="uphill"):
        src.read_rulings(spark, at("r2.csv", "x,y,classification\n1,2,uphill\n"))
    assert src.read_links(spark, None) is None
    with pytest.raises(FileNotFoundError):
        src.read_links(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="discharge_y"):
        src.read_links(spark, at("l.csv", "wetwell_x,wetwell_y,discharge_x\n1,2,3\n"))
    assert tuple(src.read_links(spark, at("l2.csv", "﻿comp_id,wetwell_x,wetwell_y,discharge_x,discharge_y\n7,1,2,3,4\n".encode().decode("latin-1"))).first())[1:] == (1, 2, 3, 4)
    p = src.read_prior(spark, at("p.csv", "fm_x,fm_y,decision,comment,decision\n1,2,yes,c,\n3,4,,c,\n5,6,no,c,really\nq,6,no,,\n"))
    assert {tuple(x) for x in p.collect()} == {(1.0, 2.0, "yes"), (5.0, 6.0, "no | really")}
    assert src.read_prior(spark, None) is None
