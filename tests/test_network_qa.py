from collections import Counter

import pytest

from tributary.plans import network, network_qa as qa

PIPE = "pidx long, fid string, frommh string, tomh string, slope double, up_inv double, dn_inv double, sx double, sy double, ex double, ey double"


class Net:
    """Lines laid one by one; each names its manholes after its own id unless told otherwise."""

    def __init__(self):
        self.rows = []

    def lay(self, fid, start, end, up=20.0, down=19.0, slope=0.4, named=True):
        self.rows.append((len(self.rows), fid, f"{fid}.a" if named else None, f"{fid}.b", slope, up, down, *map(float, (*start, *end))))
        return self

    def pipes(self, spark):
        return spark.createDataFrame(self.rows, PIPE)

    def fid(self, pidx):
        return self.rows[pidx][1]


def holes(spark, *rows):
    return spark.createDataFrame([(f, float(x), float(y)) for f, x, y in rows], "fid string, x double, y double")


def members(out, net):
    of = {}
    for m in out["members"].collect():
        of.setdefault((m.flag_type, m.flag), set()).add(net.fid(m.pidx))
    return lambda kind: sorted(tuple(sorted(v)) for (t, _), v in of.items() if t == kind)


def test_each_check_finds_what_was_built_wrong(spark):
    net = Net()
    # a loop of three with a way in
    net.lay("in", (-70, 40), (0, 0)).lay("l1", (0, 0), (60, 10)).lay("l2", (60, 10), (30, 70)).lay("l3", (30, 70), (0, 0))
    # ends four feet apart, which the snap joins
    net.lay("g1", (1000, 0), (1000, 80)).lay("g2", (1000, 84), (1000, 160))
    # an end seven feet from where two lines pass into each other, which it doesn't join
    net.lay("j1", (2000, 0), (2000, 50)).lay("j2", (2000, 50), (2000, 120)).lay("stray", (2090, 50), (2007, 50))
    # inverts that rise, a fall against the slope's sign, and a rise that also has a negative slope
    net.lay("rise", (3000, 0), (3050, 0), up=7.5, down=8.25).lay("sign", (3050, 0), (3100, 0), slope=-0.2).lay("both", (3100, 0), (3150, 0), up=3.0, down=3.5, slope=-1.0)
    # inverts of zero say nothing
    net.lay("zero", (3150, 0), (3200, 0), up=0.0, down=4.0).lay("nameless", (3200, 0), (3250, 0), named=False)
    h = holes(spark, ("in.a", -70, 40), ("lost", 3203, 4), ("gone", 3250, 30))
    out = qa.run_qa(net.pipes(spark), h)
    flags = out["flags"].collect()
    by = members(out, net)
    assert Counter(f.flag_type for f in flags) == {
        "directed_cycle": 1, "snap_gap": 2, "invert_conflict": 2, "attribute_slope_error": 1, "missing_direction": 1, "isolated_manhole": 2, "disconnected_component": 5,
    }
    # lines that touch the loop's nodes ride along
    assert by("directed_cycle") == [("in", "l1", "l2", "l3")]
    gaps = {f.severity: (f.x, f.y, f.dist) for f in flags if f.flag_type == "snap_gap"}
    assert gaps == {"warning": (1000.0, (80 + 84) / 2, 4.0), "review_required": ((2000 + 2007) / 2, 50.0, 7.0)}
    assert by("snap_gap") == [("g1", "g2"), ("j1", "j2", "stray")]
    assert by("invert_conflict") == [("both",), ("rise",)] and by("attribute_slope_error") == [("sign",)] and by("missing_direction") == [("nameless",)]
    reach = {f.flag: (f.dist, f.description) for f in flags if f.flag_type == "isolated_manhole"}
    assert reach["isolated_lost"][0] == 5.0 and "ids may differ" in reach["isolated_lost"][1]
    assert reach["isolated_gone"][0] == 30.0 and "30.0 ft" in reach["isolated_gone"][1]
    assert all(f.description for f in flags)
    state = {r.fid: (r.qa_status, r.qa_flags) for r in out["pipes"].collect()}
    assert state["nameless"][0] == "direction_inferrable" and state["rise"][0] == "flagged" and state["both"][1] == "disconnected_component, invert_conflict"


def test_suspects_of_a_large_loop_come_first(spark):
    net = Net()
    corners = [(0, 0), (40, -30), (90, -20), (130, 20), (120, 80), (70, 110), (10, 70)]
    for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1])):
        net.lay(f"r{i}", a, b, up=-3.0 if i == 2 else 5.0, down=-1.0 if i == 2 else 4.0, slope=-0.1 if i == 5 else 0.3)
    out = qa.run_qa(net.pipes(spark), holes(spark), qa.Settings(cycle_nodes=6))
    assert sorted(f.flag_type for f in out["flags"].collect()) == ["attribute_slope_error", "large_cycle"]
    rows = qa.suspects(out["members"], net.pipes(spark)).orderBy("ord").collect()
    # an invert below zero counts here
    assert [(r.fid, r.reasons) for r in rows[:2]] == [("r2", ["uphill_invert"]), ("r5", ["negative_slope"])] and len(rows) == 7


def test_logs_become_flags(spark):
    net = Net().lay("main", (0, 0), (200, 0)).lay("lateral", (90, 75), (90, 1))
    p = net.pipes(spark)
    drawn = p.selectExpr("pidx", "fid", "array(named_struct('x', sx, 'y', sy), named_struct('x', ex, 'y', ey)) AS coords")
    lines, cuts = network.split_midspan(drawn, holes(spark))
    wanted = spark.createDataFrame([(0, "flip", "lateral", None, None, None)], "ord long, decision string, pipe_id string, x double, y double, target string")
    lines, log = network.edit_pipes(lines, wanted, holes(spark))
    drawn = network.line_ends(lines).join(p.drop("fid", "sx", "sy", "ex", "ey"), "pidx", "left")
    out = qa.run_qa(drawn, holes(spark), split_log=cuts, edit_log=log)
    got = {f.flag_type: (f.severity, f.x, f.y) for f in out["flags"].collect() if f.flag_type in ("midspan_junction", "manual_edit")}
    assert got == {"midspan_junction": ("warning", 90.0, 0.0), "manual_edit": ("warning", 90.0, pytest.approx(37.5))}
    assert {(m.flag_type, m.pidx) for m in out["members"].where("flag_type IN ('midspan_junction', 'manual_edit')").collect()} == {("midspan_junction", 0), ("manual_edit", 1)}


def test_empty_network(spark):
    net = Net().lay("only", (0, 0), (9, 0))
    out = qa.run_qa(net.pipes(spark).where("false"), holes(spark, ("h", 1, 1)))
    assert {(f.flag_type, f.dist) for f in out["flags"].collect()} == {("isolated_manhole", None)} and out["members"].count() == 0
