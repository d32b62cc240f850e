import io
import zipfile

import pytest

from tributary.operators import facilities as fc
from tributary.sources.facilities import parse_facilities, read_facilities, sheet_rows

FAC = "fac long, name string, role string, x double, y double"
TERM = "comp long, node long, x double, y double, contact string, classification string"


def test_match_stamp_and_flags(spark):
    fac = spark.createDataFrame([(0, "A", "station", 0.0, 50.0), (1, "B", "plant", 5000.0, 900.0), (2, "C", "station", 9000.0, 0.0), (3, "D", "station", 1000.0, 0.0), (4, "E", "ignore", 0.0, 0.0), (5, "A2", "station", 0.0, 60.0)], FAC)
    term = spark.createDataFrame([(1, 10, 0.0, 0.0, "none", "none"), (1, 11, 1000.0, 0.0, "connected", "discharge"), (2, 12, 5000.0, 0.0, "connected", "discharge"), (3, 13, -5000.0, 0.0, "candidate", "wetwell?")], TERM)
    m = fc.match(fac, term)
    assert {r.fac: (r.node, r.status) for r in m.collect()} == {0: (10, "matched"), 1: (12, "matched"), 2: (None, "no_force_main"), 3: (11, "matched"), 5: (10, "matched")}
    out = fc.stamp(term, m)
    got = {r.node: (r.classification, r.contact, r.facility_name, r.facility_conflict) for r in out.collect()}
    assert got == {10: ("wetwell", "facility", "A2", False), 11: ("discharge", "connected", "D", True), 12: ("terminal", "facility", "B", False), 13: ("wetwell?", "candidate", "", False)}
    assert {(r.flag_type, r.name) for r in fc.flags(m, out).collect()} == {("facility_no_force_main", "C"), ("facility_direction_conflict", "D")}
    rule = spark.createDataFrame([(0, 1003.0, 0.0, "discharge"), (1, 1001.0, 0.0, "wetwell")], "ord long, x double, y double, classification string")
    ruled = {r.node: (r.classification, r.contact, r.facility_conflict) for r in fc.overrule(out, rule).collect()}
    assert ruled[11] == ("wetwell", "facility", False) and ruled[13] == ("wetwell?", "candidate", False)
    far = spark.createDataFrame([(0, 1e6, 0.0, "wetwell")], "ord long, x double, y double, classification string")
    with pytest.raises(Exception, match="meets no terminus"):
        fc.overrule(out, far).collect()


def test_station_junctions_are_claimed_in_order(spark):
    clusters = spark.createDataFrame([(1, 0.0, 0.0, 2), (2, 100.0, 0.0, 1), (3, 5000.0, 0.0, 3), (4, 5030.0, 0.0, 1), (5, 0.0, 90.0, 2)], "node long, x double, y double, n_nbr long")
    ends = spark.createDataFrame([(2,), (4,)], "node long")
    fac = spark.createDataFrame([(0, "A", "station", 10.0, 0.0), (1, "B", "station", 12.0, 0.0), (2, "C", "station", 5029.0, 0.0), (3, "D", "station", 0.0, 80.0), (4, "P", "plant", 0.0, 0.0)], FAC)
    got = {r.fac: r.node for r in fc.station_junctions(fac, clusters, ends).collect()}
    # B finds the junction taken, and the taken one counts as a free end that is nearer than the next
    assert got == {0: 1, 3: 5}
    assert fc.station_junctions(fac.where("false"), clusters, ends).count() == 0


def test_discharge_beside_a_station(spark):
    fac = spark.createDataFrame([(0, "East", "station", 0.0, 0.0)], FAC)
    term = spark.createDataFrame(
        [(1, 1, 5.0, 0.0, "connected", "discharge", ""), (1, 2, 900.0, 0.0, "facility", "wetwell", "East"), (2, 3, 9.0, 0.0, "connected", "discharge", ""), (2, 4, 999.0, 0.0, "facility", "wetwell", "West"), (3, 5, 7.0, 0.0, "connected", "discharge", "")],
        TERM + ", facility_name string",
    )
    mains = spark.createDataFrame([(1, 2, 20.0), (3, 4, 20.0), (5, 6, 400.0)], "a long, b long, length_ft double")
    assert {r.node: (r.contact, r.station_adjacent) for r in fc.station_adjacent(term, mains, fac).collect()} == {
        1: ("candidate", True), 2: ("facility", False), 3: ("connected", False), 4: ("facility", False), 5: ("connected", False),
    }


def test_wiring_and_loops(spark):
    nodes = spark.createDataFrame([(i, 100.0 * i, 0.0) for i in range(4)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(0, 1, 7), (1, 2, 8)], "u long, v long, pidx long")
    link = "comp long, wet_x double, wet_y double, out_x double, out_y double"
    wired = fc.wire(edges, spark.createDataFrame([(1, 203.0, 0.0, 1.0, 0.0), (2, 301.0, 0.0, 299.0, 0.0)], link), nodes)
    assert {tuple(r) for r in wired.collect()} == {(0, 1, 7), (1, 2, 8), (2, 0, None)}
    assert {(r.u, r.v) for r in fc.loops_through_mains(wired).collect()} == {(2, 0)}
    with pytest.raises(Exception, match="no node within tolerance"):
        fc.wire(edges, spark.createDataFrame([(1, 250.0, 0.0, 1.0, 0.0)], link), nodes).collect()


def test_lists_from_csv_and_workbook(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("﻿Name,Coords\nNorth Plant,\"35.999688, -78.903643\"\n".encode())
    d = read_facilities(spark, str(tmp_path / "f.csv"), [("plant", "plant")]).collect()[0]
    assert d.role == "plant" and (round(d.x, 2), round(d.y, 2)) == (2028502.46, 818798.60)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><t>East</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>lat</t></is></c><c r="D1" t="inlineStr"><is><t>long</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>36</v></c><c r="D2"><v>-79</v></c></row></sheetData></worksheet>')
    assert parse_facilities(sheet_rows(raw.getvalue())) == [(0, "East", 36.0, -79.0)]
    assert read_facilities(spark, None, []).count() == 0


@pytest.mark.parametrize("rows, error", [([["Name"]], "needs Name"), ([["Name", "Coords"], ["A", "x"]], "can't be read"), ([["Name", "Coords"], ["A", "-100, 36"]], "beyond 90"), ([["Name", "Coords"], ["A", "79, 36"]], "larger than")])
def test_bad_lists(rows, error):
    with pytest.raises(ValueError, match=error):
        parse_facilities(rows)
