import json

import pytest
from pyspark.sql import functions as F

from tributary.functions import shapes
from tributary.operators import reports
from tributary.sources import census, config, gpkg, layers, shapefile


def wkt(spark, *rows, cols="id long, name string, geom string"):
    shapes.register(spark)
    return spark.createDataFrame(rows, cols).withColumn("geom", shapes.parse("geom"))


HOLED = "POLYGON((0 0,100 0,100 100,0 100,0 0),(20 20,20 40,40 40,40 20,20 20))"
TWO = "MULTIPOLYGON(((0 0,0 10,10 10,10 0,0 0)),((200 0,300 0,300 100,200 100,200 0),(210 10,210 20,220 20,220 10,210 10)))"


@pytest.mark.parametrize("kind,geoms", [("polygon", [HOLED, TWO, None]), ("line", ["LINESTRING(0 0,3 4)", "MULTILINESTRING((0 0,1 1),(5 5,6 6))"]), ("point", ["POINT(3 4)", "POINT(-1 2.5)"])])
def test_shapefile_round_trip(spark, tmp_path, kind, geoms):
    d = wkt(spark, *[(i, f"näme {i}" if i else None, g) for i, g in enumerate(geoms)])
    assert shapefile.write_shapefile(d, str(tmp_path / "a.shp"), 'PROJCS["x"]') == len(geoms)
    got = layers.read_layer(spark, str(tmp_path / "a.shp")).orderBy("fidx")
    m = lambda x: x.select("id", "name", shapes.measure("area", "geom"), shapes.measure("length", "geom"), shapes.measure("x", "geom"), shapes.measure("parts", "geom")).orderBy("id").collect()
    assert [tuple(r) for r in m(got)] == [tuple(r) for r in m(d)]
    both = got.select("id", F.col("geom").alias("g")).join(d, "id").select(shapes.measure("area", shapes.two("difference", "g", "geom")).alias("gap"))
    assert all(not r.gap for r in both.collect())


def test_shapefiles_that_cannot_be(spark, tmp_path):
    with pytest.raises(ValueError, match="one kind"):
        shapefile.write_shapefile(wkt(spark, (0, "a", "POINT(0 0)"), (1, "b", HOLED)), str(tmp_path / "b.shp"))
    with pytest.raises(ValueError, match="unique"):
        shapefile.write_shapefile(wkt(spark, (0, "a", "POINT(0 0)"), cols="classification long, classificatory string, geom string"), str(tmp_path / "c.shp"))
    long = wkt(spark, (0, "é" * 300, "POINT(0 0)"))
    shapefile.write_shapefile(long, str(tmp_path / "d.shp"))
    assert layers.read_layer(spark, str(tmp_path / "d.shp"), declared="working").first()["name"] == "é" * 127
    with pytest.raises(ValueError, match="doesn't say"):
        layers.read_layer(spark, str(tmp_path / "d.shp"))


# fixed value: the published anchor of the projection
def test_projection_of_shapes_there_and_back(spark):
    d = wkt(spark, (0, "a", "POINT(-78.903643 35.999688)"), (1, "b", "LINESTRING(-79 36,-78.5 35.5)"))
    p = d.withColumn("geom", shapes.project("geom"))
    r = p.where("id = 0").select(shapes.measure("x", "geom"), shapes.measure("y", "geom")).first()
    assert abs(r[0] - 2028502.464) < 0.01 and abs(r[1] - 818798.599) < 0.01
    back = p.select("id", shapes.project("geom", False).alias("g")).join(d, "id").select(shapes.measure("distance", "g", "geom"), (shapes.measure("length", "g") - shapes.measure("length", "geom")))
    assert all(abs(x) < 1e-9 for r in back.collect() for x in r)


def test_units_and_blocks(spark, tmp_path):
    deg = "POLYGON((-79 36,-78.99 36,-78.99 36.01,-79 36.01,-79 36))"
    rows = wkt(spark, (1, "063", deg), (2, "064", deg), (3, "063", None), cols="GEOID20 long, COUNTYFP20 string, geom string")
    shapefile.write_shapefile(rows, str(tmp_path / "b.shp"), 'GEOGCS["deg"]')
    gpkg.write_layer(rows, str(tmp_path / "b.gpkg"), "blocks")
    for path, declared in ((tmp_path / "b.shp", None), (tmp_path / "b.gpkg", "degrees")):
        got = layers.load_census_blocks(spark, str(path), "063", declared).collect()
        assert [r.GEOID20 for r in got] == [1]
    area = layers.load_census_blocks(spark, str(tmp_path / "b.shp")).select(shapes.measure("area", "geom").alias("a")).collect()
    assert len(area) == 2 and abs(area[0].a - 2956 * 3640) < 2e5
    with pytest.raises(ValueError, match="no census"):
        layers.load_census_blocks(spark, None)
    parcels = wkt(spark, ("p", TWO), ("p", HOLED), ("q", HOLED), ("r", None), cols="ALTPARNO string, geom string")
    parcels.write.parquet(str(tmp_path / "parcels"))
    got = layers.load_units(spark, "parcels", str(tmp_path / "parcels"))
    assert sorted(r.PARTID for r in got.collect()) == ["p#0", "p#1", "p#2", "q#0"] and {"ALTPARNO", "geom"} <= set(got.columns)
    assert layers.load_units(spark, "parcels", str(tmp_path / "parcels"), explode=False).count() == 3
    assert layers.unit_id(got) == "PARTID" and layers.unit_id(parcels) == "ALTPARNO" and layers.unit_id(parcels.select("geom")) is None
    assert layers.explode_units(parcels.select("geom")).select("PARTID").distinct().count() == 4
    with pytest.raises(ValueError, match="unknown units"):
        layers.load_units(spark, "farms", "x")


def test_pipes_and_manholes(spark):
    d = wkt(spark, (0, "a", "MH1", " ", "0.5", "LINESTRING(0 0,1 1,2 0)"), (1, None, None, "MH2", "x", None), cols="fidx long, FACILITYID string, FROMMH string, TOMH string, SLOPE string, geom string")
    a, b = layers.load_pipes(d).orderBy("pidx").collect()
    assert [(p.x, p.y) for p in a.coords] == [(0, 0), (1, 1), (2, 0)] and (a.slope, a.up_inv, b.slope, b.coords, b.fid) == (0.5, None, None, None, None)
    m = layers.load_manholes(wkt(spark, (0, "7", 1.5, "POINT(3 4)"), cols="fidx long, FACILITYID string, INVERTELEV double, geom string")).first()
    assert (m.fid, m.x, m.y, m.INVERTELEV) == ("7", 3.0, 4.0, 1.5)


def test_truth_join(spark):
    poly = wkt(spark, *[(f"0{i}", HOLED) for i in range(25)], ("x", HOLED), ("y", HOLED), cols="SiteID string, geom string")
    pts = wkt(spark, *[(f"{i}.0" if i % 2 else str(i), f"POINT({i} 1)") for i in range(25)], ("z", "POINT(0 0)"), cols="AssetID_tx string, geom string")
    t = layers.load_truth(poly, pts)
    assert t.count() == 25 and {(r.site, r.x) for r in t.collect()} == {(str(i), float(i)) for i in range(25)}
    with pytest.raises(ValueError, match="only 24 of 27.*'x', 'y'"):
        layers.load_truth(poly, pts.where("AssetID_tx <> '4'"))


def test_site_and_meter_lists(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("SiteID,FacilityID,X,Y,Tract\nA,02201,,,T1\nB,,10.5,20,\n,077,,,\n,,,,\n")
    got = [tuple(r) for r in layers.site_list(spark, str(f)).orderBy("ord").collect()]
    assert got == [(0, "A", "T1", "02201", None, None), (1, "B", "", None, 10.5, 20.0), (2, "077", "", "077", None, None)]
    assert [r.site for r in layers.site_list(spark, ids=" 01, 2 ,").collect()] == ["01", "2"]
    assert layers.site_list(spark, settings={"manhole_coordinate": [1, 2]}).first().site == "(1,2)"
    for kw in ({}, {"ids": "1,1"}):
        with pytest.raises(ValueError):
            layers.site_list(spark, **kw)
    with pytest.raises(ValueError, match="needs x and y"):
        layers.parse_sites("a,b\n1,2\n")
    m = tmp_path / "m.csv"
    m.write_text("LOCATION NAME,LATITUDE,LONGITUDE\nM_ENO_1,35.999688,-78.903643\nplain,36,-79\n")
    got = {r.site: (round(r.x, 1), round(r.y, 1)) for r in layers.meter_targets(spark, str(m)).collect()}
    assert set(got) == {"ENO_1", "plain"} and got["ENO_1"] == (2028502.5, 818798.6)
    m.write_text("LOCATION NAME,LATITUDE\n")
    with pytest.raises(ValueError, match="longitude"):
        layers.meter_targets(spark, str(m))
    with pytest.raises(FileNotFoundError):
        layers.meter_targets(spark, str(tmp_path / "none.csv"))


def test_flags_in_one_shape_and_their_layers(spark, tmp_path):
    net = wkt(spark, ("P1", "snap_gap", "warning", "open", "gap", "POINT(0 0)"), ("P2", "snap_gap", "warning", None, "gap", None), cols="pipe_id string, flag_type string, severity string, status string, description string, geom string")
    own = wkt(spark, ("s", 7, "competing_pipe", "warning", HOLED), ("s", None, "competing pipe!", "warning", "POINT(1 1)"), ("s", 8, "competing_pipe", "warning", "POINT(1 1)"), cols="site string, uid long, flag_type string, severity string, geom string")
    d = reports.normalise(net, own)
    assert sorted((r.source, r.feat_id, r.review, r.layer) for r in d.collect()) == [("delineation", "7", "", "delin_competing_pipe"), ("delineation", "8", "", "delin_competing_pipe"), ("delineation", "s", "", "delin_competing_pipe"), ("network", "P1", "open", "net_snap_gap")]
    path = str(tmp_path / "f.gpkg")
    assert gpkg.write_flags(d, path) == ["delin_competing_pipe_point", "delin_competing_pipe_polygon", "net_snap_gap"]
    assert gpkg.clear_layers(path, "delin_") == ["delin_competing_pipe_point", "delin_competing_pipe_polygon"] and gpkg.layers(spark, path) == ["net_snap_gap"]
    assert gpkg.clear_layers(str(tmp_path / "none.gpkg"), "x") == []
    assert layers.write_csv(d.select("feat_id", "descr").where("false"), str(tmp_path / "f.csv")) == 0
    assert (tmp_path / "f.csv").read_bytes() == b"\xef\xbb\xbffeat_id,descr\r\n"


def test_output_frames(spark):
    shape = wkt(spark, ("a", HOLED), ("b", None), cols="site string, geom string")
    trace = spark.createDataFrame([("a", 0, 1), ("a", None, 2), ("a", 2, 3)], "site string, pidx long, depth int")
    units = spark.createDataFrame([("a",), ("a",)], "site string")
    r = reports.catchment_frame(units.distinct(), units, trace, shape).first()
    assert (r.manhole, r.area_acres, r.n_parcels, r.n_pipes, r.max_depth) == ("a", 0.22, 2, 3, 3)
    assert [(x.manhole, x.method) for x in reports.boundary_frame(shape, "delaunay").collect()] == [("a", "delaunay")]
    pipes = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "pidx long, fid string")
    assert {(x.fid, x.depth, x.manhole) for x in reports.trace_frame(pipes, trace).collect()} == {("x", 1, "a"), ("z", 3, "a")}
    assert reports.median_area(shape).first().n == 2


def test_census_requests(spark, tmp_path):
    def get(url, params):
        asked = dict(params)
        if url.endswith("data.json"):
            return 200, url, json.dumps({"dataset": [{"c_dataset": ["acs", "acs5"], "c_vintage": y} for y in (2020, 2022, 2021)] + [{"c_dataset": ["dec", "pl"]}]})
        if url.endswith("variables.json"):
            return 200, url, json.dumps({"variables": {"B1_001E": {}, "NAME": {}}})
        if asked["key"] == "bad":
            return 200, url + "/missing_key.html", "<html>"
        county = [v for k, v in params if k == "in"][1][7:]
        if county == "009":
            return 500, url, "down"
        if county == "010":
            return 200, url, "error: unknown variable"
        return 200, url, json.dumps([["P1", "state", "county", "tract", "block"], ["12", "37", county, "000100", "1000"], ["-666666666", "37", county, "000100", "1001"], [None, "37", county, "000100", "1002"]])

    assert census.latest_vintage(["acs", "acs5"], get) == 2022 and census.available_variables(2022, "acs/acs5", get) == {"B1_001E", "NAME"}
    with pytest.raises(census.CensusError):
        census.latest_vintage(["dec", "pl"], get)
    d = census.fetch(spark, "decennial", 2020, ["P1"], [("37", "063"), ("37", "064")], "k", get)
    assert {r.GEOID20: r.P1 for r in d.collect()} == {f"37{c}000100100{i}": (12, None, None)[i] for c in ("063", "064") for i in range(3)}
    for county, key, words in (("009", "k", "status 500"), ("010", "k", "is a code or place wrong"), ("063", "bad", "doesn't take the key")):
        with pytest.raises(Exception, match=words):
            census.fetch(spark, "decennial", 2020, ["P1"], [("37", county)], key, get).collect()
    assert census.resolve_key({}, {"CENSUS_API_KEY": " a "}) == "a"
    (tmp_path / ".census_api_key").write_text("b\n")
    assert census.resolve_key({"_base_dir": str(tmp_path), "inputs": {"census_api_key": "c"}}, {}) == "b"
    assert census.resolve_key({"inputs": {"census_api_key": "c"}}, {}) == "c"
    with pytest.raises(census.CensusError):
        census.resolve_key({}, {})


def test_settings_are_checked_at_once(tmp_path):
    import yaml

    for name in ("p.shp", "m.shp", "u.shp"):
        (tmp_path / name).write_text("")
    good = {
        "inputs": {"gravity_main_shapefile": "p.shp", "manholes_shapefile": "m.shp", "population_units_shapefile": "u.shp", "manhole_id": "7", "force_main_edges": "QC/e.csv"},
        "parameters": {k: 1 for k in config.PARAMETERS} | {"boundary_method": "delaunay", "basemap_style": "street"},
        "outputs": {k: f"out/{k}" for k in config.OUTPUTS},
    }
    f = tmp_path / "c.yaml"
    f.write_text(yaml.safe_dump(good))
    cfg = config.load_config(str(f))
    assert cfg["inputs"]["force_main_edges"] == str(tmp_path / "QC/e.csv") and cfg["_base_dir"] == str(tmp_path)
    bad = {"inputs": good["inputs"] | {"manholes_shapefile": "none.shp", "manhole_coordinate": [1]}, "parameters": {k: v for k, v in good["parameters"].items() if k != "crs"} | {"boundary_method": "magic", "close_radius_ft": -1}, "outputs": {}}
    f.write_text(yaml.safe_dump(bad))
    with pytest.raises(ValueError) as e:
        config.load_config(str(f))
    for word in ("none.shp", "not both", "[x, y]", "crs is missing", "magic", "close_radius_ft must", "outputs.flags_report"):
        assert word in str(e.value)
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none.yaml"))
