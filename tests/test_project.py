import csv
import json

import pytest
import yaml
from pyspark.sql import functions as F

from tests.test_polygons import NODES, PIPES
from tributary.functions import shapes
from tributary.plans import project
from tributary.sources import config, gpkg, layers, shapefile


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    """The example network, its parcels and a census of two blocks as files, with a settings file."""
    at = tmp_path_factory.mktemp("project")
    shapes.register(spark)
    prj = 'PROJCS["working"]'
    line = spark.createDataFrame([(f"P{i}", f"MH{a:02d}", f"MH{b:02d}", 0.4, *map(float, (*NODES[a], *NODES[b]))) for i, (a, b) in enumerate(PIPES)], "FACILITYID string, FROMMH string, TOMH string, SLOPE double, sx double, sy double, ex double, ey double").coalesce(1)
    shapefile.write_shapefile(line.withColumn("geom", shapes.segment()).drop("sx", "sy", "ex", "ey"), str(at / "mains.shp"), prj)
    hole = spark.createDataFrame([(f"0{k}", 5.0, float(x), float(y)) for k, (x, y) in NODES.items()], "FACILITYID string, INVERTELEV double, x double, y double").coalesce(1)
    point = shapes.parse(F.concat(F.lit("POINT("), F.col("x"), F.lit(" "), F.col("y"), F.lit(")")))
    shapefile.write_shapefile(hole.withColumn("geom", point).drop("x", "y"), str(at / "holes.shp"), prj)
    cells = [(f"c{k}", "RES/ONE" if k % 7 else "SHOP", 1000.0 * k, x, y, x + 200.0, y + 200.0) for k, (y, x) in enumerate((y * 200.0 - 400, x * 200.0 - 1400) for y in range(15) for x in range(14))]
    unit = spark.createDataFrame(cells, "ALTPARNO string, PARUSEDESC string, PARVAL double, x0 double, y0 double, x1 double, y1 double").coalesce(1).withColumn("geom", shapes.box()).drop("x0", "y0", "x1", "y1")
    shapefile.write_shapefile(unit, str(at / "parcels.shp"))
    block = spark.createDataFrame([("370630001001001", "063", -1400.0, -400.0, 0.0, 2600.0), ("370630001001002", "063", 0.0, -400.0, 1400.0, 2600.0), ("379990001001002", "999", 0.0, 0.0, 1.0, 1.0)], "GEOID20 string, COUNTYFP20 string, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    shapefile.write_shapefile(block.withColumn("geom", shapes.box()).drop("x0", "y0", "x1", "y1"), str(at / "blocks.shp"), prj)
    (at / "data/census").mkdir(parents=True)
    (at / "data/census/dec.csv").write_text("GEOID20,P1,P3\n370630001001001,1000,400\n370630001001002,500,100\n")
    (at / "data/census/acs.csv").write_text("GEOID,N,D,NM,DM,I1,I2\n370630001001,30,100,5,10,40,60\n")
    (at / "data/census/manifest.json").write_text(json.dumps({"decennial": {"path": "data/census/dec.csv"}, "acs5": {"path": "data/census/acs.csv"}}))
    rate = {"num": "N", "den": "D", "num_moe": "NM", "den_moe": "DM"}
    cfg = {
        "inputs": {"gravity_main_shapefile": "mains.shp", "manholes_shapefile": "holes.shp", "population_units_shapefile": "parcels.shp", "population_units_crs": "EPSG:2264", "manhole_id": "1", "census_blocks_shapefile": "blocks.shp", "census_blocks_county_fips": "063", "qa_review_decisions": "QC/decisions.csv"},
        "parameters": {k: 1 for k in config.PARAMETERS}
        | {"crs": "EPSG:2264", "manhole_snap_distance_ft": 50, "pipe_buffer_distance_ft": 50, "selection_radius_ft": 50, "large_catchment_threshold_acres": 500, "max_mappable_cycle_nodes": 10, "boundary_method": "delaunay", "close_radius_ft": 150, "basemap_style": "street"},
        "outputs": {k: f"out/{v}" for k, v in {"output_polygon": "final.shp", "flags_report": "flags.csv", "flag_maps_pdf": "maps.pdf", "sewershed_parcels": "units.shp", "debug_upstream_pipes": "trace.shp", "qc_flags_gpkg": "flags.gpkg", "demographics_csv": "d.csv", "demographics_shp": "d.shp", "force_main_review": "fr.csv", "force_main_settled": "fs.csv", "force_main_edges": "fe.csv", "force_main_review_shp": "fr.shp"}.items()},
        "demographics": {"boundary_gpkg": "b.gpkg", "boundary_layer": "boundary", "site_id_field": "SiteID", "land_use_desc_column": "PARUSEDESC", "residential_desc_prefixes": ["RES/"], "residential_desc_contains": [], "roles": {"total_pop": "P1", "race": {"a": "P3"}, "poverty": rate, "snap": rate, "income_bins": [["I1", 0, 10000], ["I2", 10000, None]]}},
    }
    (at / "settings.yaml").write_text(yaml.safe_dump(cfg))
    return at


def test_catchments_from_files_to_files(spark, home):
    cfg = config.load_config(str(home / "settings.yaml"))
    out = project.run_catchments(spark, cfg, ids="1,008,77", write=True)
    assert {r.site: r.status for r in out["sites"].collect()} == {"1": "ok", "008": "ok", "77": "not_found"}
    final = layers.read_layer(spark, str(home / "out/final.shp"), declared="working").collect()
    # the published area of the example, from files
    assert [r.manhole for r in final] == ["1"] and final[0].area_acres == pytest.approx(70.71, abs=0.01)
    assert layers.read_layer(spark, str(home / "out/trace.shp"), declared="working").count() == 14
    assert layers.read_layer(spark, str(home / "out/units.shp"), declared="working").first().n_parcels == 52
    rows = list(csv.DictReader(open(home / "out/flags.csv", encoding="utf-8-sig")))
    assert {(r["site"], r["flag_type"]) for r in rows} == {("008", "no_upstream_found")}


def test_checks_from_files_with_decisions(spark, home):
    (home / "QC").mkdir(exist_ok=True)
    (home / "QC/decisions.csv").write_text("flag_type,pipe_id,x,y,decision,radius_ft,target,comment\nisolated_manhole,08,,,dismiss,,,\n,P3,,,flip,,,\n")
    cfg = config.load_config(str(home / "settings.yaml"))
    out = project.run_checks(spark, cfg, write=True)
    got = {(r.flag_type, r.pipe_id): r.status for r in out["flags"].collect()}
    assert got["manual_edit", "P3"] == "open" and got["isolated_manhole", "08"] == "dismiss"
    assert "net_manual_edit" in gpkg.layers(spark, str(home / "out/flags.gpkg"))
    (home / "QC/decisions.csv").unlink()


def test_records_from_files(spark, home):
    box = spark.createDataFrame([("s", -1400.0, -400.0, 0.0, 2600.0), ("t", -700.0, -400.0, 1400.0, 2600.0)], "SiteID string, x0 double, y0 double, x1 double, y1 double").withColumn("geom", shapes.box()).drop("x0", "y0", "x1", "y1")
    gpkg.write_layer(box, str(home / "b.gpkg"), "boundary")
    cfg = config.load_config(str(home / "settings.yaml"))
    got = {r.site: r for r in project.run_demographics(spark, cfg, write=True).collect()}
    # s is the first block whole; of t the homes right of -700 in the first block and all in the second
    assert got["s"].population == 1000 and got["s"].pct_a == pytest.approx(40.0) and got["s"].n_block_groups == 1
    res = [(x, y) for k, (y, x) in enumerate((y * 200 - 400, x * 200 - 1400) for y in range(15) for x in range(14)) if k % 7]
    part = sum(max(0, min(x + 200, 0) - max(x, -700)) / 200 for x, _ in res if x < 0) / sum(x < 0 for x, _ in res)
    assert got["t"].population == round(1000 * part + 500)
    assert got["s"].poverty_rate == pytest.approx(30.0) and got["s"].median_income == pytest.approx(10000.0)
    assert (home / "out/d.shp").exists() and "prop_val_mean" in (home / "out/d.csv").read_text()


def test_force_mains_from_files(spark, home):
    a, b = NODES[1], NODES[8]
    m = spark.createDataFrame([("F1", "Active", "CITY", "12", a[0] + 3.0, a[1] + 0.0, b[0] + 0.0, b[1] + 2.0), ("F2", "Gone", "CITY", "12", 0.0, 0.0, 1.0, 1.0)], "FACILITYID string, LIFECYCLES string, OWNER string, DIAMETER string, sx double, sy double, ex double, ey double").coalesce(1)
    shapefile.write_shapefile(m.withColumn("geom", shapes.segment()).drop("sx", "sy", "ex", "ey"), str(home / "fm.shp"), "PROJCS[]")
    cfg = config.load_config(str(home / "settings.yaml"))
    cfg["inputs"]["force_main_shapefile"] = str(home / "fm.shp")
    out = project.run_force_mains(spark, cfg, write=True)
    assert [(r.reason, r.n) for r in out["dropped"].collect()] == [("lifecycle not in ['Active']", 1)]
    # node 1 is the outlet, so a main there leaves it; node 8 is a head, where flow passes on
    assert [(r.verdict, r.n_pipes) for r in out["verdicts"].collect()] == [("resolved", 1)]
    assert len((home / "out/fe.csv").read_text().strip().splitlines()) == 2
    wired = cfg | {"inputs": cfg["inputs"] | {"force_main_edges": str(home / "out/fe.csv")}}
    assert project.load_network(spark, wired)["edges"].where("pidx IS NULL").count() == 1
    assert layers.read_layer(spark, str(home / "out/fr.shp"), declared="working").count() == out["open"].count()
    with pytest.raises(ValueError, match="isn't set"):
        project.run_force_mains(spark, config.load_config(str(home / "settings.yaml")))
