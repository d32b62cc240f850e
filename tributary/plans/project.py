"""Whole runs from a settings file: catchments, network checks, force mains and site records, from layers to written results.

A run returns its tables; with ``write`` they are also written where the settings'
outputs say, on the driver's disk, for people who open them.
"""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import shapes
from tributary.operators import demographics, membership, polygons, reports, review
from tributary.operators.snap import dense_ids
from tributary.plans import delineate, force_mains, network, network_qa
from tributary.session import materialize
from tributary.sources import census_cache, decisions, gpkg, layers, mains, shapefile
from tributary.sources import facilities as facility_lists


def _get(cfg: dict, part: str, key: str, default=None):
    value = (cfg.get(part) or {}).get(key)
    return default if value is None else value


def network_settings(cfg: dict) -> network.Settings:
    p = lambda key, default: float(_get(cfg, "parameters", key, default))
    return network.Settings(
        p("midspan_interior_tol_ft", 2), p("midspan_endpoint_exclusion_ft", 10), p("pipe_edit_locate_tol_ft", 50), p("node_snap_tolerance_ft", 1), p("snap_gap_search_radius_ft", 10), p("force_main_edge_snap_tol_ft", 10)
    )


def delineation_settings(cfg: dict) -> delineate.Settings:
    p = lambda key, default: float(_get(cfg, "parameters", key, default))
    s = delineate.Settings()
    return replace(
        s, snap_tol=p("node_snap_tolerance_ft", 1), end_radius=p("snap_gap_search_radius_ft", 10), target_radius=p("manhole_snap_distance_ft", 50), selection_radius=p("selection_radius_ft", 50),
        dangling_edges=int(p("competing_ignore_dangling_max_pipes", 3)), border_ring=p("border_ring_ft", 75), border_expose=p("border_min_expose", 0.1), nick_share=p("border_min_cover_frac", s.nick_share),
        nick_area=p("border_min_cover_area_ft2", s.nick_area), split_radius=p("split_near_radius_ft", 100), split_step=p("split_densify_step_ft", 3), assign_radius=p("competing_assign_buffer_ft", 50),
        method=_get(cfg, "parameters", "boundary_method", "delaunay"), edge=p("delaunay_max_edge_ft", 500), close=p("close_radius_ft", 150), grow_radius=p("fill_uncovered_buffer_ft", 100) if _get(cfg, "parameters", "fill_uncovered_enabled", True) else 0.0,
        seam_tol=p("seam_align_tol_ft", 50), bridge_gap=p("bridge_parts_max_gap_ft", 800), split_overlaps=bool(_get(cfg, "parameters", "resolve_overlaps_enabled", False)),
        ribbon=p("pipe_buffer_distance_ft", 50), most_acres=p("large_catchment_threshold_acres", 500), least_coverage=p("low_population_match_min_buffer_coverage", 0.5),
    )


def _decided(spark: SparkSession, cfg: dict) -> DataFrame | None:
    path = _get(cfg, "inputs", "qa_review_decisions")
    return decisions.read_decisions(spark, path) if path and mains._exists(spark, path) else None


def load_lines(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(pipes, manholes) of the settings' layers."""
    pipes = layers.load_pipes(layers.read_layer(spark, cfg["inputs"]["gravity_main_shapefile"], declared=_get(cfg, "parameters", "crs"), what="gravity mains"))
    holes = layers.load_manholes(layers.read_layer(spark, cfg["inputs"]["manholes_shapefile"], declared=_get(cfg, "parameters", "crs"), what="manholes"))
    return materialize(pipes, "pipes"), materialize(holes, "manholes")


def load_network(spark: SparkSession, cfg: dict, wired: bool = True) -> dict[str, DataFrame]:
    """The network of the settings (plans.network) and its manholes; pipes have geom, and their source's attributes by their first line's number.

    Links are wired in if the settings name any and ``wired`` is true.
    """
    pipes, holes = load_lines(spark, cfg)
    s = network_settings(cfg)
    if not _get(cfg, "parameters", "split_midspan_junctions", True):
        s = replace(s, interior_tol=0.0)
    decided = _decided(spark, cfg)
    if decided is not None and not _get(cfg, "parameters", "apply_pipe_edits", True):
        decided = decided.where("decision NOT IN ('flip', 'delete', 'extend')")
    links = mains.read_links(spark, _get(cfg, "inputs", "force_main_edges")) if wired else None
    net = network.build_network(pipes.select("pidx", "fid", "coords"), holes, decided, links, s)
    first = net["split_log"].select(F.col("new_pidx").alias("pidx"), F.col("pidx").alias("source_pidx"))
    lines = net["pipes"].join(first, "pidx", "left").withColumn("source_pidx", F.coalesce("source_pidx", "pidx"))
    lines = lines.join(pipes.drop("fid", "coords", "geom").withColumnRenamed("pidx", "source_pidx"), "source_pidx", "left")
    net["pipes"] = materialize(lines.withColumn("geom", shapes.line("coords")), "lines")
    return net | {"manholes": holes}


def run_catchments(spark: SparkSession, cfg: dict, sites_file: str | None = None, ids: str | None = None, write: bool = False) -> dict[str, DataFrame]:
    """Catchments of the listed sites, or of the settings' target: plans.delineate's tables, competing flags, and the labels of the sites."""
    net = load_network(spark, cfg)
    s = delineation_settings(cfg)
    listed = layers.site_list(spark, sites_file, ids, cfg["inputs"])
    where = delineate.locate_targets(listed, net["manholes"], float(_get(cfg, "parameters", "manhole_node_snap_ft", 5)), s.target_radius)
    units = layers.load_units(spark, "parcels", cfg["inputs"]["population_units_shapefile"], declared=_get(cfg, "inputs", "population_units_crs"), explode=bool(_get(cfg, "parameters", "explode_multipart_units", True)))
    name = layers.unit_id(units)
    units = materialize(units.select((F.col(name) if name else F.col("fidx")).cast("string").alias("uid"), "geom"), "units")
    blocks = None
    if s.method in ("hybrid", "block_fill"):
        raw = layers.load_census_blocks(spark, _get(cfg, "inputs", "census_blocks_shapefile"), _get(cfg, "inputs", "census_blocks_county_fips"), _get(cfg, "inputs", "census_blocks_crs"))
        blocks = raw.select(F.col("GEOID20").cast("string").alias("block"), "geom")
    out = delineate.delineate(net["pipes"].select("pidx", "fid", "geom").where("geom IS NOT NULL"), where, units, blocks, s, network=net)
    names = listed.select("site", F.col("label").alias("name"))
    out |= {"listed": listed, "competing": membership.competing_flags(out["units"], net["pipes"].select("pidx", "fid")), "decisions": membership.decisions(out["units"]), "owners": membership.owners(out["units"], out["trace"], names), "network": net["edges"]}
    if write:
        write_catchments(cfg, out, net, s)
    return out


def write_catchments(cfg: dict, out: dict[str, DataFrame], net: dict[str, DataFrame], s: delineate.Settings) -> None:
    """The boundary, its unfilled units and the traced pipes as shapefiles, flags as CSV and as layers in place of those of an earlier run."""
    path = lambda key: _out(cfg, key)
    final = reports.boundary_frame(out["boundaries"], s.method)
    shapefile.write_shapefile(final, path("output_polygon"))
    if (cfg.get("outputs") or {}).get("sewershed_parcels"):
        kept = out["units"].where("NOT cp_excl AND cp_asgn <> 'exclude' AND kept IS NOT NULL").select("site", F.col("kept").alias("geom"))
        shapefile.write_shapefile(reports.catchment_frame(out["sites"], kept, out["trace"], polygons.dissolve(kept, "site")), path("sewershed_parcels"))
    if (cfg.get("outputs") or {}).get("debug_upstream_pipes"):
        shapefile.write_shapefile(reports.trace_frame(net["pipes"].select("pidx", "fid", "geom"), out["trace"]), path("debug_upstream_pipes"))
    flags = out["flags"].withColumn("severity", F.when(F.col("flag_type") == "no_upstream_found", "review_required").otherwise("warning"))
    every = flags.select("site", F.lit(None).cast("string").alias("uid"), "flag_type", "severity", F.lit("").alias("description")).unionByName(out["competing"].select("site", "uid", "flag_type", "severity", "description"))
    layers.write_csv(every, path("flags_report"))
    if (cfg.get("outputs") or {}).get("qc_flags_gpkg"):
        gpkg.clear_layers(path("qc_flags_gpkg"), "delin_")
        gpkg.write_flags(reports.normalise(None, out["competing"]), path("qc_flags_gpkg"))


def _out(cfg: dict, key: str) -> str:
    path = cfg["outputs"][key]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return path


def run_checks(spark: SparkSession, cfg: dict, write: bool = False) -> dict[str, DataFrame]:
    """All network checks, without links on purpose: flags with a reviewer's status, members, pipes and suspects."""
    net = load_network(spark, cfg, wired=False)
    decided = _decided(spark, cfg)
    p = lambda key, default: _get(cfg, "parameters", key, default)
    s = network_qa.Settings(float(p("node_snap_tolerance_ft", 1)), float(p("snap_gap_search_radius_ft", 10)), float(p("manhole_node_snap_ft", 5)), int(p("max_mappable_cycle_nodes", 10)), int(p("disconnected_component_max_nodes", 50)))
    ends = network.line_ends(net["pipes"]).drop("fid")
    pipes = materialize(net["pipes"].drop("sx", "sy", "ex", "ey").join(ends, "pidx"), "pipes")
    manual = decisions.manual_snaps(decided) if decided is not None else None
    out = network_qa.run_qa(pipes, net["manholes"].select("fid", "x", "y"), s, manual, net["split_log"], net["edit_log"])
    named = out["members"].join(pipes.select("pidx", F.coalesce("fid", F.lit("?")).alias("fid")), "pidx").groupBy("flag").agg(F.array_join(F.array_sort(F.collect_set("fid")), " / ").alias("pipe_id"))
    lone = F.when(F.col("flag_type") == "isolated_manhole", F.regexp_replace("flag", "^isolated_", ""))
    flags = out["flags"].join(named, "flag", "left").withColumn("pipe_id", F.coalesce("pipe_id", lone))
    flags = materialize(flags.withColumn("flag_id", F.xxhash64("flag").bitwiseAND(F.lit((1 << 61) - 1))), "flags")
    if decided is not None:
        status = review.apply_review(flags.select("flag_id", "flag_type", "pipe_id", "x", "y"), decided, float(p("review_match_radius_ft", 50))).select("flag_id", "status")
    else:
        status = flags.select("flag_id", F.lit("open").alias("status"))
    flags = materialize(flags.join(status, "flag_id").drop("flag_id"), "reviewed")
    out = out | {"flags": flags, "counts": reports.flag_counts(flags), "suspects": network_qa.suspects(out["members"], pipes)}
    if write:
        layers.write_csv(flags.drop("geom") if "geom" in flags.columns else flags, _out(cfg, "flags_report"), "flag")
        if (cfg.get("outputs") or {}).get("large_cycle_suspects"):
            layers.write_csv(out["suspects"].withColumn("reasons", F.array_join("reasons", "; ")), _out(cfg, "large_cycle_suspects"), "ord")
        if (cfg.get("outputs") or {}).get("qc_flags_gpkg"):
            point = shapes.parse(F.concat(F.lit("POINT("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")")))
            gpkg.clear_layers(_out(cfg, "qc_flags_gpkg"), "net_")
            gpkg.write_flags(reports.normalise(flags.where("x IS NOT NULL").withColumn("geom", point), None), _out(cfg, "qc_flags_gpkg"))
    return out


def run_force_mains(spark: SparkSession, cfg: dict, patterns: list[tuple[str, str]] | None = None, write: bool = False) -> dict[str, DataFrame]:
    """plans.force_mains over the settings' force-main layer and lists, and what its rules drop."""
    p = lambda key, default: float(_get(cfg, "parameters", key, default))
    path = _get(cfg, "inputs", "force_main_shapefile")
    if not path:
        raise ValueError("inputs.force_main_shapefile isn't set")
    if not mains._exists(spark, path):
        raise FileNotFoundError(f"no force-main layer at {path}")
    own = _get(cfg, "parameters", "force_main_include", {})
    rules = replace(mains.Rules(), **{k: tuple(map(str, v)) if isinstance(v, list) else v for k, v in own.items()})
    layer = layers.read_layer(spark, path, declared=_get(cfg, "parameters", "crs"), what="force mains")
    for name in ("LIFECYCLES", "OWNER", "DIAMETER", "COMMENT", "FACILITYID"):
        layer = layer if name in layer.columns else layer.withColumn(name, F.lit(None).cast("string"))
    kept, dropped = mains.load_mains(layer, rules)
    kept = kept.select(F.col("fidx").alias("old"), F.col("FACILITYID").cast("string").alias("fid"), F.col("DIAMETER").cast("string").try_cast("double").alias("diameter"), shapes.coords("geom").alias("coords"), shapes.measure("length", "geom").alias("length_ft"))
    kept = materialize(kept.where("size(coords) > 1"), "mains")
    kept = kept.join(dense_ids(kept.select("old"), "old"), "old").withColumnRenamed("node_id", "pidx")
    ends = network.line_ends(kept).join(kept.select("pidx", "diameter", "length_ft"), "pidx")
    net = load_network(spark, cfg, wired=False)
    s = force_mains.Settings(
        tol=p("force_main_component_tol_ft", 1), snap=p("force_main_snap_tolerance_ft", 10), review=p("force_main_review_radius_ft", 500), plant_tol=p("terminal_facility_plant_tol_ft", 1000), station_tol=p("terminal_facility_station_tol_ft", 200),
        ruling_tol=p("force_main_direction_override_tol_ft", 25), stub_main=p("force_main_station_adjacent_max_pipe_ft", 25), prefilled_gap=p("force_main_max_prefilled_radius_gap_ft", 25), auto_accept=p("force_main_auto_accept_ft", 0.1),
    )
    joins, rulings = mains.read_joins(spark, _get(cfg, "inputs", "force_main_joins")), mains.read_rulings(spark, _get(cfg, "inputs", "force_main_direction_overrides"))
    listed = facility_lists.read_facilities(spark, _get(cfg, "inputs", "terminal_facilities"), patterns or [("plant", "plant")])
    has = lambda d: d if d.limit(1).count() else None
    out = force_mains.review(ends, net["nodes"], net["edges"], has(joins), has(listed), has(rulings), mains.read_prior(spark, _get(cfg, "inputs", "force_main_decisions")), s)
    out["dropped"] = dropped
    if write:
        for key, name in (("force_main_review", "open"), ("force_main_settled", "settled"), ("force_main_edges", "links")):
            if (cfg.get("outputs") or {}).get(key):
                layers.write_csv(out[name].withColumnRenamed("comp", "comp_id"), _out(cfg, key), "ord" if "ord" in out[name].columns else "comp_id")
        if (cfg.get("outputs") or {}).get("force_main_review_shp"):
            shapefile.write_shapefile(review_points(out["open"]), _out(cfg, "force_main_review_shp"))
    return out


#: Names of ten letters for the questions' columns.
REVIEW_NAMES = {
    "pipe_id": "FM_ID", "fm_end": "FM_END", "flag_type": "ASKING", "dist_ft": "GAP_FT", "comp": "SYSTEM", "comp_verdict": "VERDICT", "classification": "READS_AS", "gravity_node": "GRAV_NODE", "gravity_role": "GRAV_ROLE", "comment": "COMMENT",
}


def review_points(rows: DataFrame) -> DataFrame:
    """The questions that have a place as points on the main's end, with names of ten letters and comments of at most 254."""
    point = shapes.parse(F.concat(F.lit("POINT("), F.col("fm_x").cast("string"), F.lit(" "), F.col("fm_y").cast("string"), F.lit(")")))
    d = rows.where("fm_x IS NOT NULL").withColumns({"geom": point, "comment": F.substring("comment", 1, 254)})
    return d.select(*[F.col(k).alias(n) for k, n in REVIEW_NAMES.items()], "geom")


def run_demographics(spark: SparkSession, cfg: dict, write: bool = False) -> DataFrame:
    """The record of every final boundary, from the cached census tables."""
    d = cfg["demographics"]
    base = Path(cfg["_base_dir"])
    sites = layers.load_boundaries(spark, str(base / d["boundary_gpkg"]), d["boundary_layer"], d["site_id_field"], d.get("tract_field"))
    units = layers.load_population_units(spark, cfg["inputs"]["population_units_shapefile"], _get(cfg, "inputs", "population_units_crs"))
    spec = demographics.build_spec(d)
    parcels = materialize(units.select(F.monotonically_increasing_id().alias("pid"), F.col(spec.value).alias(spec.value), F.col(d.get("land_use_desc_column", "PARUSEDESC")).cast("string").alias("use"), "geom"), "parcels")
    homes = parcels.where(demographics.residential("use", tuple(d.get("residential_desc_prefixes", ())), tuple(d.get("residential_desc_contains", ()))))
    raw = layers.load_census_blocks(spark, _get(cfg, "inputs", "census_blocks_shapefile"), _get(cfg, "inputs", "census_blocks_county_fips"), _get(cfg, "inputs", "census_blocks_crs"))
    manifest = (cfg.get("census") or {}).get("manifest_path", "data/census/manifest.json")
    tables = [census_cache.read_cached(spark, str(base), kind, manifest) for kind in ("decennial", "acs5")]
    blocks, groups = demographics.with_counts(raw.select(F.col("GEOID20").alias("geoid"), "geom"), *tables)
    out = demographics.site_records(materialize(sites, "sites"), materialize(blocks, "blocks"), materialize(groups, "groups"), homes, parcels, spec)
    if write:
        kind = dict(out.dtypes)
        layers.write_csv(out.select(*[F.bround(c, 2).alias(c) if kind[c] == "double" else F.col(c) for c in out.columns]), _out(cfg, "demographics_csv"), "site")
        shapefile.write_shapefile(demographics.short_record(out).join(sites.select("site", "geom"), "site"), _out(cfg, "demographics_shp"))
    return out
