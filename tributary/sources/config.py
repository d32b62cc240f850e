"""Run settings from YAML: every error is collected before one is raised."""

from __future__ import annotations

from pathlib import Path

import yaml

from tributary.operators.polygons import METHODS

#: The settings that must be there, and those that are one of a few.
LAYERS = ("gravity_main_shapefile", "manholes_shapefile", "population_units_shapefile")
PARAMETERS = (
    "crs", "node_snap_tolerance_ft", "manhole_snap_distance_ft", "pipe_buffer_distance_ft", "selection_radius_ft", "large_catchment_threshold_acres",
    "flag_map_context_buffer_ft", "pdf_flag_types", "max_mappable_cycle_nodes", "boundary_method", "close_radius_ft", "basemap_style",
)
OUTPUTS = ("output_polygon", "flags_report", "flag_maps_pdf")
CHOICES = {"boundary_method": METHODS, "basemap_style": ("satellite", "street")}
OTHER_INPUTS = (
    "census_blocks_shapefile", "validation_truth_polygons", "validation_points", "qa_review_decisions", "force_main_shapefile", "force_main_joins",
    "force_main_decisions", "terminal_facilities", "force_main_edges", "force_main_direction_overrides",
)


def check(cfg: dict, base: Path) -> list[str]:
    """All that is wrong with settings beside ``base``."""
    inputs, parameters, outputs = (cfg.get(part) or {} for part in ("inputs", "parameters", "outputs"))
    wrong = [f"inputs.{key} is missing" for key in LAYERS if not inputs.get(key)]
    wrong += [f"inputs.{key}: no such file, {inputs[key]}" for key in LAYERS if inputs.get(key) and "://" not in str(inputs[key]) and not (base / inputs[key]).exists()]
    manhole, place = inputs.get("manhole_id"), inputs.get("manhole_coordinate")
    if bool(manhole) == (place is not None):
        wrong.append("inputs: one of manhole_id and manhole_coordinate is needed, not both")
    if place is not None and not (isinstance(place, list) and len(place) == 2):
        wrong.append("inputs.manhole_coordinate must be [x, y]")
    wrong += [f"parameters.{key} is missing" for key in PARAMETERS if key not in parameters]
    wrong += [f"parameters.{key}: {parameters[key]!r} is none of {sorted(few)}" for key, few in CHOICES.items() if parameters.get(key) is not None and parameters[key] not in few]
    for key, value in parameters.items():
        if key.endswith(("_ft", "_tol", "_radius")) and value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0):
            wrong.append(f"parameters.{key} must be a number of at least 0")
    return wrong + [f"outputs.{key} is missing" for key in OUTPUTS if key not in outputs]


def load_config(path: str) -> dict:
    """The settings with paths resolved beside the file; ValueError lists all that is wrong."""
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"no settings at {path}")
    cfg = yaml.safe_load(file.read_text()) or {}
    base = file.resolve().parent
    if wrong := check(cfg, base):
        raise ValueError("; ".join(wrong))
    at = lambda v: v if "://" in str(v) else str((base / v).resolve())
    cfg["inputs"] = {k: at(v) if k in (*LAYERS, *OTHER_INPUTS) and v else v for k, v in cfg["inputs"].items()}
    cfg["outputs"] = {k: at(v) if isinstance(v, str) else v for k, v in cfg["outputs"].items()}
    cfg["_base_dir"] = str(base)
    return cfg
