"""From a force-main layer to directed links and a list of questions, for all mains at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import facilities as fac
from tributary.operators import pressure
from tributary.session import materialize


@dataclass(frozen=True)
class Settings:
    """Distances in feet; the defaults are the published ones."""

    tol: float = 1.0
    snap: float = 10.0
    review: float = 500.0
    stub_diameter: float = 4.0
    stub_length: float = 50.0
    stub_gap: float = 10.0
    plant_tol: float = 1000.0
    station_tol: float = 200.0
    ruling_tol: float = 25.0
    stub_main: float = 25.0
    prefilled_gap: float = 25.0
    auto_accept: float = 0.1


def review(mains: DataFrame, nodes: DataFrame, edges: DataFrame, joins: DataFrame | None = None, facilities: DataFrame | None = None, rulings: DataFrame | None = None, prior: DataFrame | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """mains, termini, verdicts, matches, flags, open, settled, links and skipped.

    mains: (pidx, fid, diameter, length_ft, sx, sy, ex, ey); nodes and edges are those
    of the gravity network without links. Stubs go and the rest is clustered again;
    free ends and station outlets are classified by the nearest gravity node; then
    facilities speak, then rulings, which outrank them, and a discharge by a short main
    beside a station becomes a candidate. Verdicts, questions and links follow.
    """
    s = settings
    tagged, clusters = pressure.topology(mains, s.tol, joins)
    near = pressure.at_gravity(clusters, nodes, edges, s.review).select("comp", "node", "gap")
    stubs = pressure.small_stubs(tagged, near, s.stub_diameter, s.stub_length, s.stub_gap)
    kept = materialize(pressure.prune(tagged, stubs), "kept")
    tagged, clusters = pressure.topology(kept, s.tol, joins)
    ends = clusters.join(pressure.termini(tagged), "node", "left_semi")
    if facilities is not None:
        more = fac.station_junctions(facilities, clusters, ends, s.station_tol).select("node").distinct()
        ends = ends.unionByName(clusters.join(more, "node", "left_semi").join(ends.select("node"), "node", "left_anti"))
    term = materialize(pressure.classify(pressure.at_gravity(ends, nodes, edges, s.review), s.snap, s.review), "termini")
    out: dict[str, DataFrame] = {}
    if facilities is not None:
        out["matches"] = materialize(fac.match(facilities, term, s.plant_tol, s.station_tol), "matches")
        term = fac.stamp(term, out["matches"])
        out["flags"] = fac.flags(out["matches"], term)
    if rulings is not None:
        term = fac.overrule(term, rulings, s.ruling_tol)
    if facilities is not None:
        term = fac.station_adjacent(term, tagged, facilities, s.stub_main, s.station_tol)
    term = materialize(term, "termini")
    verdict_rows = materialize(pressure.verdicts(term, tagged), "verdicts")
    rows = pressure.review_rows(term, verdict_rows, tagged, s.prefilled_gap)
    open_, settled = pressure.settle(rows, prior, s.auto_accept)
    links, skipped = pressure.main_links(term, verdict_rows, pressure.end_names(tagged))
    return out | {"mains": tagged, "termini": term, "verdicts": verdict_rows, "open": open_, "settled": settled, "links": links, "skipped": skipped}


def to_wire(links: DataFrame) -> DataFrame:
    """Links as facilities.wire() takes them."""
    return links.select("comp", F.col("wetwell_x").alias("wet_x"), F.col("wetwell_y").alias("wet_y"), F.col("discharge_x").alias("out_x"), F.col("discharge_y").alias("out_y"))
