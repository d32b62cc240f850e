"""Facility lists: a sheet or CSV with a name and coordinates that a person pasted."""

from __future__ import annotations

import csv
import io
import math
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from tributary.functions import geo
from tributary.operators.quality import facility_role
from tributary.sources.decisions import decode

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(raw: bytes) -> list[list[str]]:
    """The text of the first sheet of a workbook, cell by cell; gaps are empty."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    words: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        words = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
    first = min((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
    rows = []
    for row in ElementTree.fromstring(book.read(first)).iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.findall("m:c", _NS)):
            at = k
            if c.get("r"):
                at = 0
                for letter in re.match(r"[A-Z]+", c.get("r")).group():
                    at = at * 26 + ord(letter) - 64
                at -= 1
            v = c.find("m:v", _NS)
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else "" if v is None else v.text or ""
            cells[at] = words[int(text)] if c.get("t") == "s" and text else text
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def _degrees(*texts: str) -> list[float] | None:
    """Two finite numbers, or None."""
    try:
        both = [float(t) for t in texts]
    except ValueError:
        return None
    return both if len(both) == 2 and all(map(math.isfinite, both)) else None


def parse_facilities(rows: list[list[str]]) -> list[tuple[int, str, float, float]]:
    """(fac, name, lat, lon) of rows under a header with Name and either Coords ("lat, lon") or lat and lon (or long).

    ValueError for missing columns, coordinates that can't be read, and pairs that
    look exchanged: a latitude beyond 90, or each one larger than its longitude.
    """
    head = {h.strip().lower(): i for i, h in enumerate(rows[0] if rows else [])}
    lon = head.get("lon", head.get("long"))
    if "name" not in head or not ("coords" in head or ("lat" in head and lon is not None)):
        raise ValueError("a facility list needs Name, and Coords or lat and lon")
    columns = [head["lat"], lon] if "lat" in head and lon is not None else [head["coords"]]
    filled = [row + [""] * len(head) for row in rows[1:] if any(c.strip() for c in row)]
    places = [_degrees(*(part for c in columns for part in row[c].split(","))) for row in filled]
    names = [row[head["name"]] for row in filled]
    for name, place in zip(names, places):
        if place is None or abs(place[0]) > 90:
            raise ValueError(f"facility {name!r}: " + ("coordinates can't be read" if place is None else "latitude beyond 90, is it lon, lat?"))
    if places and min(abs(lat) - abs(long) for lat, long in places) > 0:
        raise ValueError("every latitude is larger than its longitude, is it lon, lat?")
    return [(n, name, *place) for n, (name, place) in enumerate(zip(names, places))]


def read_facilities(spark: SparkSession, path: str | None, patterns: list[tuple[str, str]]) -> DataFrame:
    """(fac, name, role, x, y) in the working projection; no path gives no rows."""
    rows: list[tuple[int, str, float, float]] = []
    if path:
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
        table = sheet_rows(raw) if path.lower().endswith(".xlsx") else list(csv.reader(io.StringIO(decode(raw))))
        rows = parse_facilities(table)
    d = spark.createDataFrame(rows, "fac long, name string, lat double, lon double")
    x, y = geo.lcc("lat", "lon")
    return d.select("fac", "name", facility_role("name", patterns).alias("role"), x.alias("x"), y.alias("y"))
