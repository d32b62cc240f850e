"""Reviewers' tables: read as text, checked row by row, errors with the line they are on."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The verbs a decision may have.
VERBS = ("resolved", "keep", "snap", "flip", "delete", "extend", "dismiss")
_SCHEMA = "ord long, flag_type string, pipe_id string, x double, y double, decision string, radius_ft double, target string, comment string"


def decode(raw: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252")


def _number(text: str | None, line: int, name: str) -> float | None:
    text = (text or "").strip()
    try:
        return float(text) if text else None
    except ValueError:
        raise ValueError(f"line {line}: {name} is not a number: {text!r}") from None


def parse_decisions(text: str) -> list[tuple]:
    """Rows with a decision; blank ones are skipped, unknown verbs raise with their line."""
    out = []
    for line, row in enumerate(csv.DictReader(io.StringIO(text)), start=2):
        row = {(k or "").strip().lower(): (v or "").strip() for k, v in row.items() if not isinstance(v, list)}
        verb = row.get("decision", "").lower()
        if not verb:
            continue
        if verb not in VERBS:
            raise ValueError(f"line {line}: unknown decision {verb!r}")
        x, y, radius = (_number(row.get(c), line, c) for c in ("x", "y", "radius_ft"))
        if verb == "snap" and (x is None or y is None):
            raise ValueError(f"line {line}: a snap needs x and y")
        out.append((len(out), row.get("flag_type") or None, row.get("pipe_id") or None, x, y, verb, radius, row.get("target") or None, row.get("comment") or None))
    return out


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decisions of a CSV file (a hand-written list, parsed on the driver) in file order."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    return spark.createDataFrame(parse_decisions(decode(bytes(raw.content))) if raw else [], _SCHEMA)


def manual_snaps(decisions: DataFrame) -> DataFrame:
    """x, y, radius of snap decisions; a blank or zero radius is 5."""
    return decisions.where("decision = 'snap'").select("x", "y", F.coalesce(F.nullif("radius_ft", F.lit(0.0)), F.lit(5.0)).alias("radius"))


def pipe_edits(decisions: DataFrame) -> DataFrame:
    return decisions.where("decision IN ('flip', 'delete', 'extend')")
