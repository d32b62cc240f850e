"""Census tables kept beside a project: a manifest, one CSV for each kind, and when to fetch them again.

Fetching itself is passed in, so that nothing here needs a network. The manifest is
a small JSON file on the driver; tables are read by Spark.
"""

from __future__ import annotations

import csv
import datetime
import io
import json
from collections.abc import Callable, Collection
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The geography and the key of each kind of table.
KINDS = {"decennial": ("block", "GEOID20"), "acs5": ("block group", "GEOID")}


def read_manifest(path: str | Path) -> dict:
    """The manifest, empty where there is no file yet."""
    file = Path(path)
    return json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}


def is_stale(entry: dict | None, vintage: int, variables: Collection[str], data: Path) -> bool:
    """True without a record or its file, for another vintage, or for another set of variables in any order."""
    return not entry or not data.exists() or (entry.get("vintage"), set(entry.get("variables", ()))) != (vintage, set(variables))


def resolve_variables(wanted: list[str], published: Collection[str], resolver: Callable[[list[str], set[str]], dict[str, str] | None] | None = None) -> tuple[list[str], dict[str, str]]:
    """(the codes to fetch, what was replaced).

    A margin of error is published with its estimate (code ending in M for E). The
    resolver may name replacements for missing codes; one counts if it is
    published. ValueError if a code is still missing.
    """
    known = set(published)
    known |= {f"{code[:-1]}M" for code in published if "_" in code and code.endswith("E")}
    missing = [code for code in wanted if code not in known]
    offered = (resolver(missing, known) or {}) if missing and resolver else {}
    swaps = {old: new for old, new in offered.items() if old in missing and new in known}
    if left := [code for code in missing if code not in swaps]:
        raise ValueError(f"variables that the vintage doesn't publish: {left}")
    return [swaps.get(code, code) for code in wanted], swaps


def refresh(base: str, kind: str, vintage: int, variables: list[str], published: Collection[str], fetch: Callable[[list[str]], list[dict]], resolver=None, force: bool = False, manifest: str = "data/census/manifest.json") -> bool:
    """Fetch a kind's table (rows as dicts with the key as text) if it is stale or ``force``; True if it was fetched.

    The manifest records the wanted and the fetched codes, and a path relative to base.
    """
    root = Path(base)
    where = root / manifest
    book = read_manifest(where)
    data = root / book.get(kind, {}).get("path", str(Path(manifest).parent / f"{kind}_{vintage}.csv"))
    if not force and not is_stale(book.get(kind), vintage, variables, data):
        return False
    codes, swaps = resolve_variables(variables, published, resolver)
    rows = fetch(codes)
    geography, key = KINDS[kind]
    data = where.parent / f"{kind}_{vintage}.csv"
    data.parent.mkdir(parents=True, exist_ok=True)
    columns = [key, *codes]
    lines = [",".join("" if row.get(c) is None else str(row[c]) for c in columns) for row in rows]
    data.write_text("\n".join([",".join(columns), *lines]) + "\n", encoding="utf-8")
    book[kind] = {
        "vintage": vintage, "geography": geography, "variables": variables, "effective_variables": codes, "remap": swaps,
        "download_date": datetime.date.today().isoformat(), "rows": len(rows), "path": data.relative_to(root).as_posix(),
    }
    where.write_text(json.dumps(book, indent=2), encoding="utf-8")
    return True


def read_cached(spark: SparkSession, base: str, kind: str, manifest: str = "data/census/manifest.json") -> DataFrame:
    """A kind's cached table: the key as text, everything else as numbers, text that is none NULL. FileNotFoundError if there is none."""
    book = read_manifest(Path(base) / manifest)
    if kind not in book:
        raise FileNotFoundError(f"no cached {kind} table")
    # one county's table, on the driver's disk; executors needn't see it
    header, *rows = csv.reader(io.StringIO((Path(base) / book[kind]["path"]).read_text(encoding="utf-8")))
    d = spark.createDataFrame([tuple(x or None for x in r) for r in rows if r], ", ".join(f"`{c}` string" for c in header))
    number = "bigint" if kind == "decennial" else "double"
    return d.selectExpr(*[f"`{c}`" if c in ("GEOID", "GEOID20", "NAME") else f"try_cast(`{c}` AS {number}) AS `{c}`" for c in d.columns])
