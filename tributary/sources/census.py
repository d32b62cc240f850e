"""Census requests and their responses (a header row and data rows of text) as tables.

Nothing here opens a connection by itself: ``get`` does, a function of an address and
its parameters that returns (status, the address that answered, text).
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: estimates at or below it stand for missing.
SENTINEL = -1e8
#: Where the tables and their catalogue are, and what the service answers without a key.
ROOT = "https://api.census.gov/data"
CATALOG = f"{ROOT}.json"
NO_KEY = "missing_key"

Get = Callable[[str, list[tuple[str, str]]], tuple[int, str, str]]


class CensusError(RuntimeError):
    """The service can't be asked, or its answer can't be used."""


def http_get(url: str, params: list[tuple[str, str]]) -> tuple[int, str, str]:
    """A plain request; an answer with an error status is an answer."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    try:
        with urllib.request.urlopen(full, timeout=180) as r:
            return r.status, r.geturl(), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.geturl() or full, e.read().decode("utf-8", "replace")


def resolve_key(settings: dict | None = None, env: dict[str, str] | None = None) -> str:
    """The key from CENSUS_API_KEY, else from .census_api_key beside the settings, else from the settings; CensusError if there is none."""
    found = (os.environ if env is None else env).get("CENSUS_API_KEY", "").strip()
    base = (settings or {}).get("_base_dir")
    file = Path(base) / ".census_api_key" if base else None
    if not found and file and file.exists():
        found = file.read_text(encoding="utf-8").strip()
    found = found or str(((settings or {}).get("inputs") or {}).get("census_api_key") or "").strip()
    if not found:
        raise CensusError("no census key: set CENSUS_API_KEY, write it to .census_api_key, or set inputs.census_api_key")
    return found


def _answer(get: Get, url: str, params: list[tuple[str, str]] | None = None) -> object:
    status, where, text = get(url, params or [])
    shown = [(k, v) for k, v in params or [] if k != "key"]
    if NO_KEY in where:
        raise CensusError("the service doesn't take the key")
    if status != 200:
        raise CensusError(f"status {status} for {url} {shown}: {text[:300]}")
    try:
        return json.loads(text)
    except ValueError:
        raise CensusError(f"no table for {url} {shown}, is a code or place wrong? {text[:200]}") from None


def latest_vintage(dataset: list[str], get: Get = http_get) -> int:
    """The newest year of a family of tables, as ["acs", "acs5"]."""
    years = [d["c_vintage"] for d in _answer(get, CATALOG)["dataset"] if d.get("c_dataset") == dataset and d.get("c_vintage")]
    if not years:
        raise CensusError(f"the catalogue has no year of {dataset}")
    return max(years)


def available_variables(vintage: int, dataset: str, get: Get = http_get) -> set[str]:
    """The codes that a year's table publishes, as of "acs/acs5"."""
    return set(_answer(get, f"{ROOT}/{vintage}/{dataset}/variables.json").get("variables", {}))


#: The table, its geography and the parts of its key, by kind.
TABLES = {"decennial": ("dec/pl", "block", ("state", "county", "tract", "block"), "GEOID20"), "acs5": ("acs/acs5", "block group", ("state", "county", "tract", "block group"), "GEOID")}


def request(kind: str, vintage: int, variables: list[str], state: str, county: str, key: str) -> tuple[str, list[tuple[str, str]]]:
    """The address and parameters for one county."""
    path, place, _, _ = TABLES[kind]
    return f"{ROOT}/{vintage}/{path}", [("get", ",".join(variables)), ("for", f"{place}:*"), ("in", f"state:{state}"), ("in", f"county:{county}"), ("in", "tract:*"), ("key", key)]


def fetch(spark: SparkSession, kind: str, vintage: int, variables: list[str], counties: list[tuple[str, str]], key: str, get: Get = http_get) -> DataFrame:
    """The key (text) and the variables as numbers, of all counties (state, county); each is asked for by a task of its own. Text that is no number, and sentinels, are NULL."""
    _, _, parts, name = TABLES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state, county in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                header, *rows = _answer(get, *request(kind, vintage, variables, state, county, key))
                at = [header.index(c) for c in parts]
                cols = [["".join(r[i] for i in at) for r in rows], *[[r[header.index(v)] for r in rows] for v in variables]]
                yield pa.RecordBatch.from_arrays([pa.array([None if x is None else str(x) for x in c], pa.string()) for c in cols], [name, *variables])

    asked = spark.createDataFrame(counties, "state string, county string").repartition(max(len(counties), 1), "state", "county")
    raw = asked.mapInArrow(run, ", ".join(f"`{c}` string" for c in (name, *variables)))
    number = "bigint" if kind == "decennial" else "double"
    return raw.select(name, *[F.expr(f"CASE WHEN try_cast(`{v}` AS double) > {SENTINEL!r} THEN try_cast(`{v}` AS {number}) END").alias(v) for v in variables])


def read_response(spark: SparkSession, text: str, variables: tuple[str, ...], key_parts: tuple[str, ...], key: str, whole: bool = False) -> DataFrame:
    """key (joined text, never a number) and the variables as numbers; text that is none, and sentinels, are NULL."""
    header, *rows = json.loads(text)
    schema = ", ".join(f"`{c}` string" for c in header)
    d = spark.createDataFrame([tuple(r) for r in rows], schema)
    kind = "bigint" if whole else "double"
    value = lambda c: F.expr(f"CASE WHEN try_cast(`{c}` AS double) > {SENTINEL!r} THEN try_cast(`{c}` AS {kind}) END").alias(c)
    return d.select(F.concat(*key_parts).alias(key), *[value(c) for c in variables])
