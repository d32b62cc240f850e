"""GeoPackage layers: SQLite files with a header before each WKB geometry."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import shapes

_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
_KINDS = {"INTEGER": "long", "INT": "long", "MEDIUMINT": "long", "SMALLINT": "long", "TINYINT": "long", "BOOLEAN": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}


def strip_header(blob: bytes | None) -> bytes | None:
    """The WKB of a GeoPackage geometry; None for none or an empty one."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    return None if flags & 0x10 else blob[8 + _ENVELOPE[flags >> 1 & 7] :]


def add_header(wkb: bytes | None, srs_id: int) -> bytes | None:
    return None if wkb is None else b"GP\x00\x01" + struct.pack("<i", srs_id) + wkb


def _open(content: bytes) -> sqlite3.Connection:
    """The database in memory, without a file."""
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def _ask(spark: SparkSession, path: str, question: str, *values: str) -> list[tuple]:
    """Rows of text that a query finds in the file; a task reads the file, and only the answer leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = [[None if x is None else str(x) for x in r] for r in _open(content).execute(question, values)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["row"])

    return [tuple(r.row) for r in spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row array<string>").collect()]


def layers(spark: SparkSession, path: str) -> list[str]:
    return [r[0] for r in _ask(spark, path, "SELECT table_name FROM gpkg_contents ORDER BY table_name")]


def read_layer(spark: SparkSession, path: str, layer: str, where: str | None = None) -> DataFrame:
    """The layer's columns, geometry as WKB in ``geom``; ``where`` is SQL that the file itself applies.

    One task reads a file: SQLite files can't be split.
    """
    geom = (_ask(spark, path, "SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", layer) or [None])[0]
    info = _ask(spark, path, "SELECT cid, name, type FROM pragma_table_info(?)", layer)
    if not info:
        raise ValueError(f"no layer {layer!r} in {path}")
    cols = [(r[1], "binary" if geom and r[1] == geom[0] else _KINDS.get(r[2].split("(")[0].upper(), "string")) for r in info]
    schema = ", ".join(f"`{'geom' if geom and c == geom[0] else c}` {k}" for c, k in cols)
    arrow = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["geom" if geom and c == geom[0] else c for c, _ in cols]
        for batch in batches:
            for content in batch.column(0).to_pylist():
                cur = _open(content).execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c, _ in cols)} FROM "{layer}"' + (f" WHERE {where}" if where else ""))
                while rows := cur.fetchmany(5000):
                    values = [list(v) for v in zip(*rows)]
                    if geom:
                        k = names.index("geom")
                        values[k] = [strip_header(b) for b in values[k]]
                    yield pa.RecordBatch.from_arrays([pa.array([None if x is None else str(x) for x in v] if t == "string" else v, arrow[t]) for v, (_, t) in zip(values, cols)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def write_layer(rows: DataFrame, path: str, layer: str, srs_id: int = 2264) -> int:
    """Write a frame with a ``geom`` WKB column as a layer of a local file, streamed through the driver; returns the rows written."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
    db = sqlite3.connect(path)
    db.execute("PRAGMA application_id = 1196444487")
    db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
    db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
    db.execute(f'DROP TABLE IF EXISTS "{layer}"')
    db.execute("DELETE FROM gpkg_contents WHERE table_name = ?", (layer,))
    db.execute("DELETE FROM gpkg_geometry_columns WHERE table_name = ?", (layer,))
    db.execute(f'CREATE TABLE "{layer}" ({", ".join(chr(34) + c + chr(34) + " " + kinds.get(t, "TEXT") for c, t in rows.dtypes)})')
    db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srs_id))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srs_id))
    at, n = rows.columns.index("geom"), 0
    for r in rows.toLocalIterator():
        v = list(r)
        v[at] = add_header(bytes(v[at]) if v[at] is not None else None, srs_id)
        db.execute(f'INSERT INTO "{layer}" VALUES ({", ".join("?" * len(v))})', v)
        n += 1
    db.commit()
    db.close()
    return n


def clear_layers(path: str, prefix: str) -> list[str]:
    """Drop the layers of a local file whose name begins with prefix, so that results of an earlier run don't stay; returns their names. No file is fine."""
    if not os.path.exists(path):
        return []
    db = sqlite3.connect(path)
    gone = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents ORDER BY table_name") if r[0].startswith(prefix)]
    for name in gone:
        db.execute(f'DROP TABLE IF EXISTS "{name}"')
        db.execute("DELETE FROM gpkg_contents WHERE table_name = ?", (name,))
        db.execute("DELETE FROM gpkg_geometry_columns WHERE table_name = ?", (name,))
    db.commit()
    db.close()
    return gone


def write_flags(flags: DataFrame, path: str, srs_id: int = 2264) -> list[str]:
    """Write normalised flags (operators.reports.normalise) as a layer for each source and type, split by kind of geometry where a type has several; returns the layers."""
    d = flags.withColumn("_kind", F.lower(shapes.kind("geom")))
    several = d.groupBy("layer").agg(F.collect_set("_kind").alias("kinds")).orderBy("layer").collect()  # a row for each layer
    out = []
    for r in several:
        for k in sorted(r.kinds):
            name = f"{r.layer}_{k}" if len(r.kinds) > 1 else r.layer
            write_layer(d.where((F.col("layer") == r.layer) & (F.col("_kind") == k)).drop("layer", "_kind"), path, name, srs_id)
            out.append(name)
    return out
