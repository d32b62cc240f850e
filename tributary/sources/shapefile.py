"""Shapefiles: geometry (.shp) and attributes (.dbf) side by side, as rows in file order."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _turn(ring: bytes) -> float:
    """Twice the signed area of a ring of x and y; below zero if it runs clockwise."""
    p = list(struct.iter_unpack("<dd", ring))
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:]))


def _holds(ring: bytes, hole: bytes) -> bool:
    """Whether a ring encloses the middle of a hole's first side."""
    (x1, y1), (x2, y2) = list(struct.iter_unpack("<dd", hole[:32]))
    x, y, inside = (x1 + x2) / 2, (y1 + y2) / 2, False
    p = list(struct.iter_unpack("<dd", ring))
    for (ax, ay), (bx, by) in zip(p, p[1:]):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            inside = not inside
    return inside


def _polygons(rings: list[bytes]) -> bytes:
    """WKB of rings as a shapefile orders them: clockwise ones are outlines, the others holes of an outline around them."""
    outer = [[r] for r in rings if len(rings) == 1 or _turn(r) <= 0]
    for hole in (r for r in rings if len(rings) > 1 and _turn(r) > 0):
        home = next((o for o in outer if _holds(o[0], hole)), None)
        outer.append([hole]) if home is None else home.append(hole)
    one = lambda o: b"\x01" + struct.pack("<II", 3, len(o)) + b"".join(struct.pack("<I", len(r) // 16) + r for r in o)
    return one(outer[0]) if len(outer) == 1 else b"\x01" + struct.pack("<II", 6, len(outer)) + b"".join(map(one, outer))


def _shapes(raw: bytes) -> Iterator[bytes | None]:
    """WKB of each record: point, multi line, polygon or multi polygon; Z and M are left out."""
    at = 100
    while at + 8 <= len(raw):
        size = 2 * struct.unpack(">i", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 0:
            yield None
        elif kind == 1:
            yield b"\x01" + struct.pack("<I", 1) + body[4:20]
        elif kind in (3, 5):
            n_parts, n_points = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            xy = body[44 + 4 * n_parts :]
            parts = [struct.pack("<I", b - a) + xy[16 * a : 16 * b] for a, b in zip(starts, starts[1:])]
            if kind == 5:
                yield _polygons([xy[16 * a : 16 * b] for a, b in zip(starts, starts[1:])])
            else:
                yield b"\x01" + struct.pack("<II", 5, n_parts) + b"".join(b"\x01" + struct.pack("<I", 2) + p for p in parts)
        else:
            raise ValueError(f"shape type {kind} is not read")


def _fields(raw: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, length, decimals) of a .dbf file."""
    out, at = [], 32
    while raw[at] != 0x0D:
        d = raw[at : at + 32]
        out.append((d[:11].split(b"\0")[0].decode("ascii"), chr(d[11]), d[16], d[17]))
        at += 32
    return out


def _kind(kind: str, decimals: int) -> str:
    return "string" if kind not in "NF" else "double" if decimals or kind == "F" else "long"


def _value(raw: bytes, kind: str):
    text = raw.decode("utf-8", "replace").strip("\0 ")
    if kind == "string":
        return text or None
    try:
        return float(text) if kind == "double" else int(float(text))
    except ValueError:
        return None


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """fidx (the record's ordinal), the attributes, and geom as WKB; blank and unreadable numbers are NULL.

    path is the .shp file. One task reads it: records have no fixed length.
    """
    stem = path.removesuffix(".shp")
    load = lambda end: spark.read.format("binaryFile").load(stem + end).select("content")
    # the header alone comes to the driver
    head = load(".dbf").selectExpr("substring(content, 1, CAST(conv(concat(hex(substring(content, 10, 1)), hex(substring(content, 9, 1))), 16, 10) AS INT)) AS head").first()
    fields = _fields(bytes(head.head))
    schema = "fidx long, " + "".join(f"`{n}` {_kind(k, d)}, " for n, k, _, d in fields) + "geom binary"
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    both = spark.read.format("binaryFile").load([stem + ".shp", stem + ".dbf"]).select("path", "content").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {path[-4:]: content for batch in batches for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        dbf, geoms = files[".dbf"], list(_shapes(files[".shp"]))
        head, size = struct.unpack("<HH", dbf[8:12])
        cols: list[list] = [[] for _ in fields]
        for i in range(len(geoms)):
            at = head + i * size + 1
            for col, (_, kind, n, dec) in zip(cols, fields):
                col.append(_value(dbf[at : at + n], _kind(kind, dec)))
                at += n
        arrays = [pa.array(range(len(geoms)), pa.int64()), *(pa.array(c, arrow[_kind(k, d)]) for c, (_, k, _, d) in zip(cols, fields)), pa.array(geoms, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["fidx", *(f[0] for f in fields), "geom"])

    return both.mapInArrow(run, schema)


def _simple(wkb: bytes, at: int = 0) -> tuple[int, list[list[bytes]], int]:
    """(kind, parts, end) of little-endian WKB: 1 points, 3 lines or 5 polygons, each a list of runs of x and y."""
    (kind,) = struct.unpack_from("<I", wkb, at + 1)
    at += 5
    run = lambda at: (wkb[at + 4 : at + 4 + 16 * (n := struct.unpack_from("<I", wkb, at)[0])], at + 4 + 16 * n)
    if kind == 1:
        return 1, [[wkb[at : at + 16]]], at + 16
    if kind == 2:
        points, at = run(at)
        return 3, [[points]], at
    (n,) = struct.unpack_from("<I", wkb, at)
    at += 4
    if kind == 3:
        rings = []
        for _ in range(n):
            points, at = run(at)
            rings.append(points)
        return 5, [rings], at
    if kind not in (4, 5, 6):
        raise ValueError(f"geometry type {kind} can't be written")
    out: list[list[bytes]] = []
    for _ in range(n):
        _, parts, at = _simple(wkb, at)
        out += parts
    return {4: 1, 5: 3, 6: 5}[kind], out, at


def _little(wkb: bytes) -> bytes:
    """The WKB with its numbers little-endian."""
    if wkb[0] == 1:
        return wkb

    def turn(at: int) -> tuple[bytes, int]:
        (kind,) = struct.unpack_from(">I", wkb, at + 1)
        at += 5
        head = b"\x01" + struct.pack("<I", kind)
        points = lambda at, n: (struct.pack(f"<{2 * n}d", *struct.unpack_from(f">{2 * n}d", wkb, at)), at + 16 * n)
        if kind == 1:
            body, at = points(at, 1)
            return head + body, at
        (n,) = struct.unpack_from(">I", wkb, at)
        at += 4
        if kind == 2:
            body, at = points(at, n)
            return head + struct.pack("<I", n) + body, at
        out = head + struct.pack("<I", n)
        for _ in range(n):
            if kind == 3:
                (m,) = struct.unpack_from(">I", wkb, at)
                body, at = points(at + 4, m)
                body = struct.pack("<I", m) + body
            else:
                body, at = turn(at)
            out += body
        return out, at

    return turn(0)[0]


def _record(wkb: bytes | None) -> tuple[int, bytes, list[float]]:
    """(shape type, record, bounds) of a geometry; rings are turned as the format wants them, lines of several parts kept."""
    if wkb is None:
        return 0, struct.pack("<i", 0), []
    kind, parts, _ = _simple(_little(bytes(wkb)))
    if kind == 1:
        x, y = struct.unpack("<dd", parts[0][0])
        return 1, struct.pack("<i", 1) + parts[0][0], [x, y, x, y]
    back = lambda r: b"".join(r[i : i + 16] for i in range(len(r) - 16, -1, -16))
    runs = [r if kind == 3 or (_turn(r) < 0) == (k == 0) else back(r) for part in parts for k, r in enumerate(part)]
    xy = [p for r in runs for p in struct.iter_unpack("<dd", r)]
    box = [min(p[0] for p in xy), min(p[1] for p in xy), max(p[0] for p in xy), max(p[1] for p in xy)]
    starts, n = [], 0
    for r in runs:
        starts.append(n)
        n += len(r) // 16
    return kind, struct.pack("<i4dii", kind, *box, len(runs), n) + struct.pack(f"<{len(runs)}i", *starts) + b"".join(runs), box


#: The longest text that a .dbf field holds.
TEXT = 254


def write_shapefile(rows: DataFrame, path: str, prj: str | None = None) -> int:
    """Write a frame with a ``geom`` column as .shp, .shx and .dbf (and .prj) on the driver's disk; returns the rows written.

    For results that a person opens: rows are streamed through the driver. Names are
    cut to ten letters, ValueError if two become one; texts are cut to 254 bytes.
    NULL geometry is a null shape; all others must be of one kind.
    """
    stem = path.removesuffix(".shp")
    cols = [(c, t) for c, t in rows.dtypes if c != "geom"]
    short = [c[:10] for c, _ in cols]
    if len({n.upper() for n in short}) < len(short):
        raise ValueError(f"names of ten letters aren't unique: {sorted(short)}")
    number = {"bigint": (20, 0), "int": (11, 0), "smallint": (6, 0), "tinyint": (4, 0), "double": (24, 8), "float": (24, 8), "boolean": (1, 0)}
    fields = [("N" if t in number else "C", *number.get(t, (TEXT, 0))) for _, t in cols]
    kinds, box, offset, n = set(), [], 50, 0
    at = rows.columns.index("geom")
    with open(stem + ".shp", "wb") as shp, open(stem + ".shx", "wb") as shx, open(stem + ".dbf", "wb") as dbf:
        shp.write(b"\0" * 100), shx.write(b"\0" * 100)
        head = 33 + 32 * len(fields)
        dbf.write(b"\0" * head)
        for r in rows.toLocalIterator():
            kind, body, b = _record(r[at])
            kinds |= {kind} - {0}
            if len(kinds) > 1:
                raise ValueError(f"one file holds one kind of shape, not {sorted(kinds)}")
            box = [*map(min, box[:2], b[:2]), *map(max, box[2:], b[2:])] if box and b else b or box
            n += 1
            shp.write(struct.pack(">ii", n, len(body) // 2) + body)
            shx.write(struct.pack(">ii", offset, len(body) // 2))
            offset += 4 + len(body) // 2
            line = b" "
            for (c, _), (kind_, size, digits) in zip(cols, fields):
                v = r[c]
                if kind_ == "C":
                    raw = ("" if v is None else str(v)).encode()[:size]
                    line += raw.decode("utf-8", "ignore").encode().ljust(size)
                else:
                    text = "" if v is None else f"{v:.{digits}f}" if digits else str(int(v))
                    line += (text if len(text) <= size else "").rjust(size).encode()
            dbf.write(line)
        dbf.write(b"\x1a")
        size = 1 + sum(f[1] for f in fields)
        dbf.seek(0)
        dbf.write(struct.pack("<BBBBIHH20x", 3, 100, 1, 1, n, head, size))
        for name, (kind_, length, digits) in zip(short, fields):
            dbf.write(struct.pack("<11sc4xBB14x", name.encode(), kind_.encode(), length, digits))
        dbf.write(b"\r")
        for f, words in ((shp, offset), (shx, 50 + 4 * n)):
            f.seek(0)
            f.write(struct.pack(">i20xi", 9994, words) + struct.pack("<ii4d32x", 1000, next(iter(kinds), 0), *(box or [0.0] * 4)))
    if prj:
        with open(stem + ".prj", "w") as f:
            f.write(prj)
    return n
