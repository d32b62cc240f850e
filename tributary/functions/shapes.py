"""Polygon functions over WKB columns: kernels on the geometry library that Spark ships.

``jvm/Shapes.java`` is compiled by the compiler that Spark ships for its own
generated code; the class files go as a jar to the shared folder and from there to
every executor. Calls stay in the JVM. NULL stands for no geometry.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import geo
from tributary.session import scratch_path

_UDFS = {
    "tributary_one": ("One", T.BinaryType()),
    "tributary_two": ("Two", T.BinaryType()),
    "tributary_measure": ("Measure", T.DoubleType()),
    "tributary_merge": ("Merge", T.BinaryType()),
    "tributary_nearer": ("Nearer", T.BinaryType()),
    "tributary_fold": ("Fold", T.ArrayType(T.BinaryType())),
    "tributary_bounds": ("Bounds", T.ArrayType(T.DoubleType())),
    "tributary_parse": ("Parse", T.BinaryType()),
    "tributary_kind": ("Kind", T.StringType()),
    "tributary_vertices": ("Vertices", T.ArrayType(T.DoubleType())),
    "tributary_move": ("Move", T.BinaryType()),
    "tributary_parts": ("Parts", T.ArrayType(T.BinaryType())),
}


def register(spark: SparkSession) -> None:
    """Make the functions of this module usable in a session; a second call does nothing."""
    if spark.catalog.functionExists("tributary_parts"):
        return
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook((Path(__file__).resolve().parents[1] / "jvm" / "Shapes.java").read_text())
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as jar:
        for name, code in dict(compiler.getBytecodes()).items():
            jar.writestr(zipfile.ZipInfo(name.replace(".", "/") + ".class"), bytes(code))
    path = scratch_path(spark, "shapes") + ".jar"
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(jpath)
    out.write(content.getvalue())
    out.close()
    fs.deleteOnExit(jpath)
    spark.sql(f"ADD JAR '{path}'")
    loader = compiler.getClassLoader()
    for name, (cls, kind) in _UDFS.items():
        function = loader.loadClass(f"tributary.Shapes${cls}").getDeclaredConstructor(None).newInstance(None)
        spark._jsparkSession.udf().register(name, function, spark._jsparkSession.parseDataType(kind.json()))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def one(op: str, g: str | Column, x: float = 0.0) -> Column:
    """buffer, ring (the band of width x around), close, solid (no holes), concave (ratio x), triangles (edges up to x), join_parts (gaps up to x), inner_point, centre, fix."""
    return F.call_udf("tributary_one", F.lit(op), _c(g), F.lit(float(x)))


def two(op: str, a: str | Column, b: str | Column, x: float = 0.0) -> Column:
    """union, intersection, difference, grow_along (a grows by x along lines b that it doesn't cover)."""
    return F.call_udf("tributary_two", F.lit(op), _c(a), _c(b), F.lit(float(x)))


def measure(op: str, a: str | Column, b: str | Column | None = None) -> Column:
    """area, length, parts, x and y of the centre; of two: distance, intersects (1 or 0), shared (area), seam (length of common boundary)."""
    return F.call_udf("tributary_measure", F.lit(op), _c(a), F.lit(None).cast("binary") if b is None else _c(b))


def merge(all_: str | Column) -> Column:
    return F.call_udf("tributary_merge", _c(all_))


def nearer(target: str | Column, own: str | Column, other: str | Column, step: float) -> Column:
    return F.call_udf("tributary_nearer", _c(target), _c(own), _c(other), F.lit(float(step)))


def fold(op: str, all_: str | Column, x: float) -> Column:
    return F.call_udf("tributary_fold", F.lit(op), _c(all_), F.lit(float(x)))


def bounds(g: str | Column) -> Column:
    return F.call_udf("tributary_bounds", _c(g))


def parts(g: str | Column) -> Column:
    return F.call_udf("tributary_parts", _c(g))


def project(g: str | Column, forwards: bool = True) -> Column:
    """Geometry in degrees (longitude, latitude) in the working projection, or back."""
    return F.call_udf("tributary_move", _c(g), F.array(*[F.lit(float(x)) for x in geo.CONIC]), F.lit(forwards))


def coords(g: str | Column) -> Column:
    """The vertices of a line as array of struct<x,y>; of several lines those of the first; NULL for anything else."""
    flat = F.call_udf("tributary_vertices", _c(g))
    pair = lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y"))
    return F.when(flat.isNotNull(), F.transform(F.sequence(F.lit(0), (F.size(flat) / 2 - 1).cast("int")), pair))


def line(coords_: str | Column) -> Column:
    """A line through an array of struct<x,y>; NULL for fewer than two points."""
    c = _c(coords_)
    text = F.concat(F.lit("LINESTRING("), F.array_join(F.transform(c, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))
    return F.when(F.size(c) > 1, parse(text))


def kind(g: str | Column) -> Column:
    """Point, LineString, Polygon and so on."""
    return F.call_udf("tributary_kind", _c(g))


def parse(text: str | Column) -> Column:
    return F.call_udf("tributary_parse", _c(text))


def box(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    ring = ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
    return parse(F.concat(F.lit("POLYGON(("), F.concat_ws(",", *[F.concat_ws(" ", a, b) for a, b in ring]), F.lit("))")))


def segment(sx: str = "sx", sy: str = "sy", ex: str = "ex", ey: str = "ey") -> Column:
    return parse(F.concat(F.lit("LINESTRING("), F.concat_ws(",", F.concat_ws(" ", sx, sy), F.concat_ws(" ", ex, ey)), F.lit(")")))
