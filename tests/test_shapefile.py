import struct

from tributary.sources.shapefile import read_shapefile


def test_lines_and_attributes(spark, tmp_path):
    def record(i, body):
        return struct.pack(">ii", i, len(body) // 2) + body

    line = struct.pack("<i4dii", 3, 0, 0, 3, 4, 1, 2) + struct.pack("<i", 0) + struct.pack("<4d", 0, 0, 3, 4)
    shapes = record(1, line) + record(2, struct.pack("<i", 0))
    (tmp_path / "p.shp").write_bytes(b"\0" * 100 + shapes)
    fields = b"".join(struct.pack("<11sc4xBB14x", n, k, size, dec) for n, k, size, dec in ((b"FACILITYID", b"C", 6, 0), (b"SLOPE", b"N", 8, 3), (b"N", b"N", 4, 0)))
    rows = b" 00012 " + b"   0.500" + b"  12" + b" " + b"      " + b"********" + b"    "
    (tmp_path / "p.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 2, 32 + len(fields) + 1, 19) + fields + b"\r" + rows)
    a, b = read_shapefile(spark, str(tmp_path / "p.shp")).orderBy("fidx").collect()
    assert (a.FACILITYID, a.SLOPE, a.N) == ("00012", 0.5, 12) and (b.FACILITYID, b.SLOPE, b.N, b.geom) == (None, None, None, None)
    assert bytes(a.geom) == b"\x01" + struct.pack("<II", 5, 1) + b"\x01" + struct.pack("<II", 2, 2) + struct.pack("<4d", 0, 0, 3, 4)
