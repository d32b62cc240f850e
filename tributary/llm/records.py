"""Length-delimited binary records of token ids, with an offset index.

A shard holds the documents of one range of doc_id in ascending order. It begins
with MAGIC and a byte that gives the bytes of an id (2 if the vocabulary allows,
else 4). Each record is framed as

    length of body (u64) | masked checksum of the length (u32) | body | masked checksum of the body (u32)

all little-endian, where the checksum is CRC-32 and masked means rotated right by
15 bits plus a constant, so that records nested in records don't check by
accident. A body is doc_id (i64), a byte that is 1 if doc_id is null, and the ids.
Beside each shard lies an index of fixed-width entries (INDEX), from which any
record can be read alone: that is what shuffled reads use.

A task writes under a name of its own and renames at the end, so a repeated or
lost task leaves no half shard. Files are reached through pyarrow's filesystems
(file, hdfs, s3, gs); a folder without a scheme is one of the session's default
file system, as it is for Spark. Text is shuffled once, by range of doc_id and the
text's hash, so that many rows of one doc_id, or of none, are spread too.

Edge cases: a null or empty text is the end id alone; null doc_ids come first;
equal doc_ids are ordered by the hash of their text, then by text; repeated rows
are written each; very long texts are one record each; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.text import columns
from tributary.llm.tokens import END_ID, default_tokenizer, encoder
from tributary.session import scratch_path

MAGIC = b"TRIBREC"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("first_token", "<u8"), ("n_tokens", "<u8")])
_HEAD, _TAIL, _ID = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qB")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    n = len(body).to_bytes(8, "little")
    return n + masked(n).to_bytes(4, "little") + body + masked(body).to_bytes(4, "little")


def read_frame(f) -> bytes | None:
    """The next record's body, None at the end; ValueError if a checksum fails."""
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError("cut record")
    n, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("bad length checksum")
    body = f.read(n)
    tail = f.read(_TAIL.size)
    if len(body) < n or len(tail) < _TAIL.size or masked(body) != _TAIL.unpack(tail)[0]:
        raise ValueError("bad body checksum")
    return body


def _encode(doc: int | None, raw: bytes, width: int) -> bytes:
    ids = raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes()
    return _ID.pack(doc or 0, doc is None) + ids


def _decode(body: bytes, width: int) -> tuple[int | None, np.ndarray]:
    doc, null = _ID.unpack_from(body)
    return None if null else doc, np.frombuffer(body, f"<u{width}", offset=_ID.size).astype("<u4")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a qualified folder or file; Hadoop writes local ones as file:/x."""
    return pafs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: of the session's default file system unless it names one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


class Shard:
    """A shard and its index: iterate in order, read one record, or read shuffled."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)

    def _head(self, f) -> int:
        head = f.read(len(MAGIC) + 1)
        if head[:-1] != MAGIC:
            raise ValueError(f"not a shard: {self.path}")
        return head[-1]

    def index(self) -> np.ndarray:
        with self.fs.open_input_stream(self.path + ".idx") as f:
            return np.frombuffer(f.read(), INDEX)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        with self.fs.open_input_stream(self.path, buffer_size=1 << 20) as f:
            width = self._head(f)
            while (body := read_frame(f)) is not None:
                yield _decode(body, width)

    def at(self, entries: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
        """The records of index entries, in their order."""
        with self.fs.open_input_file(self.path) as f:
            width = self._head(f)
            for e in entries:
                f.seek(int(e["offset"]))
                yield _decode(read_frame(f), width)

    def shuffled(self, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
        entries = self.index()
        order = list(range(len(entries)))
        random.Random(seed).shuffle(order)
        yield from self.at(entries[order])


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> list[dict]:
    """Encode and write docs; one manifest entry per shard, in order of doc_id."""
    path = tokenizer or default_tokenizer()
    folder = qualified(docs.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(path, end_id)
        width = 2 if enc.vocab_size <= 1 << 16 and end_id < 1 << 16 else 4
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        final, trial = f"{root}/shard-{shard:06d}.rec", f"{root}/.{uuid.uuid4().hex}"
        index, offset, tokens = [], len(MAGIC) + 1, 0
        out = None
        for ids, texts in columns(batches, "doc_id", "text"):
            if not ids:
                continue
            if out is None:
                out = fs.open_output_stream(trial, buffer_size=1 << 20)
                out.write(MAGIC + bytes([width]))
            for at in range(0, len(ids), 200):
                for doc, raw in zip(ids[at : at + 200], enc.encode(texts[at : at + 200])):
                    n = len(raw) // 4
                    record = frame(_encode(doc, raw, width))
                    out.write(record)
                    index.append((doc or 0, doc is None, offset, tokens, n))
                    offset += len(record)
                    tokens += n
        if out is None:
            return
        out.close()
        with fs.open_output_stream(trial + ".idx") as f:
            f.write(np.array(index, INDEX).tobytes())
        fs.move(trial + ".idx", final + ".idx")
        fs.move(trial, final)
        row = [[shard], [f"{folder.rstrip('/')}/shard-{shard:06d}.rec"], [len(index)], [tokens], [offset]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    rows = ranged.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long, n_bytes long").collect()
    manifest, start = [], 0
    for r in sorted(rows):
        manifest.append(r.asDict() | {"start": start})
        start += r.n_tokens
    return manifest


def read_shards(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Per record, from the files: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit ids)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.array([], pa.int64()).type] * 4
        for batch in batches:
            for uri, start in zip(*(batch.column(k).to_pylist() for k in range(2))):
                out = []
                for doc, ids in Shard(uri):
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.replace(" long", "").split(", "))
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.replace(" long", "").split(", "))

    return shards.repartition(len(manifest), "path").mapInArrow(run, schema)


def write_and_read(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs as shards (in the shared folder unless told where) and read them back."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    return read_shards(spark, write_shards(docs, folder, tokenizer, end_id))
