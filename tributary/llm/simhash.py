"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints: texts with A-Z lower-cased are cut into words of non-white-space,
words into shingles of four (the whole sequence if fewer), and a bit of the
64-bit fingerprint is set where more than half of the shingles' XXH64 (seed 42)
have it. Two fingerprints link when at most ``radius`` bits differ.

Links: the 64 bits are cut into ``radius + agree`` disjoint ranges; fingerprints
within the radius are equal in at least ``agree`` of these, so dealing the distinct
fingerprints by every choice of ``agree`` ranges makes each link meet under some
key. More ranges mean more rows to deal and fewer comparisons; deal() takes the
number with the least work for the fingerprints at hand. The members of one key
are sorted by population count and cut into tiles; each pair of tiles is compared
with an exclusive-or and bit counts in numpy unless the tiles' population counts lie
further apart than the radius. A key with more than ``block`` members (found by a
count first) is split over tasks by pairs of sub-blocks. A task returns a spanning
forest of the links it has found, so a group of n copies gives n - 1 edges, and
connected components of the forests are those of all links. Nodes are fingerprints,
so a doc_id with several texts doesn't tie these together.

Edge cases: null or empty texts have fingerprint zero and link like any other;
repeated rows have equal fingerprints; very long texts are read whole; a table
without rows gives none; a null doc_id keeps its fingerprint and counts as no
representative: where none of a group has an id, component_id is null. Extra input
columns are not read, and keep_one() passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import ascii_words, columns
from tributary.operators.components import connected_components
from tributary.session import discard, materialize

RADIUS = 4
SHINGLE = 4
TILE = 512
BLOCK = 32_768
#: Dealing a row costs about as much as so many comparisons.
ROW_COST = 500
#: Dropped rows up to this many (two longs each) are broadcast; more of them are joined by key.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as an unsigned integer; 0 without words."""
    words = ascii_words(text)
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    begin, end = starts[: n - shingle + 1].tolist(), (starts[shingle:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin, end)), np.uint64, len(begin))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 250):  # up to 250 ones fit a byte
        ones += np.unpackbits(h[at : at + 250].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's XXH64, seed 42) and fp (the fingerprint's 64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in columns(batches, "doc_id", "key", "text"):
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(fps)], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long")


def _join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of the index pairs (a, b); root[i] is always the tree's smallest index."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        up = np.arange(len(root))
        np.minimum.at(up, high, low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        root[:] = up[root]


def tile_forest(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE, left: int | None = None) -> np.ndarray:
    """root index (position in fps) of each fingerprint under links within the radius.

    With ``left`` given, only links between the first ``left`` members and the
    rest are looked for. Tiles are runs of rows in order of population count.
    """
    n = len(fps)
    bits = np.bitwise_count(fps)
    sides = [np.arange(n)] if left is None else [np.arange(left), np.arange(left, n)]
    sides = [s[np.argsort(bits[s], kind="stable")] for s in sides]
    root = np.arange(n)
    for i in range(0, len(sides[0]), tile):
        rows = sides[0][i : i + tile]
        most = int(bits[rows[-1]])
        for j in range(i if left is None else 0, len(sides[-1]), tile):
            cols = sides[-1][j : j + tile]
            if int(bits[cols[0]]) - most > radius:
                break
            if int(bits[rows[0]]) - int(bits[cols[-1]]) > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[cols][None, :]) <= radius)
            _join_roots(root, rows[x], cols[y])
    return root


def masks(radius: int = RADIUS, agree: int = 1) -> list[int]:
    """For each choice of ``agree`` out of radius + agree disjoint ranges, the bits in them."""
    n = radius + agree
    cuts = [64 * k // n for k in range(n + 1)]
    ranges = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(ranges, agree)]


def deal(n: int, radius: int = RADIUS) -> int:
    """How many ranges are to agree, by the least rows dealt and pairs compared among n evenly spread fingerprints."""

    def work(agree: int) -> float:
        keys, width = comb(radius + agree, agree), 64 * agree / (radius + agree)
        return keys * (ROW_COST * n + n * n / 2 / 2**width)

    return min(range(1, 5), key=work)


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, agree: int = 1) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp): a forest per task.

    Keys with more than ``block`` fingerprints are split into sub-blocks by a hash;
    a task then gets one sub-block or one pair of them.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius, agree)]
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.band", "key.value")
    size = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    size = size.withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    large = materialize(size.where("parts > 1"), "hot-bands")
    hot = large.limit(1).count() > 0
    if not hot:
        dealt = rows.select("band", "value", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "fp")
    else:
        d = rows.join(large.select("band", "value", "parts"), ["band", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        d = d.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = d.select(
            "band", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp"
        )
    key = ["band", "value", "x", "y"]
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(n, *key).sortWithinPartitions(*key, "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group: list[np.ndarray]) -> pa.RecordBatch | None:
            side, fp = (np.concatenate(c) for c in zip(*group))
            if len(fp) < 2:
                return None
            left = int((side == 0).sum()) if side[-1] != side[0] else None
            if left is None and lone[0] != lone[1]:
                return None  # one side of a pair of sub-blocks is empty; each sub-block has its own task
            root = tile_forest(fp.view(np.uint64), radius, left=left)
            child = np.nonzero(root != np.arange(len(root)))[0]
            if not len(child):
                return None
            return pa.RecordBatch.from_arrays([pa.array(fp[root[child]]), pa.array(fp[child])], ["u", "v"])

        held: list[tuple] = []
        last = None
        lone = (0, 0)
        for batch in batches:
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            side, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            if not len(k):
                continue
            cut = np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1
            for a, b in zip([0, *cut], [*cut, len(k)]):
                now = tuple(k[a])
                if now != last and held:
                    if (out := close(held)) is not None:
                        yield out
                    held = []
                last, lone = now, (now[2], now[3])
                held.append((side[a:b], fp[a:b]))
        if held and (out := close(held)) is not None:
            yield out

    return dealt.mapInArrow(run, "u long, v long")


def components(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, agree: int | None = None) -> DataFrame:
    """(fp, component_id, component_fp) of fingerprints (doc_id, fp): the first document of each component, by doc_id, then fp."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fp")
    comp = connected_components(links(distinct, radius, block, agree or deal(distinct.count(), radius)))
    named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "named-fp")
    first = named.where("rep IS NOT NULL").groupBy("component").agg(F.min(F.struct("rep", "fp")).alias("first"))
    return materialize(named.join(first, "component", "left").select("fp", F.col("first.rep").alias("component_id"), F.col("first.fp").alias("component_fp")), "components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK, agree: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = materialize(fingerprints(docs), "fingerprints")
    comp = components(fps, radius, block, agree)
    return fps.join(comp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK, agree: int | None = None) -> DataFrame:
    """One row of every component, with docs' columns: the first by doc_id, then by fingerprint as a signed number, then by the text's hash.

    A row is known by its doc_id and its text's hash; of rows equal in both, that
    with the least hash of all its columns stays. Rows without doc_id all stay. The
    rows to drop are joined away, so that texts aren't shuffled unless more than
    BROADCAST_ROWS go.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    comp = components(fps, radius, block, agree)
    # copies of one text meet here: counted before the shuffle
    rows = fps.where("doc_id IS NOT NULL").groupBy("doc_id", "key", "fp").agg(F.count(F.lit(1)).alias("n")).join(comp, "fp")
    own = (F.col("doc_id") == F.col("component_id")) & (F.col("fp") == F.col("component_fp"))
    rows = materialize(rows.select("doc_id", "key", "n", own.alias("own"), "component_fp"), "rows")
    discard(fps)
    key = rows.where("own").groupBy("doc_id", "component_fp").agg(F.min("key").alias("key"))
    stays = materialize(rows.where("own").drop("component_fp").join(key.select("doc_id", "key"), ["doc_id", "key"], "left_semi"), "stays")
    gone = rows.join(stays.select("doc_id", "key"), ["doc_id", "key"], "left_anti").select("doc_id", "key")
    again = stays.where("n > 1").select("doc_id", "key")
    out = materialize(gone.union(again), "gone")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.withColumn("_simhash_key", F.xxhash64("text"))
    mine = lambda t: t.select(F.col("doc_id").alias("_simhash_id"), F.col("key").alias("_simhash_text"))
    same = (F.col("doc_id") == F.col("_simhash_id")) & (F.col("_simhash_key") == F.col("_simhash_text"))
    few = out.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = tagged.join(F.broadcast(mine(out)) if few else mine(out), same, "left_anti").select(*cols)
    if again.limit(1).count():
        repeated = tagged.join(F.broadcast(mine(again)) if few else mine(again), same, "left_semi")
        whole = F.struct(*cols)
        one = repeated.groupBy("doc_id", "_simhash_key").agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    return kept
