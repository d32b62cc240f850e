"""Packing token sequences into fixed windows by non-negative least squares.

Each task packs the documents of its own input split, a pool of at most
``pool_tokens`` ids at a time, so no document is shuffled and memory is bounded.
In a pool, whole windows are cut off long documents first. The remainders'
lengths form a histogram of ``bins`` classes; all combinations of at most
``depth`` classes that fill a window are enumerated, their repeat counts are
solved by non-negative least squares against the histogram and rounded down to
what is in stock. Remainders that no combination takes are packed greedily,
longest first: cut into the slack of the planned windows, then end to end into
new ones. A window left open is carried to the next pool; the last one of a
split is cut at powers of two, which need no padding. So only pieces are cut,
never dropped, and nothing is padded.

Edge cases: a null or empty text is the end id alone; a null doc_id is kept;
repeated rows are packed each; an empty table gives no pieces; a document longer
than a pool is a pool of its own. Extra columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import columns
from tributary.llm.tokens import END_ID, default_tokenizer, encoder

WINDOW = 4096
BINS = 64
DEPTH = 3
POOL_TOKENS = 4_000_000


@functools.cache
def combinations(bins: int = BINS, depth: int = DEPTH) -> tuple[tuple[int, ...], ...]:
    """Multisets of at most depth classes 1..bins with sum bins, largest class first."""

    def parts(total: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
        elif left:
            for x in range(min(total, most), 0, -1):
                for rest in parts(total - x, x, left - 1):
                    yield (x, *rest)

    return tuple(parts(bins, bins, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """argmin |a x - b| for x >= 0 by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    for _ in range(rounds):
        off = np.where(on, -np.inf, w)
        k = int(off.argmax())
        if off[k] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        on[k] = True
        while on.any():
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s[on].min() > 0:
                x = s
                break
            low = on & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            gone = on & (x <= 1e-12)
            if not gone.any():
                gone = low
            x[gone], on[gone] = 0.0, False
        w = a.T @ (b - a @ x)
    return x


def plan_counts(histogram: np.ndarray, bins: int = BINS, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) within the stock of histogram[class] (class 0 is unused)."""
    combos = combinations(bins, depth)
    a = np.zeros((bins, len(combos)))
    for j, c in enumerate(combos):
        for x in c:
            a[x - 1, j] += 1
    x = nnls(a, histogram[1:].astype(float))
    stock, out = histogram.copy(), []
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        need = Counter(combos[j])
        n = min(int(x[j] + 0.5), *(int(stock[c]) // k for c, k in need.items()))
        if n > 0:
            for c, k in need.items():
                stock[c] -= n * k
            out.append((combos[j], n))
    return out


def pack_lengths(lengths: list[int], window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> tuple[list, list]:
    """Closed windows and the open one, each a list of (item, start, length) in order."""
    closed, rest = [], []
    for item, n in enumerate(lengths):
        whole = n // window
        closed += [[(item, k * window, window)] for k in range(whole)]
        if n % window:
            rest.append((n % window, item, whole * window))
    width = window // bins
    stock = defaultdict(list)
    for n, item, start in sorted(rest, reverse=True):
        stock[-(-n // width)].append((n, item, start))
    histogram = np.zeros(bins + 1, np.int64)
    for c, x in stock.items():
        histogram[c] = len(x)
    planned = []
    for combo, repeats in plan_counts(histogram, bins, depth) if rest else []:
        planned += [[stock[c].pop() for c in combo] for _ in range(repeats)]
    left = sorted((x for s in stock.values() for x in s), reverse=True)
    slack = [window - sum(n for n, *_ in w) for w in planned]
    spare, missing = sum(n for n, *_ in left), sum(slack)
    while planned and spare < missing:  # take windows apart to fill the others
        left += planned.pop()
        gap = slack.pop()
        spare, missing = spare + window - gap, missing - gap
    queue = [(item, start, n) for n, item, start in reversed(left)]

    def take(space: int) -> list:
        got = []
        while space and queue:
            item, start, n = queue.pop()
            cut = min(n, space)
            got.append((item, start, cut))
            space -= cut
            if cut < n:
                queue.append((item, start + cut, n - cut))
        return got

    for w, gap in zip(planned, slack):
        closed.append([(item, start, n) for n, item, start in w] + take(gap))
    open_window: list = []
    while queue:
        open_window += take(window - sum(n for *_, n in open_window))
        if sum(n for *_, n in open_window) == window:
            closed.append(open_window)
            open_window = []
    return closed, open_window


def power_cuts(pieces: list) -> list[list]:
    """The pieces of an open window as windows of powers of two."""
    out, pieces = [], list(pieces)[::-1]
    total = sum(n for *_, n in pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        now = []
        while size:
            item, start, n = pieces.pop()
            cut = min(n, size)
            now.append((item, start, cut))
            size -= cut
            if cut < n:
                pieces.append((item, start + cut, n - cut))
        out.append(now)
    return out


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece: the columns of FIELDS, and ids (binary, unsigned 32-bit) if asked for.

    A sequence's pieces cover its offsets from 0 without gaps; sequence_tokens is
    its length, either the window or a power of two. sequence_id is unique; its
    high bits are the task's split, so a repeated task gives the same ids.
    """
    path = tokenizer or default_tokenizer()
    schema = FIELDS + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        serial = TaskContext.get().partitionId() << 40
        pool: list[tuple] = []
        held, carried = 0, []

        def rows(windows: list[list]) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            out = []
            for w in windows:
                offset, total = 0, sum(n for *_, n in w)
                for (doc, ids), start, n in w:
                    part = ids[4 * start : 4 * (start + n)]
                    out.append((doc, start, n, zlib.crc32(part), len(ids) // 4, serial, offset, total, part)[: len(names)])
                    offset += n
                serial += 1
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pool, held, carried
            closed, open_window = pack_lengths([len(ids) // 4 for _, ids in pool], window)
            named = lambda w: [(pool[i], a, n) for i, a, n in w]
            ready = [named(w) for w in closed]
            carried += named(open_window)
            while sum(n for *_, n in carried) >= window:
                now, space = [], window
                while space:
                    doc, a, n = carried.pop(0)
                    cut = min(n, space)
                    now.append((doc, a, cut))
                    space -= cut
                    if cut < n:
                        carried.insert(0, (doc, a + cut, n - cut))
                ready.append(now)
            if last:
                ready += power_cuts(carried)
                carried = []
            pool, held = [], 0
            yield from rows(ready)

        for doc_ids, texts in columns(batches, "doc_id", "text"):
            for at in range(0, len(texts), 200):
                for doc, ids in zip(doc_ids[at : at + 200], enc.encode(texts[at : at + 200])):
                    if held and held + len(ids) // 4 > pool_tokens:
                        yield from flush(False)
                    pool.append((doc, ids))
                    held += len(ids) // 4
        yield from flush(True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
