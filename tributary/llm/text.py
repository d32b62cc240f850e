"""Small helpers for the operators that read texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice of a batch has at most so many rows, and so many bytes of text unless it is one row.
SLICE_ROWS = 1000
SLICE_BYTES = 4 << 20


class Memo(dict):
    """A bounded cache of a function of one argument: dict lookups on the fast path."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def slices(batch: pa.RecordBatch, by: str | None = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most SLICE_ROWS rows and, unless a single row has more, SLICE_BYTES of the column ``by``."""
    at = batch.schema.get_field_index(by) if by else -1
    size = np.zeros(batch.num_rows, np.int64) if at < 0 else pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size.astype(np.int64))
    a = 0
    while a < batch.num_rows:
        before = int(upto[a - 1]) if a else 0
        b = min(max(a + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right"))), a + SLICE_ROWS)
        yield batch.slice(a, b - a)
        a = b


def columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of the batches' slices as lists; texts, if named, bound the slices' bytes."""
    for batch in batches:
        for part in slices(batch, "text" if "text" in names else None):
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text as UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hash_bound(share: float) -> int:
    """The signed 64-bit number that a share of evenly spread hashes doesn't exceed."""
    return 2**63 - 1 if share >= 1 else int(2**63 * (2 * max(share, 0.0) - 1))
