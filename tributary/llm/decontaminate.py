"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are white-space tokens, lower-cased and without punctuation. A seed is an
n-gram of a test item (the whole item if it is shorter). Every seed is looked up
in each document, however common it is: copies of an item make all of its seeds
common, and an edited copy has but a few of them. A passage is opened around each
run of hits and aligned with the item locally on words (match +2, other -1, gap
-1). The score is the best alignment's share of a full match's; a pair is
contaminated from ``threshold`` on, when it has the worth of ``least_words``
matches. A shorter item needs all its words but for one edit, and with fewer than
six, where an edit may leave no seed, all of them; an item of one or two words is
only found in a document that has no other words. A passage that shares too few words with
the item for that, in any order, isn't aligned; nothing is lost by it.

The test items are dealt by a hash into blocks of about ``block_items`` items or
``block_bytes`` of text at most, each broadcast and scanned against all documents, so
memory stays bounded for any benchmark. No document is shuffled.

Edge cases: null or wordless items match nothing; null or empty documents match
nothing; equal items are each reported; repeated rows are reported each; of equally
good alignments the first passage's counts; very long texts are aligned passage by
passage; an empty table gives no rows. contaminated_pairs() reads doc_id and text
only; extra document columns pass through clean_documents().
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import Memo, slices

SEED = 3
THRESHOLD = 0.5
LEAST_WORDS = 8
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 8 << 20
_PUNCT = re.compile(r"[\W_]+")


def plain_word(word: str) -> str:
    word = word.strip(".,!?;:").lower()
    return word if word.isalpha() else _PUNCT.sub("", word)


class Items:
    """A block of test items: word ids, and seeds with the places they have in items."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int = SEED):
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in rows:
            words = [w for w in map(plain_word, (text or "").split()) if w]
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            k = min(n, len(ids))
            for at in range(len(ids) - k + 1):
                places[tuple(ids[at : at + k])].append((len(self.items), at))
            self.items.append((item_id, np.array(ids, np.int64)))
        self.grams = sorted(places)
        self.base = len(self.vocab) + 1
        where = [places[g] for g in self.grams]
        self.n_places = np.array([len(w) for w in where], np.int64)
        self.first_place = np.cumsum(self.n_places) - self.n_places
        self.place_item, self.place_at = np.array([p for w in where for p in w], np.int64).reshape(-1, 2).T.copy()
        self.lengths = np.array([len(w) for _, w in self.items], np.int64)
        self.words = np.concatenate([w for _, w in self.items]) if self.items else np.zeros(0, np.int64)
        self.first_word = np.cumsum(self.lengths) - self.lengths
        self.by_length = {}
        for k in {len(g) for g in self.grams}:
            seeds = np.array([i for i, g in enumerate(self.grams) if len(g) == k], np.int64)
            codes = np.array([self._code(self.grams[i]) for i in seeds], np.uint64)
            order = np.argsort(codes)
            self.by_length[k] = (codes[order], seeds[order])

    def _code(self, gram: tuple) -> int:
        code = 0
        for x in gram:
            code = (code * self.base + x) % 2**64
        return code

    def memo(self) -> Memo:
        """Raw token -> word id, 0 for words of no item, -1 for tokens without a letter or digit."""
        return Memo(lambda raw: self.vocab.get(w, 0) if (w := plain_word(raw)) else -1)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seeds) of the seeds in a document's word ids."""
        at, seed = [], []
        for k, (codes, seeds) in self.by_length.items():
            if len(ids) < k:
                continue
            some = ids[: len(ids) - k + 1] > 0
            for j in range(1, k):
                some &= ids[j : len(ids) - k + 1 + j] > 0
            pos = np.nonzero(some)[0]
            if not len(pos):
                continue
            code = np.zeros(len(pos), np.uint64)
            for j in range(k):
                code = code * np.uint64(self.base) + ids[pos + j].astype(np.uint64)
            slot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            found = codes[slot] == code
            at.append(pos[found])
            seed.append(seeds[slot[found]])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(seed)

    def passages(self, ids: np.ndarray, need: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to): stretches of the document that hits of an item point at, and that could score need[item]."""
        pos, seed = self.hits(ids)
        if not len(pos):
            return []
        hit, slot = _ranges(self.first_place[seed], self.n_places[seed])
        item, start = self.place_item[slot], pos[hit] - self.place_at[slot]
        # a score is at most twice the words in common; first for the whole document
        here = np.zeros(self.base, bool)
        here[ids] = True
        some, own = np.unique(item, return_inverse=True)
        k, slot = _ranges(self.first_word[some], self.lengths[some])
        can = 2 * np.bincount(k, here[self.words[slot]], minlength=len(some)) >= need[some]
        item, start = item[can[own]], start[can[own]]
        order = np.lexsort((start, item))
        starts = defaultdict(list)
        for i, x in zip(item[order].tolist(), start[order].tolist()):
            starts[i].append(x)
        out = []
        here[:] = False
        for i, s in starts.items():
            words = self.items[i][1]
            n = len(words)
            slack = n // 2 + 2
            first = prev = s[0]
            for x in [*s[1:], None]:
                if x is not None and x - first <= n:
                    prev = x
                    continue
                a, b = max(0, first - slack), min(len(ids), prev + n + slack)
                first = prev = x
                here[words] = True
                common = here[ids[a:b]].sum()
                here[words] = False
                if 2 * common >= need[i]:
                    here[ids[a:b]] = True
                    common = here[words].sum()
                    here[ids[a:b]] = False
                    if 2 * common >= need[i]:
                        out.append((i, a, b))
        return out


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, first[k] + 0 .. n[k] - 1) of every k, one after the other."""
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - (np.cumsum(n) - n)[k] + first[k]


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of the item with each row of word ids (padded with -2), and its last word + 1."""
    b, n = passages.shape
    j = np.arange(n + 1)
    h = np.zeros((b, n + 1), np.int64)
    best, end = np.zeros(b, np.int64), np.zeros(b, np.int64)
    for word in item.tolist():
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(h[:, :-1] + np.where(passages == word, 2, -1), h[:, 1:] - 1)
        h = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + j, axis=1) - j, 0)
        top = h.argmax(axis=1)
        score = h[np.arange(b), top]
        end = np.where(score > best, top, end)
        best = np.maximum(best, score)
    return best, end


def align_passages(items: Items, docs: list[np.ndarray], threshold: float, least_words: int) -> list[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, last word + 1) of the contaminated pairs, best passage each."""
    n = items.lengths
    needs = np.maximum(threshold * 2 * n, np.minimum(2 * n - 3 * (n >= 2 * SEED), 2 * least_words))
    by_item = defaultdict(list)
    for d, ids in enumerate(docs):
        for item, a, b in items.passages(ids, needs):
            if n[item] >= SEED or len(ids) == n[item]:
                by_item[item].append((d, a, b))
    found: dict[tuple[int, int], tuple] = {}
    for item, where in by_item.items():
        item_id, words = items.items[item]
        need = needs[item]
        where.sort(key=lambda x: x[2] - x[1])
        for at in range(0, len(where), 256):
            part = where[at : at + 256]
            rows = np.full((len(part), max(b - a for _, a, b in part)), -2, np.int64)
            for r, (d, a, b) in enumerate(part):
                rows[r, : b - a] = docs[d][a:b]
            score, end = align(words, rows)
            for r in np.nonzero(score >= need)[0]:
                d, a, _ = part[r]
                back, first = align(words[::-1], rows[r : r + 1, : end[r]][:, ::-1])
                share = float(score[r]) / (2 * len(words))
                now = (share, a + int(end[r]) - int(first[0]), a + int(end[r]))
                if now[0] > found.get((d, item), (-1.0,))[0]:
                    found[d, item] = now
    return [(d, items.items[item][0], *x) for (d, item), x in sorted(found.items())]


def _texts(batch: pa.RecordBatch, memo: Memo) -> Iterator[np.ndarray]:
    get = memo.__getitem__
    for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
        ids = np.fromiter(map(get, t.split()), np.int64) if t else np.zeros(0, np.int64)
        yield ids[ids >= 0]


def _blocks(docs: DataFrame, benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator:
    """A broadcast block of items at a time, with all its seeds."""
    size = benchmark.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(-(-size.n // block_items), -(-size.bytes // block_bytes))
    for k in range(n_blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else benchmark
        items = Items([tuple(r) for r in part.select(F.col("item_id").cast("long"), "text").collect()])
        if items.items:
            yield docs.sparkSession.sparkContext.broadcast(items)


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per contaminated (document, item): doc_id, item_id, score (to 1), first_word, end_word."""
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in _blocks(docs, benchmark, block_items, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            memo = sent.value.memo()
            for batch in (part for whole in batches for part in slices(whole)):
                ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                rows = [(ids[d], *x) for d, *x in align_passages(sent.value, list(_texts(batch, memo)), threshold, least_words)]
                cols = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "score", "first_word", "end_word"])

        out = out.union(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return out


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents without a contaminated pair, all columns, in one pass over each block of items."""
    for sent in _blocks(docs, benchmark, block_items, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            memo = sent.value.memo()
            for batch in (part for whole in batches for part in slices(whole)):
                hit = {d for d, *_ in align_passages(sent.value, list(_texts(batch, memo)), threshold, least_words)}
                yield batch.filter(pa.array([d not in hit for d in range(batch.num_rows)], pa.bool_())) if hit else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
