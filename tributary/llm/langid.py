"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a single space, and
bigrams and trigrams (with the spaces at word ends) are hashed into ``buckets``.
Counting covers every training document: each task adds up one count row per
language and returns its non-zero cells, which are summed by key. The
log-probability matrix (buckets x languages) is broadcast after a check of its
size; scoring gathers its rows for a batch's n-grams and sums them per document.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing was learned; documents without a language teach nothing;
ties go to the language first in order of name; repeated rows count each time; very
long texts are read whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import columns
from tributary.session import materialize

BUCKETS = 1 << 15
SMOOTHING = 0.1
#: Of a cell the driver holds three collected numbers, the counts, their logarithms and the matrix that is sent.
CELL_BYTES = 48
MAX_MODEL_MB = 512
UNDETERMINED = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, positions in texts) of all n-grams, in order of position."""
    low = [" " + t.lower() + " " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    alpha = _letters()[code]
    c = np.where(alpha, code, np.uint32(32))
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]  # one space after each run of letters
    keep[:-1] |= alpha[1:] & ~alpha[:-1]  # and one before it
    space = ~alpha & keep
    keep[1:] &= ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    c, doc = c[keep].astype(np.uint32), doc[keep]
    if len(c) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.uint32(32 - (buckets - 1).bit_length())
    two = (c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> shift
    three = ((c[:-2] * np.uint32(0x27D4EB2F) ^ c[1:-1] * np.uint32(0x165667B1)) + c[2:] * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA77) >> shift
    in2, in3 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    bucket = np.concatenate([two[in2], three[in3]]).astype(np.int64)
    at = np.concatenate([doc[:-1][in2], doc[:-2][in3]])
    order = np.argsort(at, kind="stable")
    return bucket[order], at[order].astype(np.int64)


def count_ngrams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over docs with a language; bucket -1 counts its documents with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for langs, texts in columns(batches, "lang", "text"):
            for at in range(0, len(texts), 200):
                part, names = texts[at : at + 200], langs[at : at + 200]
                bucket, doc = ngrams([t or "" for t in part], buckets)
                known = sorted(set(names))
                code = np.array([known.index(x) for x in names])
                if not len(bucket):
                    continue
                n = np.bincount(code[doc] * buckets + bucket, minlength=len(known) * buckets).reshape(-1, buckets)
                has = np.unique(doc)
                for i, lang in enumerate(known):
                    row = held.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    row[:-1] += n[i]
                    row[-1] += int((code[has] == i).sum())
        for lang, row in held.items():
            hit = np.nonzero(row)[0]
            where = np.where(hit == buckets, -1, hit)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(where), pa.array(row[hit])], ["lang", "bucket", "n"])

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order of name, log priors, and the log-probability matrix (buckets x languages)."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, logp

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        bucket, doc = ngrams([t or "" for t in texts], len(self.logp)) if self.langs else (np.zeros(0, np.int64),) * 2
        if not len(bucket):
            return names, score
        starts = np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1])
        ends = np.append(starts[1:], len(doc))
        total = np.zeros((len(starts), len(self.langs)))
        first = 0
        while first < len(starts):  # about 400,000 gathered rows at a time, or one document
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + 400_000, "right")))
            a, b = starts[first], ends[last - 1]
            total[first:last] = np.add.reduceat(self.logp[bucket[a:b]], starts[first:last] - a, axis=0, dtype=np.float64)
            first = last
        total += self.prior
        best = total.argmax(axis=1)
        p = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for d, k, q in zip(doc[starts], best, p):
            names[d], score[d] = self.langs[k], q
        return names, score


def fit(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Model:
    """Learn from all rows of docs that have a language; the model's size is checked before it is collected."""
    counts = materialize(count_ngrams(docs, buckets), "ngrams")
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").limit((MAX_MODEL_MB << 20) // (CELL_BYTES * buckets) + 1).collect()]
    if len(langs) * buckets * CELL_BYTES > MAX_MODEL_MB << 20:
        raise ValueError(f"{len(langs)} languages x {buckets} buckets exceed {MAX_MODEL_MB} MB; use fewer buckets")
    n = np.zeros((len(langs), buckets))
    seen = np.zeros(len(langs))
    code = F.array_position(F.lit(langs), F.col("lang")) - 1 if langs else F.lit(0)
    table = counts.select(code.cast("int").alias("lang"), F.col("bucket").cast("int"), "n").toArrow()
    row, col, val = (table.column(k).to_numpy() for k in range(3))
    n[row[col >= 0], col[col >= 0]] = val[col >= 0]
    seen[row[col < 0]] = val[col < 0]
    p = n + smoothing
    p /= p.sum(axis=1, keepdims=True)
    prior = np.log(np.maximum(seen, 1e-9) / max(seen.sum(), 1.0))
    return Model(langs, prior, np.ascontiguousarray(np.log(p).T.astype(np.float32)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior probability) of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            for at in range(0, len(ids), 200):
                names, score = sent.value.predict(texts[at : at + 200])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 200], pa.int64()), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).cast("binary")) % folds
