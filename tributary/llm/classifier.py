"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is quality + (1 - toxic): 2 for clean, 1 with one defect, 0 with both.
P(rating <= k) = sigmoid(threshold_k - w.x), with ordered thresholds and one
weight vector for all grades; x holds hashed words (present or not) and hashed
word shapes (share of the words). The score gives each document its expected
grade and the tail probability P(rating >= 2), by which it is kept.

Training uses at most ``sample`` labelled documents, those with the least hash of
doc_id, and of these as many as fit ``sample_mb`` megabytes of features, in the same
order (both bounds are parameters; scoring covers every document). A doc_id that
several rows have trains once, by the row whose features have the least hash. A bucket that
fewer than ``min_docs`` of them have is not used, so that single documents are
not learned by heart, nor is a word bucket that more than MAX_SHARE of them have,
so that long texts don't outweigh a telling word by common ones, unless its
documents' mean rating departs from the overall mean by LEAST_GAP standard
deviations (a hot source's own words are telling, however many), nor one whose
documents' mean rating is within LEAST_Z standard errors of the overall mean.

Edge cases: labels with a null are ignored, and the lowest rating of a document
counts; a null text has no features and gets the thresholds' own probabilities;
without labels, or with one grade only, everything scores as that grade (2 if
none); repeated rows are scored alike; equal hashes are ordered by doc_id; very long
texts are read whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import Memo, columns, hash_bound
from tributary.session import materialize

BUCKETS = 1 << 17
SAMPLE = 12_000
SAMPLE_MB = 200
MIN_DOCS = 8
MAX_SHARE = 0.1
LEAST_Z = 4.0
LEAST_GAP = 0.5
GRADES = 3
TAIL = 0.7
SHAPE_SCALE = 4.0
_EDGES = re.compile(r"^\W+|\W+$")


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def token_buckets(token: str, buckets: int = BUCKETS) -> tuple[int, int]:
    """(word bucket in the lower half, shape bucket in the upper half)."""
    word = _EDGES.sub("", token)
    marks = token[len(token.rstrip("!#$%&*|<>.,;:?")) :][:2]
    case = "U" if len(word) > 1 and word.isupper() else "l" if word.islower() else "-" if not word else "m"
    half = buckets // 2
    if token[:1] == " ":  # no token, but a trait of the whole text
        return 0, half + _hash(token) % half
    return _hash(word.lower()) % half, half + _hash(case + marks) % half


def featurize(text: str | None, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    both = np.array([memo[t] for t in tokens], np.int64)
    word = np.unique(both[:, 0])
    shape, n = np.unique(both[:, 1], return_counts=True)
    whole = memo[f" length {len(tokens).bit_length()}"][1], memo[f" repeated {10 * (len(tokens) - len(word)) // len(tokens)}"][1]
    at = np.concatenate([word, shape, whole])
    return at, np.concatenate([np.ones(len(word)), SHAPE_SCALE * n / len(tokens), np.ones(2)]).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halving steps; f gives value and gradient."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, coef = -g, []
        for s, y in reversed(past):
            coef.append((s @ d) / (s @ y))
            d = d - coef[-1] * y
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), c in zip(past, reversed(coef)):
            d = d + (c - (y @ d) / (s @ y)) * s
        step, slope = 1.0 if past else 1.0 / max(1.0, np.abs(g).max()), g @ d
        while True:
            new = x + step * d
            v, ng = f(new)
            if v <= value + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - x, ng - g
        done = value - v <= 1e-7 * abs(value)
        x, value, g = new, v, ng
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        if done:
            break
    return x


def likelihood(doc: np.ndarray, slot: np.ndarray, val: np.ndarray, y: np.ndarray, k: int, l2: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Penalised mean negative log-likelihood and its gradient, of (k weights, first threshold, logs of the gaps to the next ones).

    Entry i of the features says that document doc[i] has val[i] of weight slot[i]; y holds the grades.
    """
    n = len(y)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, low, gap = x[:k], x[k], np.exp(x[k + 1 :])
        edge = np.concatenate([[-1e9], low + np.concatenate([[0], np.cumsum(gap)]), [1e9]])
        s = np.bincount(doc, w[slot] * val, minlength=n)
        hi, lo = _sigmoid(edge[y + 1] - s), _sigmoid(edge[y] - s)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
        ge = np.bincount(y, dlo, minlength=GRADES + 1) + np.bincount(y + 1, -dhi, minlength=GRADES + 1)
        gw = np.bincount(slot, (dhi - dlo)[doc] * val, minlength=k) + l2 * w
        gt = [ge[1:-1].sum(), *(ge[j + 2 : -1].sum() * gap[j] for j in range(GRADES - 2))]
        return float(-np.log(p).mean() + l2 / 2 * w @ w), np.concatenate([gw, gt])

    return loss


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def grades(self, signal: np.ndarray) -> np.ndarray:
        """P(rating = k), one row per signal w.x."""
        below = _sigmoid(self.thresholds - signal[:, None])
        return np.diff(np.concatenate([np.zeros((len(signal), 1)), below, np.ones((len(signal), 1))], axis=1), axis=1)

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, buckets: int = BUCKETS, min_docs: int = MIN_DOCS, least_z: float = LEAST_Z, rounds: int = 100, l2: float = 1e-5, max_share: float = MAX_SHARE) -> Ordinal:
        """Penalised maximum likelihood."""
        sizes = np.array([len(r[0]) for r in rows], np.int64)
        col = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
        val = np.concatenate([r[1] for r in rows]).astype(np.float64) if rows else np.zeros(0)
        doc = np.repeat(np.arange(len(rows)), sizes)
        df = np.bincount(col, minlength=buckets)
        often = df >= min_docs
        if len(rows):  # how far the documents of a bucket depart from all in their mean rating
            gap = np.abs(np.bincount(col, y[doc], minlength=buckets) / np.maximum(df, 1) - y.mean()) / max(float(y.std()), 1e-9)
            often &= (df <= max_share * len(rows)) | (np.arange(buckets) >= buckets // 2) | (gap >= LEAST_GAP)
            often &= gap * np.sqrt(df) >= least_z
        col, val, doc = col[often[col]], val[often[col]], doc[often[col]]
        n = len(rows)
        if n == 0 or len(set(y.tolist())) < 2:
            only = int(y[0]) if n else GRADES - 1
            return cls(np.zeros(buckets), np.where(np.arange(GRADES - 1) < only, -40.0, 40.0))
        share = np.clip(np.cumsum(np.bincount(y, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
        t = np.log(share / (1 - share))
        a, gaps = t[0], np.log(np.maximum(np.diff(t), 1e-2))
        used, slot = np.unique(col, return_inverse=True)
        k = len(used)
        loss = likelihood(doc, slot, val, y, k, l2)
        x = minimize(loss, np.concatenate([np.zeros(k), [a], gaps]), rounds)
        w = np.zeros(buckets)
        w[used] = x[:k]
        return cls(w, x[k] + np.concatenate([[0], np.cumsum(np.exp(x[k + 1 :]))]))


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and rating of every fully labelled document."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("long").alias("rating"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_mb: float = SAMPLE_MB, buckets: int = BUCKETS) -> Ordinal:
    """Train on at most ``sample`` labelled documents of docs, with at most ``sample_mb`` of features."""
    rated = ratings(labels).where("rating BETWEEN 0 AND 2")
    # about twice the sample is drawn by the hash first, so that what meets in one place doesn't grow with the labels
    share = min(1.0, 2 * sample / max(labels.count(), 1))
    rated = rated.where(F.xxhash64("doc_id") <= hash_bound(share))
    picked = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda t: token_buckets(t, buckets))
        for ids, grades, texts in columns(batches, "doc_id", "rating", "text"):
            x = [featurize(t, memo) for t in texts]
            cols = [pa.array(ids, pa.int64()), pa.array(grades, pa.int64()), pa.array([a.astype("<i4").tobytes() for a, _ in x], pa.binary()), pa.array([b.astype("<f4").tobytes() for _, b in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rating", "at", "value"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "rating", "text")
    rows = rows.mapInArrow(run, "doc_id long, rating long, at binary, value binary")
    one = F.min_by(F.struct("rating", "at", "value"), F.struct(F.xxhash64("at", "value"), "at", "value")).alias("x")
    rows = materialize(rows.groupBy("doc_id").agg(one).select(F.xxhash64("doc_id").alias("order"), "doc_id", "x.*"), "rated")
    size = rows.select("order", "doc_id", (2 * F.octet_length("at")).alias("bytes")).orderBy("order", "doc_id").collect()  # at most ``sample`` rows
    room = int(np.searchsorted(np.cumsum([r["bytes"] for r in size]), sample_mb * 2**20, "right"))
    if room < len(size):
        last = size[room]
        rows = rows.where((F.col("order") < last["order"]) | ((F.col("order") == last["order"]) & (F.col("doc_id") < last["doc_id"])))
    got = rows.orderBy("order", "doc_id").collect()
    x = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4")) for r in got]
    return Ordinal.fit(x, np.array([r["rating"] for r in got], np.int64), buckets)


def score(docs: DataFrame, model: Ordinal, tail: float = TAIL) -> DataFrame:
    """doc_id, expected_grade, p_clean = P(rating >= 2), kept, of every row of docs."""
    buckets = len(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        memo = Memo(lambda t: token_buckets(t, buckets))
        for ids, texts in columns(batches, "doc_id", "text"):
            x = [featurize(t, memo) for t in texts]
            p = held.grades(np.array([float(held.weights[a] @ b) for a, b in x]))
            cols = [pa.array(ids, pa.int64()), pa.array(p @ np.arange(GRADES)), pa.array(p[:, -1]), pa.array(p[:, -1] >= tail)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "expected_grade", "p_clean", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_clean double, kept boolean")
