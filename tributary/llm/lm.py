"""Language-model scoring by subword lattice likelihood.

The pieces are those of a public subword vocabulary (32 thousand, with bytes as
a fallback). A word's probability is the sum over all its segmentations of the
product of piece probabilities, by a forward recursion in log space. The model's
piece weights are half the vocabulary's own (``vocab_share``; its scores are merge
ranks, read as Zipf weights) and half the pieces' share of all training words as the
vocabulary cuts them, so the vocabulary weighs the same in a corpus of any size.
vocab_score is the same likelihood by the vocabulary's weights alone. A document's
log probability is the sum over its words and one end mark, a piece of its own.

Steps: (1) tasks count words, summed by key over all documents; (2) piece counts
are added up over the distinct training words; (3) each distinct word gets its
training count and its lattice likelihoods once; (4) documents look up the
most frequent words (at most ``head``, with HEAD_BYTES each on average: a bounded
broadcast), and send their other distinct words to a join by word; sums are taken per
document. A word that many documents have is in the head, so the join has no hot key.

Words are non-white-space with A-Z lower-cased, as in the base score: sum of
log10((c + 1) / (N + V + 1)) with c, N, V the token's count, all tokens and
distinct tokens of the training documents; the end counts as a token.

Edge cases: a null text is the end alone; a null doc_id belongs to whatever fold
it gets; repeated rows are scored each; very long texts and words are read whole, with
memory by the longest piece; words of equal frequency are in the head together or not
at all; without training documents the vocabulary alone is the model (N = V = 0); an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import ascii_words, columns
from tributary.session import discard, materialize

HEAD = 150_000
HEAD_BYTES = 64
VOCAB_SHARE = 0.5
FLUSH = 300_000
LN10 = math.log(10.0)
SPACE = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Piece log probabilities (natural), by the model and by the vocabulary alone, and the lattice over them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.path = path
        sp = SentencePieceProcessor(model_file=path)
        self.n = sp.get_piece_size()
        score = np.array([sp.get_score(i) for i in range(self.n)])
        plain = np.array([not (sp.is_control(i) or sp.is_unknown(i)) for i in range(self.n)])
        rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
        zipf = np.where(plain, 1.0 / (rank + 2.7), 0.0)
        self.zipf = np.append(zipf, zipf.max())  # the end mark, as likely as the first piece
        self.zipf /= self.zipf.sum()
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.trie: dict = {}
        self.longest = 1
        for i in range(self.n):
            if plain[i] and not sp.is_byte(i):
                node, piece = self.trie, sp.id_to_piece(i)
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = i
                self.longest = max(self.longest, len(piece))
        with np.errstate(divide="ignore"):
            self.own = np.log(self.zipf).tolist()
        self.set_counts(np.zeros(self.n + 1))

    def set_counts(self, counts: np.ndarray, vocab_share: float = VOCAB_SHARE) -> None:
        """Mix the vocabulary's weights with the pieces' shares of all counts; without counts they stand alone."""
        total = counts.sum()
        with np.errstate(divide="ignore"):
            self.logp = np.log(vocab_share * self.zipf + (1 - vocab_share) * counts / total).tolist() if total else list(self.own)
        self.ends = self.logp[-1], self.own[-1]

    def word(self, word: str) -> tuple[float, float]:
        """Log probabilities of a word, summed over all its segmentations: by the model, by the vocabulary alone."""
        s, logp, own = SPACE + word, self.logp, self.own
        n = len(s)
        ahead: deque[list] = deque([] for _ in range(self.longest + 1))  # arcs into the next places
        a = b = 0.0
        for i in range(n):
            node, k, alone = self.trie, 0, False
            while i + k < n and (node := node.get(s[i + k])) is not None:
                k += 1
                if (piece := node.get("")) is not None:
                    ahead[k].append((a + logp[piece], b + own[piece]))
                    alone = alone or k == 1
            if not alone:  # no piece of this character: its bytes
                raw = [self.byte[x] for x in s[i].encode("utf-8", "replace")]
                ahead[1].append((a + sum(logp[x] for x in raw), b + sum(own[x] for x in raw)))
            ahead.popleft()
            ahead.append([])
            arcs = ahead[0]
            if len(arcs) == 1:
                a, b = arcs[0]
            else:
                (a, b), exp = map(max, zip(*arcs)), math.exp
                x = y = 0.0
                for p, q in arcs:
                    x += exp(p - a)
                    y += exp(q - b)
                a, b = a + math.log(x), b + math.log(y)
        return a, b


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, train, every): how often each word occurs in training documents and in all; train is a column of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, every = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(every)
            cols = [pa.array(words, pa.binary()), pa.array([train.get(w, 0) for w in words], pa.int64()), pa.array([every[w] for w in words], pa.int64())]
            train.clear(), every.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "train", "every"])

        for learn, texts in columns(batches, "train", "text"):
            for t, x in zip(texts, learn):
                words = ascii_words(t)
                every.update(words)
                if x:
                    train.update(words)
                if len(every) > FLUSH:
                    yield flush()
        yield flush()

    rows = docs.select("train", "text").mapInArrow(run, "word binary, train long, every long")
    return rows.groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


def piece_counts(vocab: DataFrame, pieces: Pieces) -> np.ndarray:
    """Occurrences of each piece in the training words, as the vocabulary cuts them."""
    path, n = pieces.path, pieces.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        total = np.zeros(n, np.int64)
        for words, counts in columns(batches, "word", "train"):
            ids = sp.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for i in ids for x in i), np.int64, int(sizes.sum()))
            total += np.bincount(flat, np.repeat(np.array(counts, np.float64), sizes), minlength=n).astype(np.int64)
        hit = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["piece", "n"])

    rows = vocab.where("train > 0").select("word", "train").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    out = np.zeros(n + 1)
    for r in rows.collect():  # at most one row a piece
        out[r.piece] = r.n
    return out


def with_likelihood(vocab: DataFrame, pieces: Pieces) -> DataFrame:
    """vocab with lattice and plain: the log10 probability of each word by the model and by the vocabulary alone."""
    sent = vocab.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likelihood = sent.value.word
        for batch in batches:
            both = np.array([likelihood(w.decode("utf-8", "replace")) for w in batch.column(0).to_pylist()], np.float64).reshape(-1, 2) / LN10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both[:, 0]), pa.array(both[:, 1])], ["word", "train", "every", "lattice", "plain"])

    return vocab.select("word", "train", "every").mapInArrow(run, "word binary, train long, every long, lattice double, plain double")


def frequent(vocab: DataFrame, head: int, word_bytes: int = HEAD_BYTES) -> DataFrame:
    """The words above a count that at most ``head`` of them reach, with ``head * word_bytes`` bytes at most.

    The count is found from a histogram over classes of counts (sixteenths of a
    power of two), so what reaches the driver depends on head alone, not on how
    many partitions the vocabulary has.
    """
    classed = vocab.withColumn("class", F.floor(F.log2("every") * 16))
    left, room, least = head, head * word_bytes, None
    size = classed.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("bytes"))
    for r in sorted(size.collect(), reverse=True):
        left, room = left - r["n"], room - r["bytes"]
        if left < 0 or room < 0:
            break
        least = r["class"]
    return classed.where(F.lit(False) if least is None else F.col("class") >= least)


def score_documents(docs: DataFrame, held_out: str = "held_out", pieces: str | None = None, vocab_share: float = VOCAB_SHARE, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocab_score of every row of docs.

    Rows whose ``held_out`` column is true teach nothing.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), "text", F.col(held_out).alias("held_out"), (~F.col(held_out)).alias("train"))
    model = Pieces(pieces or default_pieces())
    counted = materialize(word_counts(d), "words")
    counts = piece_counts(counted, model)
    ends = d.where("train").count()
    counts[-1] = ends
    model.set_counts(counts, vocab_share)
    vocab = materialize(with_likelihood(counted, model), "vocab")
    discard(counted)
    total = vocab.where("train > 0").agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total.n + ends, total.v + (ends > 0)
    first = frequent(vocab, head).select("word", "train", "lattice", "plain")
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    table = {bytes(w): (int(c > 0), base(c), x, y) for w, c, x, y in first.toPandas().itertuples(index=False)}
    sent = spark.sparkContext.broadcast((table, (int(ends > 0), base(ends), *(x / LN10 for x in model.ends))))
    kinds = {"row": "long", "doc_id": "long", "held_out": "boolean", "word": "binary", "tf": "long", "n_tokens": "long", "n_known": "long", "base": "double", "score": "double", "vocab": "double"}
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = sent.value
        row = TaskContext.get().partitionId() << 40
        for ids, held, texts in columns(batches, "doc_id", "held_out", "text"):
            for at in range(0, len(ids), 200):
                out: list[list] = [[] for _ in kinds]
                for doc, h, t in zip(ids[at : at + 200], held[at : at + 200], texts[at : at + 200]):
                    words = ascii_words(t)
                    met = list(map(known.get, words))
                    hits = np.array([x for x in met if x is not None], np.float64).reshape(-1, 4).sum(axis=0) + end
                    # a key with a space is no word; it deals the documents' own rows evenly
                    line = [row, doc, h, b" %d" % row, 0, len(words) + 1, int(hits[0]), *hits[1:].tolist()]
                    rest = Counter(w for w, x in zip(words, met) if x is None)
                    for col, x in zip(out, line):
                        col.append(x)
                    m = len(rest)
                    for col, x in zip(out, ([row] * m, [None] * m, [None] * m, rest.keys(), rest.values(), [0] * m, [0] * m, *[[0.0] * m] * 3)):
                        col.extend(x)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(out, kinds.values())], list(kinds))

    rows = d.select("doc_id", "held_out", "text").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()))
    tail = rows.join(vocab.select("word", "train", "lattice", "plain"), "word", "left")
    plus = lambda have, each: F.col(have) + F.col("tf") * F.coalesce(each, F.lit(0.0))
    got = tail.select(
        "row",
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.when(F.col("train") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        plus("base", F.log10((F.col("train") + 1) / F.lit(float(n + v + 1)))).alias("base"),
        plus("score", F.col("lattice")).alias("score"),
        plus("vocab", F.col("plain")).alias("vocab"),
    )
    sums = got.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
        F.sum("vocab").alias("vocab_score"),
    )
    return sums.drop("row")
