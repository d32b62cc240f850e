"""Personal data: fixed patterns, and a skip-chain conditional random field on top.

The patterns (email, ip, card, phone) are matched leftmost and without overlap
per kind; a card must pass the Luhn test. They give the base spans, which stay.

The field's nodes are the white-space tokens that hold a digit or an at-sign.
Labels are the four kinds and "other". Unary potentials come from hashed shape
features; neighbouring tokens share a transition potential; and tokens of a document
with the same content key (letters and digits only; of mostly-digit tokens the last
nine digits) are linked along their occurrences by a skip potential. Values with fewer
than seven letters and digits have a key only where a base span has the same groups
of them, so that 10-0-0-1 follows 10.0.0.1, and 10001 doesn't; neighbouring tokens whose
digits together end a base span's, nine or more, have that span's key. Base tokens are
evidence; every other occurrence is also linked to the nearest evidence of its key on
both sides, so that distance doesn't matter. Loopy belief propagation runs over all
documents of a batch at once, in each until its messages settle (in at most 100 rounds
and four for each of its nodes, as loops may swing for ever); runs of tokens that are
more likely of one kind than not, one of them by at least ``belief``, and that meet no
base span become added spans. So a number written once as the pattern has it is found again where it
is written otherwise.

Training is joint, by penalised pseudo-likelihood of all potentials, and needs no labels
by hand: base spans give them. What the skip links carry is learned from masked evidence:
of each base span pairs of copies with other separators, which no pattern need match, are
put behind the training text, one as it is and labelled, one with other digits and
letters and labelled "other". They look alike, so only the link tells them apart.
Tokens that merely share a key with a base span are neither targets nor evidence, as their
label is what is to be found; all others are "other". Training
uses the candidate tokens of at most ``sample`` documents that have one, those with
the least hash of doc_id and text, drawn by another hash from OVERSAMPLE times as
many, and at most ``doc_tokens`` tokens of each, chosen by a hash of what they say,
so that repeats stay together over the whole text; this is the only place where a
bound is set.
Detection reads every text whole.

Edge cases: a null text is empty and has no span; without any candidate in the
table only the patterns are used; repeated rows are treated alike, and so are rows with
equal hashes; very long texts are read whole; a null doc_id is kept; an empty table gives
no rows. find_pii() reads doc_id and text only; mask() keeps every other column as it is.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.classifier import minimize
from tributary.llm.text import columns, hash_bound, slices

#: The kinds in their order, and what a match looks like.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NOT_ALNUM = re.compile(r"[\W_]+")

OTHER = len(KINDS)
LABELS = len(KINDS) + 1
BUCKETS = 1 << 14
N_FEATURES = 8
L2 = 1e-5
SAMPLE = 2_000
DOC_TOKENS = 200
#: Of the documents with a candidate so many times ``sample`` are looked at, by a hash, so that what is sent to the driver doesn't grow.
OVERSAMPLE = 2
#: In training, neighbours stay together up to so many, and one key has at most this part of a text's tokens.
RUN = 16
KEY_PART = 4
BELIEF = 0.9
#: A value over several tokens has at most so many of them, and at least so many digits.
MOST_PARTS = 6
LEAST_DIGITS = 9
#: Separators that masked copies of base spans are written with.
SEPARATORS = ("-", ".", "/", "_", "", " ")
#: Ways in which each base span is copied; 5 steps through the separators lead to others, and to other parts.
COPIES = 3
#: What a training node is: unknown, base evidence, a masked copy, or no personal data.
UNKNOWN, EVIDENCE, MASKED, PLAIN = range(4)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; start and end in code points."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((0, a, m.end()))
                done = m.end()
    if _SIGN.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def content_key(token: str) -> str:
    """What linked tokens have in common; empty for tokens too short to tell."""
    plain = _NOT_ALNUM.sub("", token).lower()
    digits = _NOT_DIGIT.sub("", plain)
    if 2 * len(digits) > len(plain) and len(digits) >= 7:
        return digits[-9:]
    return plain if len(plain) >= 7 else ""


def short_key(value: str) -> str:
    """Of a value too short for content_key: its groups of letters and digits."""
    return "" if content_key(value) else " ".join(_NOT_ALNUM.sub(" ", value).lower().split())


def _shape(token: str) -> str:
    kinds = "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in token)
    return re.sub(r"(.)\1+", r"\1\1", kinds)


def _features(tokens: list[str], i: int) -> list[int]:
    t = tokens[i]
    digits = sum("0" <= c <= "9" for c in t)
    names = (
        "s" + _shape(t),
        f"d{min(digits, 20)}",
        f"l{min(len(t), 30)}",
        f"@{t.count('@')}.{min(t.count('.'), 5)}",
        "a" + t[:1],
        f"k{_shape(t[:3])}|{_shape(t[-3:])}",
        "p" + (_shape(tokens[i - 1]) if i and _SIGN.search(tokens[i - 1]) else "-"),
        "n" + (_shape(tokens[i + 1]) if i + 1 < len(tokens) and _SIGN.search(tokens[i + 1]) else "-"),
    )
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def links(keys: list[str], sure: list[bool]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(skip, far): each key's occurrences in a row, and of every occurrence that isn't sure the nearest sure ones."""
    last: dict[str, int] = {}
    skip = []
    for x, key in enumerate(keys):
        if key:
            if key in last:
                skip.append((last[key], x))
            last[key] = x
    far, near = [], set(skip)
    for order in (range(len(keys)), reversed(range(len(keys)))):
        known: dict[str, int] = {}
        for x in order:
            if keys[x] and sure[x]:
                known[keys[x]] = x
            elif keys[x] in known and (edge := (min(x, known[keys[x]]), max(x, known[keys[x]]))) not in near:
                far.append(edge)
    return skip, far


def _join_parts(keys: list[str], tokens: list[str], chained: set[int], free: list[bool], whole: set[str]) -> None:
    """Give neighbouring free tokens whose digits together end a whole number that number's key; the longest run first."""
    by_end: dict[str, list[str]] = {}
    for w in whole:
        by_end.setdefault(w[-LEAST_DIGITS:], []).append(w)
    digits = [_NOT_DIGIT.sub("", t) for t in tokens]
    x = 0
    while x < len(tokens):
        most = x + 1
        while most < min(x + MOST_PARTS, len(tokens)) and most - 1 in chained and free[most]:
            most += 1
        for end in range(most, x + 1, -1):
            value = "".join(digits[x:end])
            if free[x] and all(digits[x:end]) and len(value) >= LEAST_DIGITS and any(w.endswith(value) for w in by_end.get(value[-LEAST_DIGITS:], ())):
                keys[x:end] = [value[-LEAST_DIGITS:]] * (end - x)
                x = end - 1
                break
        x += 1


def nodes(text: str, spans: list[tuple[int, int, int]]) -> dict:
    """Candidate tokens of a text: places, features, labels by the base spans, keys, the base span each lies in (-1: none), and edges."""
    places = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in places]
    own = [i for i, t in enumerate(tokens) if _SIGN.search(t)]
    kind, span = np.full(len(own), OTHER, np.int64), np.full(len(own), -1, np.int64)
    keys = [content_key(tokens[i]) for i in own]
    short: set[str] = set()
    whole: set[str] = set()
    if own:
        start, end = (np.array([places[i][k] for i in own]) for k in (0, 1))
        for n, (k, a, b) in reversed(list(enumerate(spans))):
            first, behind = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
            kind[first:behind], span[first:behind] = k, n
            if behind - first > 1:  # a number over several tokens: its last one stands for it
                keys[first:behind] = [""] * (behind - first - 1) + [content_key(text[a:b])]
            if (key := short_key(text[a:b])) and behind > first:
                keys[behind - 1] = key
                short.add(key)
            if len(value := _NOT_DIGIT.sub("", text[a:b])) >= LEAST_DIGITS and k:
                whole.add(value)
    if short:
        keys = [k or (s if (s := short_key(tokens[i])) in short else "") for k, i in zip(keys, own)]
    chain = [(x, x + 1) for x in range(len(own) - 1) if own[x + 1] == own[x] + 1]
    if whole:
        _join_parts(keys, [tokens[i] for i in own], {a for a, _ in chain}, (kind == OTHER).tolist(), whole)
    skip, far = links(keys, (kind != OTHER).tolist())
    return {"at": [places[i] for i in own], "x": [_features(tokens, i) for i in own], "y": kind, "span": span, "chain": chain, "skip": skip, "far": far, "key": keys}


def rewritten(kind: int, value: str, salt: int) -> str:
    """A value with other separators, chosen by salt; of a phone number, salt may drop the country's part."""
    mark = SEPARATORS[salt % len(SEPARATORS)]
    name, at, rest = value.partition("@")
    groups = _NOT_ALNUM.sub(" ", rest if at else value).split()
    if kind == 3 and len(groups) > 2 and salt // len(SEPARATORS) % 2:
        groups = groups[1:]
    return name + at + (mark.strip() or "_").join(groups) if at else mark.join(groups)


def _other_value(value: str) -> str:
    """The value with every digit and letter from a to z moved on, so that it looks alike and says something else."""
    return "".join(chr((ord(c) - 48 + 3) % 10 + 48) if "0" <= c <= "9" else chr((ord(c.lower()) - 97 + 7) % 26 + 97) if c.isascii() and c.isalpha() else c for c in value)


def training_graph(text: str, spans: list[tuple[int, int, int]]) -> tuple[dict, str]:
    """nodes() of the text with a masked copy of each base span and one of another value behind it, and that text; "role" says what a node is."""
    copies, more = [], text
    for k, a, b in spans:
        salt = zlib.crc32(f"{a}:{text[a:b]}".encode("utf-8", "surrogatepass"))
        for way in range(COPIES):
            for label, value in ((k, text[a:b]), (OTHER, _other_value(text[a:b]))):
                copy = rewritten(k, value, salt + 5 * way)
                more += f" | {copy}"
                copies.append((label, len(more) - len(copy), len(more)))
    g = nodes(more, spans)
    sure = {key for key, y in zip(g["key"], g["y"]) if key and y != OTHER}
    role = np.array([EVIDENCE if y != OTHER else UNKNOWN if key in sure else PLAIN for key, y in zip(g["key"], g["y"])], np.int64)
    starts = np.array([a for a, _ in g["at"]], np.int64)
    for k, a, b in copies:
        for x in range(int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b))):
            if k != OTHER:  # a copy without its key is no more like its origin than anything else
                role[x] = MASKED if g["key"][x] in sure else UNKNOWN
                g["y"][x] = k if role[x] == MASKED else OTHER
    return g | {"role": role}, more


def thin(g: dict, text: str, most: int) -> dict:
    """The graph for training, with at most ``most`` nodes from all over the text; equal keys are linked to the next one left."""
    n = len(g["x"])
    keep = range(n)
    if n > most:
        behind = {b for _, b in g["chain"]}
        runs: list[list[int]] = []
        for x in range(n):
            if x in behind and len(runs[-1]) < min(RUN, most):
                runs[-1].append(x)
            else:
                runs.append([x])
        alike = defaultdict(list)
        for run in runs:
            alike[next((g["key"][x] for x in run if g["key"][x]), text[slice(*g["at"][run[0]])])].append(run)
        picked: list[int] = []
        for name in sorted(alike, key=lambda k: (zlib.crc32(k.encode("utf-8", "surrogatepass")), k)):
            part = alike[name]
            longest = max(map(len, part))
            take = min(len(part), max(most // KEY_PART // longest, 1), (most - len(picked)) // longest)
            picked += [x for i in range(take) for x in part[i * (len(part) - 1) // max(take - 1, 1)]]
        keep = sorted(picked)
    to = {x: i for i, x in enumerate(keep)}
    chain = [(to[a], to[b]) for a, b in g["chain"] if a in to and b in to]
    part = {name: g[name][list(keep)] for name in ("y", "span", "role") if name in g}
    skip, far = links([g["key"][x] for x in keep], (part["role"] == EVIDENCE if "role" in part else part["y"] != OTHER).tolist())
    return part | {"x": [g["x"][x] for x in keep], "chain": chain, "skip": skip, "far": far}


def pseudo_likelihood(graphs: list[dict], l2: float = L2) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The objective over (unary, chain, skip) laid out in one row, with its gradient.

    The mean over known nodes of -log P(label | own features, neighbours' labels), plus
    l2 / 2 times the squares. Unknown neighbours say nothing, and neither do tokens of one
    base span to each other: they are one value.
    """
    x = np.array([f for g in graphs for f in g["x"]], np.int64).reshape(-1, N_FEATURES)
    y, role, span = (np.concatenate([g[k] for g in graphs]) for k in ("y", "role", "span"))
    base = np.concatenate([[0], np.cumsum([len(g["x"]) for g in graphs])])
    pairs = {name: np.array([(o + a, o + b) for g, o in zip(graphs, base) for a, b in g[name]], np.int64).reshape(-1, 2) for name in ("chain", "skip", "far")}
    skip = np.concatenate([pairs["skip"], pairs["far"]])
    # (label said, node that hears it) by potential: chain forwards, chain backwards, skip both ways
    heard = []
    for said, hears in (pairs["chain"].T, pairs["chain"].T[::-1], np.concatenate([skip, skip[:, ::-1]]).T):
        fine = (role[said] != UNKNOWN) & (role[hears] != UNKNOWN) & ((span[said] < 0) | (span[said] != span[hears]))
        if len(heard) == 2:  # a copy hears its evidence, as the only repeat in a text does, and no other copy
            fine &= (role[said] != MASKED) | (role[hears] != MASKED)
        heard.append([(label, hears[fine & (y[said] == label)]) for label in range(LABELS)])
    known = np.nonzero(role != UNKNOWN)[0]
    n, cells = len(known), LABELS * LABELS
    order = np.argsort(x[known].ravel(), kind="stable")
    used, first = np.unique(x[known].ravel()[order], return_index=True)
    owner = np.repeat(np.arange(n), N_FEATURES)[order]

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        unary = v[: -2 * cells].reshape(BUCKETS, LABELS)
        chain, skip = v[-2 * cells :].reshape(2, LABELS, LABELS)
        s = unary[x].sum(axis=1)
        for told, table in zip(heard, (chain, chain.T, skip)):
            for label, at in told:
                np.add.at(s, at, table[label])
        s = s[known]
        top = s.max(axis=1, keepdims=True)
        z = np.log(np.exp(s - top).sum(axis=1, keepdims=True)) + top
        value = float((z[:, 0] - s[np.arange(n), y[known]]).sum() / n)
        d = np.exp(s - z) / n
        d[np.arange(n), y[known]] -= 1 / n
        g = l2 * v
        gu = g[: -2 * cells].reshape(BUCKETS, LABELS)
        gu[used] += np.add.reduceat(d[owner], first, axis=0)
        full = np.zeros((len(y), LABELS))
        full[known] = d
        gc, gs = g[-2 * cells :].reshape(2, LABELS, LABELS)
        for told, table in zip(heard, (gc, gc.T, gs)):
            for label, at in told:
                table[label] += full[at].sum(axis=0)
        return value + l2 / 2 * float(v @ v), g

    return loss


class Field:
    """Weights of the skip-chain field: unary by bucket, transition and skip by label pair."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def fit(cls, graphs: list[dict], rounds: int = 100) -> Field:
        cells = LABELS * LABELS
        v = np.zeros(BUCKETS * LABELS + 2 * cells)
        if any((g["role"] != UNKNOWN).any() for g in graphs):
            v = minimize(pseudo_likelihood(graphs), v, rounds)
        chain, skip = v[-2 * cells :].reshape(2, LABELS, LABELS)
        # a skip link says the same in both directions
        return cls(v[: -2 * cells].reshape(BUCKETS, LABELS), chain, (skip + skip.T) / 2)

    def beliefs(self, graphs: list[dict], tol: float = 1e-5) -> list[np.ndarray]:
        """Label beliefs of every node by loopy sum-product over all graphs at once, messages repeated while they or their sources change."""
        sizes = [len(g["x"]) for g in graphs]
        base = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        if not base[-1]:
            return [np.zeros((0, LABELS)) for _ in graphs]
        theta = self.unary[np.array([f for g in graphs for f in g["x"]], np.int64)].sum(axis=1)
        y = np.concatenate([g["y"] for g in graphs])
        sure = np.nonzero(y != OTHER)[0]
        theta[sure] = -30.0
        theta[sure, y[sure]] = 0.0
        edges = [(o + a, o + b, k) for g, o in zip(graphs, base) for k, name in enumerate(("chain", "skip", "far")) for a, b in g[name]]
        if edges:
            e = np.array(edges, np.int64)
            pot = np.stack([self.chain, self.skip, self.skip])[e[:, 2]]
            src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])  # pot[m, label of src, label of dst]
            back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
            msg = np.zeros((len(src), LABELS))
            left = np.repeat(100 + 4 * np.array(sizes), sizes)[src]  # rounds, by the size of the own graph
            total, live, done = theta.copy(), np.arange(len(src)), 0
            while len(live):
                out = (total[src[live]] - msg[back[live]])[:, :, None] + pot[live]
                top = out.max(axis=1, keepdims=True)
                step = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                step -= step.max(axis=1, keepdims=True)
                step -= msg[live]
                moved = np.abs(step).max(axis=1) >= tol
                step[moved] *= 0.5
                msg[live] += step
                np.add.at(total, dst[live], step)
                done += 1
                again, changed = np.zeros(len(src), bool), np.zeros(len(theta), bool)
                again[live[moved]] = changed[dst[live[moved]]] = True
                live = np.nonzero((again | changed[src]) & (left > done))[0]
            np.add.at(theta, dst, msg)
        p = np.exp(theta - theta.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [p[a:b] for a, b in zip(base, base[1:])]


def fit_field(docs: DataFrame, sample: int = SAMPLE, doc_tokens: int = DOC_TOKENS) -> Field | None:
    """Train on the candidates of at most ``sample`` documents; None if no document has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            order, packed = [], []
            for i, t in zip(ids, texts):
                if t and _SIGN.search(t):
                    g = thin(*training_graph(t, base_spans(t)), doc_tokens)
                    order.append(int.from_bytes(hashlib.blake2b(f"{i}:{t}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
                    packed.append(zlib.compress(pickle.dumps(g), 1))
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(packed, pa.binary())], ["at", "graph"])

    own = docs.select("doc_id", "text").where(F.col("text").rlike(_SIGN.pattern))
    n = own.count()
    share = min(1.0, OVERSAMPLE * sample / max(n, 1))
    while True:
        some = own.where(F.xxhash64("doc_id", "text") <= hash_bound(share))
        rows = some.mapInArrow(run, "at long, graph binary").orderBy("at", "graph").limit(sample).collect()
        if share >= 1 or len(rows) >= min(sample, n):
            break
        share = min(1.0, 20 * share)  # repeated rows have one hash
    graphs = [pickle.loads(zlib.decompress(r.graph)) for r in rows]
    return Field.fit(graphs) if graphs else None


def detect(texts: list[str], field: Field | None, belief: float = BELIEF) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, by kind and start."""
    base = [base_spans(t) for t in texts]
    some = [i for i, t in enumerate(texts) if _SIGN.search(t)] if field else []
    graphs = [nodes(texts[i], base[i]) for i in some]
    every = [list(b) for b in base]
    for i, g, p in zip(some, graphs, field.beliefs(graphs) if field else []):
        best, sure = p.argmax(axis=1), p.max(axis=1)
        pick = np.where((g["y"] == OTHER) & (sure >= 0.5), best, OTHER)
        adjacent = {a for a, _ in g["chain"]}
        x = 0
        while x < len(pick):
            first, kind = x, int(pick[x])
            if kind != OTHER:
                while x in adjacent and pick[x + 1] == kind:
                    x += 1
                a, b = g["at"][first][0], g["at"][x][1]
                while b > a and texts[i][b - 1] in ".,;:!?":
                    b -= 1
                if a < b and sure[first : x + 1].max() >= belief and not any(s < b and a < e for _, s, e in base[i]):
                    every[i].append((kind, a, b))
            x += 1
        every[i].sort()
    return list(zip(base, every))


def describe(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch covered by spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, field: Field | None = None, belief: float = BELIEF) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    sent = docs.sparkSession.sparkContext.broadcast(field or fit_field(docs))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            found = detect([t or "" for t in texts], sent.value, belief)
            n = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            sha = [hashlib.sha256(describe(b).encode()).hexdigest() for b, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *n, pa.array(sha, pa.string()), pa.array([describe(e) for _, e in found], pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def mask(docs: DataFrame, field: Field | None = None, belief: float = BELIEF) -> DataFrame:
    """docs with personal data in text replaced by its kind; n_chars, if there, follows the new text."""
    sent = docs.sparkSession.sparkContext.broadcast(field or fit_field(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                found = detect([t or "" for t in texts], sent.value, belief)
                new = [t if t is None or not e else mask_text(t, e) for t, (_, e) in zip(texts, found)]
                for name, values in (("text", new), ("n_chars", [None if x is None else len(x) for x in new])):
                    k = batch.schema.get_field_index(name)
                    if k >= 0:
                        old = batch.column(k).to_pylist()
                        values = [o if a is b else v for o, a, b, v in zip(old, texts, new, values)] if name == "n_chars" else values
                        batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
                yield batch

    return docs.mapInArrow(run, docs.schema)
