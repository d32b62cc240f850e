import hashlib
import re
from fractions import Fraction
from math import comb

import corpus_pipeline
import numpy as np
from tests.llm.test_learned import plain_counts
from tests.llm.test_simhash import brute, slow
from tests.llm.test_tokens import check_pieces, direct
from tributary.llm import decontaminate, pii, quality_rules, tokens
from tributary.session import materialize


def metrics(text):
    """Base verdict and the four metrics, from the contract's counts."""
    n_words, chars, symbols, dup, repeated = plain_counts(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    caps = len(re.findall("[A-Z]", text or ""))
    share = lambda a, b: a / b if b else 0.0
    return n_words < 10 or 100 * repeated > 20 * n_words, {"symbol_ratio": share(symbols, chars), "dup_line_ratio": share(dup, lines), "repeat_ratio": share(repeated, n_words), "caps_ratio": share(caps, chars)}


def certified(k, n, share, level):
    """Exact binomial test in whole fractions: at most k of n with chance ``share`` is as unlikely as ``level``."""
    p = Fraction(share)
    return k < n * p and sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) <= Fraction(level)


def kept_by_rules(docs, labels):
    """Ids that the rules keep: cutoffs certified per language, each value of each grid tried."""
    seen = {r.doc_id: (r.lang or "", *metrics(r.text)) for r in docs}
    marks = {}
    for r in labels:
        marks.setdefault(r.doc_id, []).append(r.quality)
    good = {i for i, q in marks.items() if None not in q and min(q) == 1}
    strata = {lang for i, (lang, failed, _) in seen.items() if i in good and not failed}
    grids = quality_rules.METRICS
    level = 0.05 / sum(map(len, grids.values())) / max(len(strata), 1)
    cut = {}
    for lang in strata:
        held = [m for i, (own, failed, m) in seen.items() if own == lang and i in good and not failed]
        for name, grid in grids.items():
            fine = [c for c in grid if certified(sum(m[name] >= c for m in held), len(held), 0.05 / len(grids), level)]
            cut[lang, name] = min(fine, default=float("inf"))
    return {i for i, (lang, failed, m) in seen.items() if not failed and all(m[x] < cut.get((lang, x), float("inf")) for x in grids)}, cut


def plain_mask(text):
    """The text with its base spans and the re-writings of their digits masked, by search for each value."""
    spans = pii.base_spans(text)
    out = {(a, b): k for k, a, b in spans}
    for m in re.finditer(r"\S*[0-9@]\S*", text):
        a, b = m.start(), m.end() - len(m[0]) + len(m[0].rstrip(".,;:!?"))
        alnum = lambda x: re.sub(r"[\W_]", "", x).lower()
        for k, s, e in spans:
            if alnum(m[0])[-9:] == alnum(text[s:e])[-9:] and not any(x < b and a < y for _, x, y in spans):
                out[a, b] = k
    return out


def test_run_against_brute_force(spark):
    """Every stage's decisions on sf0.001, taken again without seeds, bands, fields or batches; alignment and base patterns are the operators' own, which have tests of their own."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    kept, cut = kept_by_rules(rows, spark.read.parquet(f"{sf}/labels.parquet").collect())
    left = {r.doc_id: r.text for r in rows if r.doc_id in kept}
    assert 0 < len(left) < len(rows)
    ids = sorted(left)
    lab = brute([slow(left[i]) for i in ids], ids)
    left = {i: left[i] for i, c in zip(ids, lab) if i == c}
    items = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    memo = items.memo()
    for i in list(left):
        words = np.array([x for x in map(memo.__getitem__, left[i].split()) if x >= 0], np.int64)[None, :]
        for _, w in items.items:
            n = len(w)
            if words.size and decontaminate.align(w, words)[0][0] >= max(n, min(2 * n - 3 * (n >= 6), 16)):
                left.pop(i)
                break
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(left)
    enc = tokens.Encoder(tokens.default_tokenizer())
    check_pieces(got, {i: direct(enc, pii.mask_text(t, [(k, a, b) for (a, b), k in plain_mask(t).items()])) for i, t in left.items()})


def test_rules_with_cutoffs_by_hand(spark):
    """Enough labelled documents for cutoffs, in two languages, and a third without."""
    rows = []
    for i in range(3000):
        h = hashlib.sha256(b"%d" % i).digest()
        words = [f"w{x}" for x in h[:20]]
        if h[20] < 3:
            words = [f"#{w}$" for w in words]
        if h[21] < 20:
            words = [w.upper() + "ABC" for w in words]
        text = " ".join(words) + ("\nsame line here\nsame line here\nsame line here" if h[22] < 2 else "")
        rows.append((i, text, ("en", "de", None)[i % 10 // 5 + (i % 50 == 0)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 2900)], "doc_id long, quality int, toxic int")
    want, cut = kept_by_rules(docs.collect(), labels.collect())
    assert any(c < 1 for c in cut.values()) and len(want) < len(rows)
    assert {r.doc_id for r in quality_rules.filter_documents(docs, labels).collect()} == want
    assert {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()} == want


def test_stages_on_odd_rows(spark, odd, none, sf):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf))
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
