import zlib

import numpy as np
import pytest

from tributary.llm import packing, records, tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.default_tokenizer())


def direct(enc, text):
    return np.array([*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_encoder_equals_library(enc, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["don't STOP it's", "İstanbul ΑΣ ΟΔΟΣ. ΣΑΣ", "áb é ́x ß STRASSE", "<|startoftext|> hi<|endoftext|>there", "x y　z", "🙂🙂 ok", "ﬁ Å", "\x1c\x1f a\x85b", "  ", "", None, "a1b22 c'd", "µ ª × ÷"]
    assert enc.encode(texts) == [direct(enc, t) for t in texts]


def test_parts_are_cut_by_proof_only(enc):
    """The tokenizer's own description decides; random plain texts then give the library's ids."""
    import json
    import random

    d = json.loads(enc.tokenizer.to_str())
    assert enc.by_parts
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", None), ("added_tokens", [{"content": "ab"}])):
        assert not tokens.cuts_parts(json.dumps(d | {key: value}))
    assert not tokens.cuts_parts(json.dumps(d | {"model": d["model"] | {"dropout": 0.1}}))
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdeABÀßéÿ ÷×0129.,!<|>-_ \t\n\x0b\x1c", k=rng.randint(0, 60))) for _ in range(4000)]
    assert enc.encode(texts) == [direct(enc, t) for t in texts]


def check_pieces(rows, want):
    """Each id in one piece, sequences gapless, and no padding but to 4096 or a power of two."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for (doc, n), own in docs.items():
        copies = len([k for k in own if k.start == 0])
        assert sum(r.length for r in own) == n * copies
        raw = want[doc]
        for r in own:
            assert zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_tokens and (at == 4096 or at & (at - 1) == 0 and at < 4096)


def test_packing(enc, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: direct(enc, r.text) for r in docs.select("doc_id", "text").collect()}
    for pool in (packing.POOL_TOKENS, 20_000):
        rows = packing.pack(docs.repartition(3), pool_tokens=pool).collect()
        assert {r.doc_id for r in rows} == set(want)
        check_pieces(rows, want)
    one = packing.pack(docs.limit(5), with_ids=True).first()
    assert len(one.ids) == 4 * one.length


def test_packing_odd_rows(enc, odd, none):
    rows = packing.pack(odd).collect()
    check_pieces(rows, {r.doc_id: direct(enc, r.text) for r in odd.collect()})
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7}
    assert packing.pack(none).count() == 0


def test_nnls_and_plan():
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 8)), np.array([0, 1.5, 0, 2, 0, 0, 3, 0])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    h = np.zeros(65, np.int64)
    h[[64, 32, 10, 54]] = [3, 8, 5, 5]
    assert dict(packing.plan_counts(h)) == {(64,): 3, (32, 32): 4, (54, 10): 5}


def test_records_round_trip(enc, odd, none, tmp_path):
    manifest = records.write_shards(odd, str(tmp_path / "r"))
    got = {}
    for m in manifest:
        shard = records.Shard(m["path"])
        rows = list(shard)
        assert sorted(map(str, rows)) == sorted(map(str, shard.shuffled(3)))
        for doc, ids in rows:
            got.setdefault(doc, []).append(ids.tobytes())
    assert got == {d: [direct(enc, r.text) for r in odd.collect() if r.doc_id == d] for d in got} and len(got) == 8
    assert records.write_and_read(none).count() == 0
    rows = records.read_shards(odd.sparkSession, manifest).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_damage_is_seen(enc, spark, tmp_path):
    (m,) = records.write_shards(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), str(tmp_path / "d"))
    path = m["path"].removeprefix("file:").replace("//", "/")
    raw = bytearray(open(path, "rb").read())
    raw[-6] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(records.Shard(path))


def test_query_of_binary_records(enc, spark, sf):
    """Whole output against ids, starts and checksums taken text by text in order of doc_id."""
    from tributary.llm import queries

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, at = {}, 0
    for i in sorted(text):
        raw = direct(enc, text[i])
        want[i] = (i, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert {r.doc_id: tuple(r)[:4] for r in queries.op6_binary_records(spark, sf).collect()} == want


def test_folders_are_qualified_as_the_session_does(spark, tmp_path):
    assert records.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert records.qualified(spark, f"file://{tmp_path}").startswith("file:/")
    for uri in (f"file:{tmp_path}", f"file://{tmp_path}"):
        assert records._open(uri)[1] == str(tmp_path)
    conf = spark._jsc.hadoopConfiguration()
    saved = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://cluster/")
        conf.set("fs.viewfs.mounttable.cluster.link./data", f"file://{tmp_path}")
        assert records.qualified(spark, "/data/x") == "viewfs://cluster/data/x"
    finally:
        conf.set("fs.defaultFS", saved)


def test_one_doc_id_in_many_rows(enc, spark, tmp_path):
    """Rows of one id and of none are spread over shards by the hash of their text."""
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE 7L END AS doc_id", "concat('word ', id) AS text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # small shards would be joined
    try:
        manifest = records.write_shards(docs, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) == int(spark.conf.get("spark.sql.shuffle.partitions")) and all(m["n_docs"] < 1500 for m in manifest)
    assert sum(m["n_docs"] for m in manifest) == records.read_shards(spark, manifest).count() == 3000
