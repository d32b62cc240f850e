import numpy as np
import xxhash

from tributary.llm import simhash


def slow(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, radius=4):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    lab = np.array(ids)
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(lab))])
        if (new == lab).all():
            return lab
        lab = new


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
    for block, agree in ((simhash.BLOCK, None), (7, 1), (7, 2), (50, 3)):  # 7: every key of some size is split over tasks
        got = simhash.near_duplicates(docs, block=block, agree=agree).toPandas().sort_values("doc_id")
        fps = [int(x, 16) for x in got.fingerprint]
        if agree is None:
            assert fps == [slow(text[i]) for i in got.doc_id]
        assert (brute(fps, got.doc_id.values) == got.component_id.values).all()


def test_tile_forest_finds_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    fps = np.concatenate([base ^ np.uint64(1 << int(s)) for s in rng.integers(0, 60, 20)])
    for left in (None, 300):
        root = simhash.tile_forest(fps, tile=16, left=left)
        for i in range(0, len(fps), 7):
            for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= 4)[0]:
                if left is None or (i < left) != (j < left):
                    assert root[i] == root[j]


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == 9
    by = {g[0]: g for g in got}
    assert by[1][1] == by[2][1] == by[3][1] == "0" * 16 and {by[i][2] for i in (1, 2, 3)} == {1}
    assert by[5][2] == 4
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 7]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_any_link_agrees_on_a_key():
    rng = np.random.default_rng(3)
    for agree in (1, 2, 3, 4):
        masks = simhash.masks(4, agree)
        for _ in range(300):
            bits = rng.choice(64, 4, replace=False).tolist()
            assert any(all(not m >> b & 1 for b in bits) for m in masks)
    assert [simhash.deal(n) for n in (10, 10**5, 10**8, 10**10)] == sorted(simhash.deal(n) for n in (10, 10**5, 10**8, 10**10))
    assert simhash.deal(10**5) == 1 < simhash.deal(10**8)


def test_one_id_with_several_texts(spark):
    """A group is a group of texts: the copy of 1 under id 5 goes, the other text of 5 stays."""
    t1, t2 = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, t1, "x"), (5, t1, "y"), (5, t2, "z"), (5, t2, "z"), (6, t2, "w"), (None, t2, "n"), (None, t2, "n"), (7, None, "e"), (7, "", "e"), (8, " ", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert simhash.keep_one(docs).columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "", r.source) for r in simhash.keep_one(docs).collect())
    assert got == [(0, t2, "n"), (0, t2, "n"), (1, t1, "x"), (5, t2, "z"), (7, "", "e")]
    comp = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted((d or 0, c) for (d, _), c in comp.items()) == [(0, 5), (1, 1), (5, 1), (5, 5), (6, 5), (7, 7), (8, 7)]
    lone = spark.createDataFrame([(None, t1), (None, t1)], "doc_id long, text string")
    assert simhash.keep_one(lone).count() == 2 and {r.component_id for r in simhash.near_duplicates(lone).collect()} == {None}
    saved, simhash.BROADCAST_ROWS = simhash.BROADCAST_ROWS, 0
    try:
        assert sorted((r.doc_id or 0, r.text or "", r.source) for r in simhash.keep_one(docs).collect()) == got
    finally:
        simhash.BROADCAST_ROWS = saved
