import random

import pytest

from tributary.operators import graph
from tributary.operators.components import connected_components


def edges(spark, pairs):
    return spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(pairs)], "pidx long, u long, v long")


def trace(spark, pairs, node):
    """Of both ways, which must agree."""
    target = spark.createDataFrame([(1, node)], "site long, node long")
    few, many = (sorted((r.pidx, r.depth) for r in graph.trace_upstream(edges(spark, pairs), target, n).collect()) for n in (graph.SMALL_EDGES, 0))
    assert few == many
    return few


def test_fork(spark):
    assert trace(spark, [(1, 2), (3, 2), (2, 4)], 4) == [(0, 2), (1, 2), (2, 1)]


def test_headwater(spark):
    assert trace(spark, [(1, 2)], 1) == []


def test_self_loop_once(spark):
    assert trace(spark, [(1, 1), (1, 2)], 2) == [(0, 2), (1, 1)]


def test_two_cycle_once(spark):
    assert [p for p, _ in trace(spark, [(1, 2), (2, 1), (2, 3)], 3)] == [0, 1, 2]


@pytest.mark.parametrize("small", [0, graph.SMALL_EDGES])
def test_random_components_and_scc(spark, small):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    reach = {n: {n} for p in pairs for n in p}
    for _ in range(60):
        for u, v in pairs:
            reach[u] |= reach[v]
    scc = {n: min(m for m in r if n in reach[m]) for n, r in reach.items() if sum(n in reach[m] for m in r) > 1}
    assert {r.node: r.scc for r in graph.strong_components(edges(spark, pairs), small).collect()} == scc
    lab = {n: n for n in reach}
    for _ in range(60):
        for u, v in pairs:
            lab[u] = lab[v] = min(lab[u], lab[v])
    assert {r.node: r.component for r in connected_components(edges(spark, pairs), small_edges=small).collect()} == lab


def plain_scc(pairs):
    """Of two nodes or more, by what reaches what."""
    out = {}
    for u, v in pairs:
        out.setdefault(u, set()).add(v)
        out.setdefault(v, set())
    reach = {}
    for n in out:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    comp = {n: min({n} | {m for m in reach[n] if n in reach[m]}) for n in out}
    return {n: c for n, c in comp.items() if sum(x == c for x in comp.values()) > 1}


@pytest.mark.parametrize("seed", range(3))
def test_trees_chains_rings_and_loops(spark, seed):
    """Long ways with side branches, plain rings, rings that share a node, and a ring on a way."""
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(120)] + [(1000 + i, i) for i in range(0, 120, 2)]
    pairs += [(2000 + i, 2000 + (i + 1) % 17) for i in range(17)]
    pairs += [(3000, 3001), (3001, 3002), (3002, 3000), (3000, 3003), (3003, 3000), (50, 3000), (3000, 3050), (3050, 60)]
    pairs += [(4000, 4001), (4001, 4000), (4001, 4002), (4002, 4002)]
    pairs += [(rng.randrange(5000, 5040), rng.randrange(5000, 5040)) for _ in range(45)]
    rng.shuffle(pairs)
    assert {r.node: r.scc for r in graph.strong_components(edges(spark, pairs), 0).collect()} == plain_scc(pairs)


def test_deep_traces_take_few_rounds(spark, monkeypatch):
    """A way of 300 edges with branches and a second way on: the depth is the fewest steps, in a few rounds."""
    pairs = [(i + 1, i) for i in range(300)] + [(1000 + i, i) for i in range(0, 300, 7)] + [(150, 140)]
    rounds = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda d, tag="": rounds.append(tag) or real(d, tag))
    d = graph.trace_upstream(edges(spark, pairs), spark.createDataFrame([(1, 0), (2, 250), (3, 1000)], "site long, node long"), 0)
    got = {(r.site, r.pidx): r.depth for r in d.collect()}
    assert len(rounds) < 30
    for site, node in ((1, 0), (2, 250), (3, 1000)):
        depth, front, d = {node: 0}, [node], 0
        while front:
            d += 1
            front = list({u for u, v in pairs if v in front and u not in depth})
            depth |= dict.fromkeys(front, d)
        want = {(site, p): depth[v] + 1 for p, (u, v) in enumerate(pairs) if v in depth}
        assert {k: x for k, x in got.items() if k[0] == site} == want


def test_dense_graphs_go_on_by_levels(spark):
    """Many ways on from every node: walks outgrow the edges, and the search goes on by levels."""
    rng = random.Random(8)
    pairs = [(layer * 10 + a, layer * 10 - 10 + rng.randrange(10)) for layer in range(1, 9) for a in range(10) for _ in range(6)]
    trace(spark, pairs, 3)


def test_empty(spark):
    none = spark.createDataFrame([], "pidx long, u long, v long")
    assert connected_components(none).count() == 0
    assert graph.strong_components(none).count() == 0
