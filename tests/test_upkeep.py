"""Upkeep of indexes, counting around updates, limits and strategies against recounts."""

import random
import time
from itertools import permutations

import pytest
from test_matching import EDGE, PATH, SQUARE, TAIL, frames, trial

from motifstream.functions.limits import TimeLimitExceeded, tuned_partitions, within
from motifstream.operators import counting, delta, index, lifetimes, multi, sjtree, stats
from motifstream.operators import match as m
from motifstream.operators.storage import cut
from motifstream.plans import planner
from motifstream.plans.query import QueryGraph
from motifstream.session import CsmSession

STAR = QueryGraph.of((None, 0, 0, 1), [(0, 1, 0), (0, 2, 0), (0, 3, 0)])
KITE = QueryGraph.of((0, 0, 0, None), [(0, 1, 0), (1, 2, 0), (0, 2, 0), (2, 3, 0)])


@pytest.fixture(scope="module")
def graph(spark):
    r, n = random.Random(77), 9
    v = [(i, int(r.random() < 0.3)) for i in range(n)]
    e = [(a, b, int(r.random() < 0.2)) for a in range(n) for b in range(a) if r.random() < 0.5]
    ops = [(s, "e", r.random() < 0.6, *r.sample(range(n), 2), int(r.random() < 0.2)) for s in range(1, 31)]
    vertices, edges, updates = frames(spark, v, e, ops)
    return vertices, cut(lifetimes.build_adjacency(vertices, edges, updates), "adj")


def pairs(frames_of):
    return {(u, r["v"]) for u, df in frames_of.items() for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_candidates_after_changes_are_those_of_a_rebuild(spark, seed):
    r = random.Random(seed)
    labels = [(i, r.randrange(2)) for i in range(14)]
    v = spark.createDataFrame(labels, "id long, label int")
    all_ = [(a, b, r.randrange(2)) for a in range(14) for b in range(a) if r.random() < 0.25]
    some = [x for x in all_ if r.random() < 0.5]
    rest = [x for x in all_ if x not in some]
    make = lambda rows: lifetimes.build_adjacency(v, spark.createDataFrame(rows, "src long, dst long, elabel int"))
    few, many, between = make(some), make(all_), make(rest)
    small, large = index.dcs(TAIL, few, v, 0, store=True), index.dcs(TAIL, many, v, 0, store=True)
    for got, want in ((index.dcs_update(TAIL, many, between, v, 0, *small, insert=True), large), (index.dcs_update(TAIL, few, between, v, 0, *large, insert=False), small)):
        assert [pairs(x) for x in got] == [pairs(x) for x in want]
    lit = [index.lighting(TAIL, x, v) for x in (few, many)]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.turn_on(TAIL, lit[0], many, between, v)) == rows(lit[1])
    assert rows(index.turn_off(TAIL, lit[1], few, between)) == rows(lit[0])


def test_representatives_are_different_neighbours(spark):
    q = QueryGraph.of((None, (0, 1), (0, 1), (1, 2)), [(0, 1, 0), (0, 2, 0), (0, 3, 0)])
    r = random.Random(3)
    for _ in range(2):
        labels = [(i, r.randrange(3)) for i in range(12)]
        edges = [(a, b, 0) for a in range(12) for b in range(a) if r.random() < 0.25]
        v = spark.createDataFrame(labels, "id long, label int")
        adj = cut(lifetimes.build_adjacency(v, spark.createDataFrame(edges, "src long, dst long, elabel int")), "adj")
        lit = {tuple(x) for x in index.lighting(q, adj, v).collect()}
        near = {}
        for a, b, _ in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        served = lambda x: any(all((w, y) in lit for w, y in zip((1, 2, 3), p)) for p in permutations(near.get(x, ()), 3))
        want = {(u, x) for u, x in lit if u or served(x)}
        assert {tuple(x) for x in index.representatives(q, adj, index.lighting(q, adj, v)).collect()} == want
        apart = {tuple(x) for x in index.lighting_apart(q, adj, v).collect()}
        assert apart <= want and (not apart or {u for u, _ in apart} == {0, 1, 2, 3})


def test_chains_that_go_out_one_by_one_are_followed(spark):
    q = QueryGraph.of((0, 0, 1), [(0, 1, 0), (1, 2, 0)])
    n = 70
    v = spark.createDataFrame([(i, 0) for i in range(n)] + [(n, 1)], "id long, label int")
    e = spark.createDataFrame([(i, i + 1, 0) for i in range(n)], "src long, dst long, elabel int")
    assert {tuple(x) for x in index.lighting(q, lifetimes.build_adjacency(v, e), v).collect()} == {(0, n - 2), (1, n - 1), (2, n)}
    with pytest.raises(RuntimeError):
        index.lighting(q, lifetimes.build_adjacency(v, e), v, max_rounds=1)
    with pytest.raises(RuntimeError):
        stats.diameter(e, max_rounds=5)
    with pytest.raises(ValueError):
        stats.diameter(e, max_vertices=10)


@pytest.mark.parametrize("q,shell", [(SQUARE, [1, 3]), (STAR, [1, 2, 3]), (KITE, [3]), (PATH, [0, 2]), (EDGE, [])])
def test_counts_around_updates_without_tuples(graph, q, shell):
    _, adj = graph
    want = sorted(map(tuple, m.deltas(m.matches(q, adj)).collect()))
    assert sorted(map(tuple, counting.shell_deltas(q, adj, shell, 0, 1000).collect())) == want
    assert want


def test_strategies_count_and_new_ones_can_be_added(graph, spark):
    vertices, adj = graph
    session = CsmSession(spark)
    want = sorted(map(tuple, m.deltas(m.matches(SQUARE, adj)).collect()))
    for strategy in ("calig", "newsp", "graphflow"):
        assert sorted(map(tuple, session.count_deltas(SQUARE, adj, strategy=strategy).collect())) == want
    assert planner.isolated(SQUARE, planner.newsp(SQUARE)) and planner.newsp(SQUARE, 1)[:2] == [1, 2]

    class Backwards:
        def plan(self, query, adj, vertices, *, homo, order):
            return m.matches(query, adj, order=[3, 2, 1, 0], homo=homo)

        def shell(self, query):
            return []

    with pytest.raises(ValueError):
        session.plan(SQUARE, adj, vertices, strategy="backwards")
    session.register("backwards", Backwards())
    assert session.plan(SQUARE, adj, vertices, strategy="backwards").count() == m.matches(SQUARE, adj).count()
    orders = {0: [1, 0, 3, 2], 3: [3, 0, 1, 2]}
    assert sorted(map(tuple, session.count_deltas(SQUARE, adj, orders=orders).collect())) == want
    with pytest.raises(ValueError):
        delta.anchored(SQUARE, adj, 0, 10, orders={0: [2, 3, 0, 1]})


def test_shared_beginnings(graph):
    _, adj = graph
    many = {"square": SQUARE, "path": QueryGraph.of((0, 0, 0), [(0, 1, 0), (1, 2, 0)]), "edge": QueryGraph.of((0, 0), [(0, 1, 0)]), "tail": TAIL}
    orders = multi.shared_orders(many)
    keys = {k: [multi._step(many[k], o[:i], u) for i, u in enumerate(o)] for k, o in orders.items()}
    assert keys["square"][:3] == keys["path"] and keys["path"][:2] == keys["edge"]
    for k, found in multi.shared_matches(many, adj).items():
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, m.matches(many[k], adj).select(found.columns).collect())), k


def test_appended_partial_matches(graph):
    _, adj = graph
    order = list(TAIL.edges)
    old, new = adj.filter("start_seq <= 10"), adj.filter("start_seq > 10")
    nodes = sjtree.partial_matches(TAIL, old, order)
    rows = lambda df: sorted(map(tuple, df.select("u0", "u1", "u2", "u3", "st", "en").collect()))
    assert rows(nodes[-1].unionByName(sjtree.append(TAIL, nodes, adj, new, order)[-1])) == rows(sjtree.partial_matches(TAIL, adj, order)[-1])


def test_limits(spark, graph):
    vertices, adj = graph
    assert within(spark, 60, lambda: adj.count()) == adj.count() and within(spark, None, lambda: 3) == 3
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 // 0)
    began = time.monotonic()
    with pytest.raises(TimeLimitExceeded):
        within(spark, 1.0, lambda: spark.range(1 << 45).selectExpr("sum(hash(id))").collect())
    assert time.monotonic() - began < 30 and adj.count() > 0
    v, e, ops = trial(11)
    found = CsmSession(spark, auto_tuning=True).match(TAIL, *frames(spark, v, e, ops), initial_time_limit=100, time_limit=100)
    assert found.run() == found.summary.first().asDict()
    assert tuned_partitions(spark, 1 << 40) == 1 << 13


def test_cascades_take_a_row_an_add(spark):
    edges = spark.createDataFrame([(0, i, 0) for i in range(1, 21)], "src long, dst long, elabel int")
    updates = spark.createDataFrame([(s, "v", s % 2 == 0, 0, None, 0) for s in range(1, 100)], "seq long, kind string, is_add boolean, id1 long, id2 long, label int")
    assert lifetimes.edge_ops(edges, updates).count() == 40
    assert {(r["start_seq"], r["end_seq"]) for r in lifetimes.edge_lifetimes(edges, updates).collect()} == {(0, 1)}
