"""Joins through a vertex that everything touches: right results, and never the product of its neighbours as rows."""

import random

import pytest
from brute import embeddings, Graph

from motifstream.operators import lifetimes, stats
from motifstream.operators import match as m
from motifstream.operators.storage import cut
from motifstream.plans import planner
from motifstream.plans.query import QueryGraph
from motifstream.session import CsmSession

TRADE = QueryGraph.of((0, 1, 2, 3), [(0, 1, 0), (1, 2, 1), (0, 3, 2), (2, 3, 3)])
N = 300  # buyers, goods and sellers each; one place that all buyers and sellers touch


def hub(n):
    vertices = [(i + 1000 * x, x) for x in range(3) for i in range(n)] + [(3000, 3)]
    edges = [(i, 1000 + (i + d) % n, 0) for i in range(n) for d in (0, 1)] + [(1000 + i, 2000 + (i * 7 + d) % n, 1) for i in range(n) for d in (0, 2, 5)]
    return vertices, edges + [(i, 3000, 2) for i in range(n)] + [(2000 + i, 3000, 3) for i in range(n)]


@pytest.fixture(scope="module")
def trade(spark):
    v, e = hub(N)
    vertices, edges = spark.createDataFrame(v, "id long, label int"), spark.createDataFrame(e, "src long, dst long, elabel int")
    return vertices, cut(lifetimes.build_adjacency(vertices, edges), "hub")


def most_joined(df):
    """The rows of ``df``, and the most rows that a join of its plan made."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name or "CartesianProduct" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name != "ReusedExchange":
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def of_strategy(spark, trade, strategy, order=None):
    vertices, adj = trade
    return most_joined(CsmSession(spark).plan(TRADE, adj, vertices, strategy=strategy, order=order))


def test_choice_of_joins_is_by_counted_stars(spark, trade):
    sizes = stats.star_sizes(TRADE, trade[1])
    assert sizes[3, frozenset((0, 2))] == N * N and sizes[1, frozenset((0, 2))] == 6 * N and sizes[0, frozenset((1, 3))] == 2 * N and sizes[2, frozenset((1,))] == 3 * N
    last = planner.costed(TRADE, [3, 2, 1, 0], sizes)[-1]
    assert last.backward == (1, 3) and last.together
    assert planner.costed(TRADE, [3, 0, 1, 2], sizes)[-1].backward == (1, 3)
    assert not planner.costed(TRADE, [0, 1, 2, 3], sizes)[-1].together
    small, edges = hub(6)
    g = Graph()
    g.labels.update(small)
    g.edges.update({frozenset((a, b)): c for a, b, c in edges})
    adj = lifetimes.build_adjacency(spark.createDataFrame(small, "id long, label int"), spark.createDataFrame(edges, "src long, dst long, elabel int"))
    for order in ([3, 2, 1, 0], [3, 0, 1, 2], [3, 2, 0, 1], [0, 3, 2, 1], [1, 0, 2, 3]):
        assert {tuple(r)[:4] for r in m.matches(TRADE, adj, order=order).collect()} == embeddings(TRADE, g)


def test_turboflux_keeps_away_from_the_hub(spark, trade):
    rows, most = of_strategy(spark, trade, "turboflux")
    assert len(rows) == 6 * N and most <= 6 * N


def test_pruning_counters_count_extensions_without_making_them(trade):
    rows, most = most_joined(m.pruning_counters(TRADE, trade[1], order=[3, 2, 1, 0]))
    assert sorted(map(tuple, rows)) == [(1, 2, 1, N, N, N, N, 0), (2, 1, N, 3 * N, 3 * N, 3 * N, 3 * N, 0), (3, 0, 3 * N, 3 * N * N, 3 * N * N, 6 * N, 6 * N, 0)]
    assert most <= 6 * N


def test_sj_tree_deltas_keep_away_from_the_hub(spark):
    v, e = hub(N)
    late = [x for x in e if x[2] == 0 and x[0] % 10 == 0]
    ops = [(i + 1, "e", True, *x) for i, x in enumerate(late)] + [(len(late) + i + 1, "e", False, *x[:2], 0) for i, x in enumerate(late) if i % 2]
    vertices, updates = spark.createDataFrame(v, "id long, label int"), spark.createDataFrame(ops, "seq long, kind string, is_add boolean, id1 long, id2 long, label int")
    adj = cut(lifetimes.build_adjacency(vertices, spark.createDataFrame([x for x in e if x not in late], "src long, dst long, elabel int"), updates), "late")
    rows, most = most_joined(m.deltas(CsmSession(spark).plan(TRADE, adj, vertices, strategy="sj-tree")))
    assert {tuple(r) for r in rows} == {(o[0], 3 if o[2] else 0, 0 if o[2] else 3) for o in ops} and most <= 6 * N


def test_sj_tree_keeps_away_from_the_hub(spark, trade):
    rows, most = of_strategy(spark, trade, "sj-tree")
    assert len(rows) == 6 * N and most <= 6 * N
    sizes = stats.star_sizes(TRADE, trade[1])
    assert planner.sj_leaves(TRADE, {e[:2]: sizes[e[0], frozenset((e[1],))] for e in TRADE.edges}, sizes) == [[(0, 3, 2)], [(0, 1, 0)], [(1, 2, 1)], [(2, 3, 3)]]


@pytest.mark.parametrize("order", [[3, 2, 1, 0], [3, 0, 1, 2], [1, 0, 3, 2], [2, 3, 1, 0]])
def test_given_orders_close_at_the_hub_last(spark, trade, order):
    rows, most = of_strategy(spark, trade, "graphflow", order)
    assert len(rows) == 6 * N and most <= 6 * N


def test_symbi_takes_the_vertex_with_fewest_candidates_of_a_match(spark):
    v, e = hub(N)
    goods = [(1000 + i, 1) for i in range(2 * N)]
    v, e = [x for x in v if x[1] != 1] + goods, [x for x in e if x[2] > 1] + [(i, 1000 + 2 * i + d, 0) for i in range(N) for d in (0, 1)] + [(1000 + i, 2000 + (i * 7 + d) % N, 1) for i in range(2 * N) for d in (0, 2, 5)]
    vertices = spark.createDataFrame(v, "id long, label int")
    adj = cut(lifetimes.build_adjacency(vertices, spark.createDataFrame(e, "src long, dst long, elabel int")), "hub")
    counts = {0: N, 1: 2 * N, 2: N, 3: 1}
    assert planner.by_candidates(TRADE, 3, counts) == [3, 0, 2, 1] and planner.by_candidates(TRADE, 3, counts, stats.star_sizes(TRADE, adj)) == [3, 0, 1, 2]
    rows, most = of_strategy(spark, (vertices, adj), "symbi")
    assert len(rows) == 6 * N and most <= 6 * N


def test_time_constraints_hold_while_joining(spark):
    q = QueryGraph.of((0, 1, 0, 3), [(0, 1, 0), (2, 1, 0), (0, 3, 2), (2, 3, 2)])
    vertices = spark.createDataFrame([(i, 0) for i in range(N)] + [(1000, 1), (3000, 3)], "id long, label int")
    edges = spark.createDataFrame([(i, 3000, 2) for i in range(N)] + [(i, 1000, 0) for i in range(5, N)], "src long, dst long, elabel int")
    updates = spark.createDataFrame([(i + 1, "e", True, i, 1000, 0) for i in range(5)], "seq long, kind string, is_add boolean, id1 long, id2 long, label int")
    adj = cut(lifetimes.build_adjacency(vertices, edges, updates), "late")
    rows, most = most_joined(m.precedes(q, adj, [(0, 1)]))
    assert {tuple(x)[:5] for x in rows} == {(a, 1000, b, 3000, b + 1) for b in range(5) for a in range(N) if a > 4 or a < b}
    assert most <= 5 * N
    other, _ = most_joined(m.precedes(q, adj, [(1, 0)]))
    assert {tuple(x)[:5] for x in other} == {(b, 1000, a, 3000, s) for a, _, b, _, s in (tuple(x)[:5] for x in rows)}


def far_apart(edges):
    near, far = {}, 0
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in near:
        at, todo = {start: 0}, [start]
        for x in todo:
            for y in near[x] - at.keys():
                at[y] = at[x] + 1
                todo.append(y)
        far = max(far, *at.values())
    return far


def test_diameter_of_graphs_of_any_size(spark):
    frame = lambda edges: spark.createDataFrame(edges, "src long, dst long")
    many = spark.range(20_100).selectExpr("id + 10 AS src", "id % 3 AS dst")
    assert stats.diameter(many.unionByName(frame([(0, 1), (1, 2)]))) == 4
    r = random.Random(3)
    for edges in ([(i, (i + 1) % 18) for i in range(18)], [(a, b) for a in range(50) for b in range(a) if a % 2 == b % 2 and r.random() < 0.1] + [(200, 201)], []):
        assert stats.diameter(frame(edges)) == (far_apart(edges) if edges else 0)
