import pytest

from motifstream.plans import planner
from motifstream.plans.query import InducedGraph, QueryGraph

SIX = QueryGraph.of((4, 5, 1, 3, 2, 2), [(0, 2), (0, 4), (2, 4), (2, 3), (0, 1), (3, 5)])


def shown(q, order):
    first, *rest = planner.steps(q, order)
    return "-".join([str(first.vertex), *(f"{s.vertex}({','.join(map(str, sorted(s.backward)))})" for s in rest)])


def test_anchor_orders_of_six_vertices():
    """Orders known for this query."""
    assert [shown(SIX, o) for o in planner.anchor_orders(SIX)] == [
        "0-2(0)-4(0,2)-3(2)-1(0)-5(3)", "4-0(4)-2(0,4)-3(2)-1(0)-5(3)", "4-2(4)-0(2,4)-3(2)-1(0)-5(3)",
        "3-2(3)-0(2)-4(0,2)-1(0)-5(3)", "1-0(1)-2(0)-4(0,2)-3(2)-5(3)", "5-3(5)-2(3)-0(2)-4(0,2)-1(0)"]


@pytest.mark.parametrize("strategy", [s for s in planner.STRATEGIES if s != "iedyn"])
def test_orders_are_connected(strategy):
    planner.steps(SIX, planner.plan_order(SIX, strategy))


def test_spanning_tree_and_dag():
    freq = {e[:2]: 10 - i for i, e in enumerate(SIX.edges)}
    assert len(planner.spanning_tree(SIX, 1, freq)) == 5
    order, dag = planner.bfs_dag(SIX, 1)
    assert order[0] == 1 and len(dag) == 6 and all(order.index(a) < order.index(b) for a, b, _ in dag)
    core, shell = planner.kernel_shell(SIX, 0, 2)
    assert sorted(core + shell) == list(range(6)) and not any(a in shell and b in shell for a, b, _ in SIX.edges)


def test_query_graphs():
    q = QueryGraph.parse("t # 1\nv 0 4\nv 1 5 -1\nv 2 1\ne 0 1 7\ne 1 2\n")
    assert q.labels == (4, 5, 1) and q.edges == ((0, 1, 7), (1, 2, 0)) and q.is_tree() and q.kind() == "tree" and q.diameter() == 2
    assert QueryGraph.parse(q.to_text()) == q
    for bad in ([(0, 0)], [(0, 1), (1, 0)], [(0, 1)]):
        with pytest.raises(ValueError):
            QueryGraph.of((0, 0, 0), bad)
    a, b = InducedGraph.of_edge(0, 1), InducedGraph.of_edge(1, 2)
    assert a.union(b).degree(1) == 2 and a.intersection(b).vertices == {1}
