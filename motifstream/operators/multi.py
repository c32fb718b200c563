"""Many queries over one stream: each update is sent only to the query edges its label triple fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifstream.operators.delta import update_events
from motifstream.operators.match import deltas, extend
from motifstream.operators.storage import cut
from motifstream.plans.planner import graphflow, grow, steps
from motifstream.plans.query import QueryGraph


def dispatch_table(queries: dict[str, QueryGraph], spark) -> DataFrame:
    """(lo, hi, el, qid, qedge): a row for each label triple of each query edge."""
    rows = sorted({(min(a, b), max(a, b), c, qid, i) for qid, q in queries.items() for i, (u, v, c) in enumerate(q.edges) for a in q.label_set(u) for b in q.label_set(v)})
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({a}, {b}, {c}, '{qid}', {i})" for a, b, c, qid, i in rows) + " AS t(lo, hi, el, qid, qedge)")


def dispatch(queries: dict[str, QueryGraph], adj: DataFrame) -> DataFrame:
    """(seq, qid, qedge) of every update and query edge that fit."""
    events, t = update_events(adj), dispatch_table(queries, adj.sparkSession)
    on = (events["lo"] == t["lo"]) & (events["hi"] == t["hi"]) & (events["elabel"] == t["el"])
    return events.join(F.broadcast(t), on).select("seq", "qid", "qedge")  # the table has the queries' size


def relabelled(q: QueryGraph, order: list[int]) -> QueryGraph:
    """``q`` with its vertices numbered by their place in ``order``."""
    at = {u: i for i, u in enumerate(order)}
    return QueryGraph.of([q.labels[u] for u in order], [(*sorted((at[u], at[v])), c) for u, v, c in q.edges])


def _step(q: QueryGraph, order: list[int], u: int) -> tuple:
    """What joining ``u`` after ``order`` means, whatever the numbers of the vertices: its labels and its edges to places."""
    return q.label_set(u), tuple(sorted((order.index(v), c) for v, c in q.neighbours(u).items() if v in order))


def shared_orders(queries: dict[str, QueryGraph]) -> dict[str, list[int]]:
    """An order for each query, chosen so that it begins like that of others: the longest beginning that some query has already."""
    tree: dict = {}
    out = {}

    def longest(q: QueryGraph, order: list[int], node: dict) -> list[int]:
        best = order
        for u in range(q.size):
            if u not in order and (not order or any(v in order for v in q.neighbours(u))) and (key := _step(q, order, u)) in node:
                best = max(best, longest(q, [*order, u], node[key]), key=len)
        return best

    for qid, q in sorted(queries.items(), key=lambda x: (-x[1].size, x[0])):
        start = longest(q, [], tree)
        out[qid] = order = grow(q, start) if len(start) > 1 else graphflow(q)
        node = tree
        for i, u in enumerate(order):
            node = node.setdefault(_step(q, order[:i], u), {})
    return out


def shared_matches(queries: dict[str, QueryGraph], adj: DataFrame, *, homo: bool = False) -> dict[str, DataFrame]:
    """(u0 .., st, en) of each query. Beginnings that several queries share are joined once and written for all of them."""
    orders = shared_orders(queries)
    named = {qid: relabelled(q, orders[qid]) for qid, q in queries.items()}
    path = {qid: [_step(q, list(range(i)), i) for i in range(q.size)] for qid, q in named.items()}
    uses: dict[tuple, set] = {}
    for keys in path.values():
        for n in range(2, len(keys) + 1):
            uses.setdefault(tuple(keys[:n]), set()).add(tuple(keys[: n + 1]))
    made: dict[tuple, DataFrame] = {}
    out = {}
    for qid, q in named.items():
        now = None
        for n, step in enumerate(steps(q, list(range(q.size)))[1:], 2):
            key = tuple(path[qid][:n])
            if key not in made:
                made[key] = extend(q, adj, now, step, list(range(n - 1)), homo=homo)
                if len(uses[key]) > 1:
                    made[key] = cut(made[key], "shared")
            now = made[key]
        at = {u: i for i, u in enumerate(orders[qid])}
        out[qid] = now.select(*(F.col(f"u{at[u]}").alias(f"u{u}") for u in range(q.size)), "st", "en")
    return out


def multi_deltas(queries: dict[str, QueryGraph], adj: DataFrame, **options) -> DataFrame:
    """(qid, seq, positives, negatives) of all queries."""
    return reduce(DataFrame.unionByName, [deltas(found).select(F.lit(qid).alias("qid"), "*") for qid, found in shared_matches(queries, adj, **options).items()])
