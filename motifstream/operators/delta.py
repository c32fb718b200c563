"""Matches of a range of updates only: one join chain for each query edge that an update could be mapped to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifstream.operators.match import _apart, edge_side
from motifstream.plans.planner import graphflow, steps
from motifstream.plans.query import QueryGraph


def _chain(q: QueryGraph, adj: DataFrame, anchor: int, first: DataFrame, ok, homo: bool, order: list[int] | None = None, candidates: dict[int, DataFrame] | None = None) -> DataFrame:
    """Extend anchored edges (u, v, s_anchor, e_anchor) in an order that starts with their ends; ``ok(j)`` is the life test of query edge j."""
    at = {frozenset(e[:2]): i for i, e in enumerate(q.edges)}
    u, v, _ = q.edges[anchor]
    out, done = first, [u, v]
    plan = steps(q, order or graphflow(q, (u, v)))
    if {plan[0].vertex, plan[1].vertex} != {u, v}:
        raise ValueError(f"the order of query edge {u}-{v} has to start with its ends")
    for step in plan[2:]:
        for i, b in enumerate(step.backward):
            e = edge_side(adj, q, b, step.vertex, q.neighbours(b)[step.vertex], "new")
            if candidates and step.vertex in candidates:
                e = e.join(candidates[step.vertex].select(F.col("v").alias(f"u{step.vertex}")), f"u{step.vertex}", "left_semi")
            out = out.join(e, [f"u{b}"] + ([f"u{step.vertex}"] if i else [])).filter(ok(at[frozenset((b, step.vertex))])).drop("s_new", "e_new")
            if not i and not homo and (apart := _apart(q, step.vertex, done)) is not None:
                out = out.filter(apart)
        done.append(step.vertex)
    return out.select(*(f"u{i}" for i in range(q.size)), F.col("seq"))


def _anchors(adj: DataFrame, q: QueryGraph, i: int, after: int, upto: int, sign: int) -> DataFrame:
    """Changes in (after, upto] that query edge i can be mapped to."""
    changed = F.col("start_seq" if sign > 0 else "end_seq")
    return edge_side(adj.filter((changed > after) & (changed <= upto)), q, *q.edges[i], "anchor").withColumn("seq", F.col("s_anchor" if sign > 0 else "e_anchor"))


def _alive_at(i: int, sign: int, ties: bool):
    """The life test of query edge j beside the anchor i: alive at the change; with ``ties`` edges before i must not change with it."""

    def ok(j: int):
        s, e, strict = F.col("s_new"), F.col("e_new"), ties and j < i
        if sign > 0:
            return (s < F.col("seq") if strict else s <= F.col("seq")) & (e > F.col("seq"))
        return (s < F.col("seq")) & (e > F.col("seq") if strict else e >= F.col("seq"))

    return ok


def anchored(q: QueryGraph, adj: DataFrame, after: int, upto: int, *, sign: int = 1, homo: bool = False, homo_multiplicity: bool = False,
             orders: dict[int, list[int]] | None = None, candidates: dict[int, DataFrame] | None = None) -> DataFrame:
    """(u0 .., seq): embeddings that updates in (after, upto] make (sign 1) or end (sign -1).

    The changed edges are the small side of each chain. Ties between edges that change at one update go to the query
    edge with the smallest number; with ``homo_multiplicity`` an embedding counts once for each query edge on it.
    ``orders`` has orders of its own for some query edges (by number), which start with the edge's ends.
    """
    parts, alive = [], adj.filter((F.col("start_seq") <= upto) & (F.col("end_seq") > after))
    for i in range(len(q.edges)):
        parts.append(_chain(q, alive, i, _anchors(alive, q, i, after, upto, sign), _alive_at(i, sign, not homo_multiplicity), homo, (orders or {}).get(i), candidates))
    return reduce(DataFrame.unionByName, parts)


def anchored_deltas(q: QueryGraph, adj: DataFrame, after: int, upto: int, **options) -> DataFrame:
    """(seq, positives, negatives) of the updates in (after, upto]."""
    p = anchored(q, adj, after, upto, sign=1, **options).select("seq", F.lit(1).alias("p"), F.lit(0).alias("n"))
    n = anchored(q, adj, after, upto, sign=-1, **options).select("seq", F.lit(0).alias("p"), F.lit(1).alias("n"))
    return p.unionByName(n).groupBy("seq").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def triples_of(q: QueryGraph, spark) -> DataFrame:
    """The query's label triples (lo, hi, elabel): a few rows."""
    rows = ", ".join(f"({a}, {b}, {c})" for a, b, c in sorted(q.triples()))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(lo, hi, el)")


def update_events(adj: DataFrame) -> DataFrame:
    """(seq, src, dst, elabel, lo, hi, is_add) of every real edge update, with its endpoint labels in order."""
    one = adj.filter("src < dst").select("src", "dst", "elabel", F.least("src_label", "dst_label").alias("lo"), F.greatest("src_label", "dst_label").alias("hi"), "start_seq", "end_seq")
    adds = one.filter("start_seq > 0").select(F.col("start_seq").alias("seq"), "src", "dst", "elabel", "lo", "hi", F.lit(True).alias("is_add"))
    gone = one.filter(F.col("end_seq") < 9223372036854775807).select(F.col("end_seq").alias("seq"), "src", "dst", "elabel", "lo", "hi", F.lit(False).alias("is_add"))
    return adds.unionByName(gone)


def classify(q: QueryGraph, adj: DataFrame, unsafe: bool = True) -> DataFrame:
    """Updates whose label triple the query has (unsafe), or those it has not (safe)."""
    events = update_events(adj)
    t = F.broadcast(triples_of(q, adj.sparkSession))  # as many rows as the query has label triples
    on = (events["lo"] == t["lo"]) & (events["hi"] == t["hi"]) & (events["elabel"] == t["el"])
    return events.join(t, on, "left_semi" if unsafe else "left_anti")
