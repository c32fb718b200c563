"""Counting without enumeration: core matches by joins, shell vertices by the sizes of their candidate sets."""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifstream.operators.delta import _alive_at, _anchors
from motifstream.operators.match import _apart, edge_side
from motifstream.operators.storage import cut
from motifstream.plans.query import QueryGraph


def _partitions(items: list):
    """All ways to split a list into groups."""
    if not items:
        yield []
        return
    head, *rest = items
    for p in _partitions(rest):
        yield [[head], *p]
        for i in range(len(p)):
            yield [*p[:i], [head, *p[i]], *p[i + 1 :]]


def count_with_shell(q: QueryGraph, adj: DataFrame, shell: list[int], homo: bool = False) -> DataFrame:
    """One row (n): embeddings of ``q`` in the graph of ``adj`` (lives are ignored).

    ``shell`` vertices have all their neighbours outside of it. For each core match, the ways to give them different
    vertices are a sum over partitions of the shell: a group counts the vertices that fit all its members, with sign.
    Those counts are grouped by the core vertices they depend on, so no tuple of shell vertices is ever built.
    """
    core = [u for u in range(q.size) if u not in shell]
    if any(v in shell for s in shell for v in q.neighbours(s)):
        raise ValueError("shell vertices may not touch")
    edges = adj.withColumn("start_seq", F.lit(0).cast("long"))
    out, done = None, [core[0]]
    rest = core[1:]
    if not rest:
        pick = adj if q.label_set(core[0]) is None else adj.filter(F.col("src_label").isin(sorted(q.label_set(core[0]))))
        out = pick.select(F.col("src").alias(f"u{core[0]}")).distinct()
    while rest:
        w = next((x for x in rest if any(y in done for y in q.neighbours(x))), None)
        if w is None:
            raise ValueError("the vertices outside the shell must be connected")
        rest.remove(w)
        for i, b in enumerate(x for x in q.neighbours(w) if x in done):
            e = edge_side(edges, q, b, w, q.neighbours(w)[b], "new").drop("s_new", "e_new")
            out = e if out is None else out.join(e, [f"u{b}"] + ([f"u{w}"] if i else []))
            if not i and not homo and (apart := _apart(q, w, done)) is not None:
                out = out.filter(apart)
        done.append(w)
    counted: dict[tuple, str] = {}
    terms = []
    splits = [[[s] for s in shell]] if homo else list(_partitions(shell))
    for p in splits:
        if any(not _one_label(q, g) for g in p):
            continue
        factors, sign = [], 1
        for g in p:
            g = tuple(sorted(g))
            if g not in counted:
                counted[g] = f"n{len(counted)}"
                out = _with_count(q, edges, out, core, g, counted[g], homo)
            factors.append(F.col(counted[g]))
            sign *= (-1) ** (len(g) - 1) * factorial(len(g) - 1)
        terms.append(reduce(lambda a, b: a * b, factors) * sign)
    total = reduce(lambda a, b: a + b, terms) if terms else F.lit(1)
    return out.agg(F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("n"))


def _one_label(q: QueryGraph, group: list[int]) -> bool:
    sets = [q.label_set(s) for s in group if q.label_set(s) is not None]
    return not sets or bool(frozenset.intersection(*sets))


def _with_count(q: QueryGraph, edges: DataFrame, core_rows: DataFrame, core: list[int], group: tuple[int, ...], name: str, homo: bool) -> DataFrame:
    """Add how many data vertices fit all of ``group`` at once, less the core's own vertices among them."""
    need = sorted({(b, q.neighbours(s)[b]) for s in group for b in q.neighbours(s)})
    sets = [q.label_set(s) for s in group if q.label_set(s) is not None]
    labels = frozenset.intersection(*sets) if sets else None
    fit, keys = None, []
    for i, (b, c) in enumerate(need):
        e = edges.filter(F.col("elabel") == c)
        for col, allowed in (("src_label", q.label_set(b)), ("dst_label", labels)):
            if allowed is not None:
                e = e.filter(F.col(col).isin(sorted(allowed)))
        key = f"u{b}" if f"u{b}" not in keys else None
        e = e.select(F.col("src").alias(key or f"u{b}"), F.col("dst").alias("x")).distinct()
        fit = e if fit is None else fit.join(e, ["x"] + ([] if key else [f"u{b}"]))
        if key:
            keys.append(key)
    taken = [] if homo else [f"u{b}" for b in core if labels is None or q.label_set(b) is None or labels & q.label_set(b)]
    counts = fit.groupBy(*keys).agg(F.count("*").alias(name))
    out = core_rows.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    for t in taken:
        if t in keys:
            continue  # no self loops
        hit = fit.select(*keys, F.col("x").alias(t), F.lit(1).alias("_hit"))
        out = out.join(hit, [*keys, t], "left").withColumn(name, F.col(name) - F.coalesce("_hit", F.lit(0))).drop("_hit")
    return out


def shell_deltas(q: QueryGraph, adj: DataFrame, shell: list[int], after: int, upto: int) -> DataFrame:
    """(seq, positives, negatives) of the updates in (after, upto], without tuples of ``shell`` vertices.

    For each query edge that an update can be mapped to, core matches are joined as in the anchored plans; shell
    vertices away from that edge are counted by the vertices alive at the update that fit them.
    """
    if any(v in shell for s in shell for v in q.neighbours(s)):
        raise ValueError("shell vertices may not touch")
    alive, parts = adj.filter((F.col("start_seq") <= upto) & (F.col("end_seq") > after)), []
    for sign in (1, -1):
        for i in range(len(q.edges)):
            n = _anchored_count(q, alive, i, [s for s in shell if s not in q.edges[i][:2]], after, upto, sign)
            parts.append(n.select("seq", *((F.col("n") if sign == k else F.lit(0).cast("long")).alias(c) for k, c in ((1, "positives"), (-1, "negatives")))))
    out = reduce(DataFrame.unionByName, parts).groupBy("seq").agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    return out.filter("positives > 0 or negatives > 0")


def _anchored_count(q: QueryGraph, adj: DataFrame, anchor: int, shell: list[int], after: int, upto: int, sign: int) -> DataFrame:
    """(seq, n): embeddings that have a change at query edge ``anchor``, as sums over its core matches."""
    at, ok = {frozenset(e[:2]): i for i, e in enumerate(q.edges)}, _alive_at(anchor, sign, True)
    out, done = _anchors(adj, q, anchor, after, upto, sign), list(q.edges[anchor][:2])

    def joined(rows: DataFrame, b: int, x: int, name: str, closing: bool) -> DataFrame:
        e = edge_side(adj, q, b, x, q.neighbours(b)[x], "new").withColumnRenamed(f"u{x}", name)
        return rows.join(e, [f"u{b}"] + ([name] if closing else [])).filter(ok(at[frozenset((b, x))])).drop("s_new", "e_new")

    rest = [u for u in range(q.size) if u not in shell and u not in done]
    while rest:
        w = max((x for x in rest if any(y in done for y in q.neighbours(x))), key=lambda x: (sum(y in done for y in q.neighbours(x)), -x), default=None)
        if w is None:
            raise ValueError("the vertices outside the shell must be connected")
        rest.remove(w)
        for i, b in enumerate(x for x in q.neighbours(w) if x in done):
            out = joined(out, b, w, f"u{w}", i > 0)
            if not i and (apart := _apart(q, w, done)) is not None:
                out = out.filter(apart)
        done.append(w)
    if not shell:
        return out.groupBy("seq").agg(F.count("*").alias("n"))
    rows = cut(out.select(*(f"u{u}" for u in done), "seq").withColumn("row", F.monotonically_increasing_id()), "core")
    counted, terms, counts = {}, [], rows.select("seq", "row")
    for split in _partitions(shell):
        if any(not _one_label(q, g) for g in split):
            continue
        factors = []
        for g in map(tuple, map(sorted, split)):
            if g not in counted:
                counted[g] = f"n{len(counted)}"
                fit = rows
                for i, (s, b) in enumerate((s, b) for s in g for b in q.neighbours(s)):
                    fit = joined(fit, b, s, "x", i > 0)
                fit = fit.filter(reduce(lambda a, b: a & b, [F.col("x") != F.col(f"u{u}") for u in done]))
                counts = counts.join(fit.groupBy("row").agg(F.count("*").alias(counted[g])), "row", "left").fillna(0, [counted[g]])
            factors.append(F.col(counted[g]) * (-1) ** (len(g) - 1) * factorial(len(g) - 1))
        terms.append(reduce(lambda a, b: a * b, factors))
    return counts.groupBy("seq").agg(F.sum(reduce(lambda a, b: a + b, terms)).cast("long").alias("n"))
