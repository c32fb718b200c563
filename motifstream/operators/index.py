"""Candidate indexes as semi-join reductions. Taken over all edge lives they hold at every update."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifstream.operators.storage import cut, release
from motifstream.plans.planner import bfs_dag
from motifstream.plans.query import QueryGraph


def label_candidates(q: QueryGraph, vertices: DataFrame) -> dict[int, DataFrame]:
    pick = lambda u: vertices if q.label_set(u) is None else vertices.filter(F.col("label").isin(sorted(q.label_set(u))))
    return {u: pick(u).select(F.col("id").alias("v")).distinct() for u in range(q.size)}


def _reduce(cand: DataFrame, adj: DataFrame, elabel: int, other: DataFrame) -> DataFrame:
    """Candidates with a neighbour over ``elabel`` among ``other``."""
    near = adj.filter(F.col("elabel") == elabel).join(other.select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v"))
    return cand.join(near, "v", "left_semi")


def dcs(q: QueryGraph, adj: DataFrame, vertices: DataFrame, top: int, store: bool = False) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """(d1, d2): reduced along the breadth-first DAG from ``top`` downwards, then d1 upwards."""
    order, dag = bfs_dag(q, top)
    base, d1, d2 = label_candidates(q, vertices), {}, {}
    keep = (lambda df: cut(df, "candidates")) if store else (lambda df: df)
    for u in order:
        d1[u] = keep(reduce(lambda c, e: _reduce(c, adj, e[2], d1[e[0]]), [e for e in dag if e[1] == u], base[u]))
    for u in reversed(order):
        d2[u] = keep(reduce(lambda c, e: _reduce(c, adj, e[2], d2[e[1]]), [e for e in dag if e[0] == u], d1[u]))
    return d1, d2


def as_rows(cand: dict[int, DataFrame]) -> DataFrame:
    """(u, v) of all candidates."""
    return reduce(DataFrame.unionByName, [c.select(F.lit(u).alias("u"), "v") for u, c in cand.items()])


def index_size(d1: dict[int, DataFrame], d2: dict[int, DataFrame]) -> DataFrame:
    """(u, d1, d2): candidates of each query vertex."""
    a = as_rows(d1).groupBy("u").agg(F.count("*").alias("d1"))
    b = as_rows(d2).groupBy("u").agg(F.count("*").alias("d2"))
    return a.join(b, "u", "left").select("u", "d1", F.coalesce("d2", F.lit(0)).cast("long").alias("d2"))


def candidate_edges(q: QueryGraph, adj: DataFrame, cand: dict[int, DataFrame]) -> DataFrame:
    """(u, w, v, x): data edges v-x that query edge u-w can be mapped to, with candidates at both ends."""
    parts = []
    for u, w, c in q.edges:
        e = adj.filter(F.col("elabel") == c).select(F.col("src").alias("v"), F.col("dst").alias("x"))
        parts.append(e.join(cand[u], "v", "left_semi").join(cand[w].select(F.col("v").alias("x")), "x", "left_semi").select(F.lit(u).alias("u"), F.lit(w).alias("w"), "v", "x"))
    return reduce(DataFrame.unionByName, parts)


def explicit_paths(q: QueryGraph, adj: DataFrame, cand: dict[int, DataFrame], tree: list[tuple[int, int, int]], top: int) -> DataFrame:
    """(u, paths): paths from the root's candidates to u's along the spanning tree, summed level by level."""
    at = {top: cand[top].select("v", F.lit(1).cast("long").alias("n"))}
    for a, b, c in tree:
        e = adj.filter(F.col("elabel") == c).select("src", "dst").join(cand[b].select(F.col("v").alias("dst")), "dst", "left_semi")
        at[b] = at[a].join(e, at[a]["v"] == e["src"]).groupBy(F.col("dst").alias("v")).agg(F.sum("n").alias("n"))
    return reduce(DataFrame.unionByName, [x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("paths")).select(F.lit(u).alias("u"), "paths") for u, x in sorted(at.items())])


def nlf_cover(q: QueryGraph, nlf: DataFrame, vertices: DataFrame) -> DataFrame:
    """(u, v): v has u's label and, label by label, no fewer neighbours and edges. Sound over lives if ``nlf`` counts all edges ever alive."""
    labelled = vertices.select("id", "label").join(nlf, "id")
    parts = []
    for u in range(q.size):
        want_v: dict[int, int] = {}
        want_e: dict[int, int] = {}
        for w, c in q.neighbours(u).items():
            want_e[c] = want_e.get(c, 0) + 1
            if q.label_set(w) is not None and len(q.label_set(w)) == 1:
                x = next(iter(q.label_set(w)))
                want_v[x] = want_v.get(x, 0) + 1
        tests = [F.coalesce(F.element_at("vl", F.lit(x)), F.lit(0)) >= n for x, n in want_v.items()] + [F.coalesce(F.element_at("el", F.lit(x)), F.lit(0)) >= n for x, n in want_e.items()]
        own = labelled if q.label_set(u) is None else labelled.filter(F.col("label").isin(sorted(q.label_set(u))))
        parts.append(own.filter(reduce(lambda a, b: a & b, tests)).select(F.lit(u).alias("u"), F.col("id").alias("v")))
    return reduce(DataFrame.unionByName, parts)


def candidate_unsafe(q: QueryGraph, events: DataFrame, cover: DataFrame) -> DataFrame:
    """Updates (seq) that some query edge can be mapped to with candidates (u, v) at both ends: covered vertices, or lit pairs."""
    parts = []
    both = events.select("seq", "elabel", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(events.select("seq", "elabel", F.col("dst").alias("a"), F.col("src").alias("b")))
    for u, w, c in q.edges:
        x = both.filter(F.col("elabel") == c).join(cover.filter(F.col("u") == u).select(F.col("v").alias("a")), "a", "left_semi")
        parts.append(x.join(cover.filter(F.col("u") == w).select(F.col("v").alias("b")), "b", "left_semi").select("seq"))
    return reduce(DataFrame.unionByName, parts).distinct()


# ---- counters and sizes ----


def dcs_counters(q: QueryGraph, adj: DataFrame, vertices: DataFrame, d1: dict[int, DataFrame], d2: dict[int, DataFrame], top: int) -> DataFrame:
    """(u, v, n1, np1, n2, nc2) of every vertex v with u's label that has any: its edges to d1 candidates of u's parents,
    the parents with such an edge, its edges to d2 candidates of u's children, and the children with such an edge."""
    _, dag = bfs_dag(q, top)
    base, parts = label_candidates(q, vertices), []
    zero = F.lit(0).cast("long")
    for a, b, c in dag:
        edges = adj.filter(F.col("elabel") == c).select(F.col("src").alias("v"), "dst")
        for u, other, is_parent in ((b, d1[a], True), (a, d2[b], False)):
            near = edges.join(base[u], "v", "left_semi").join(other.select(F.col("v").alias("dst")), "dst", "left_semi").groupBy("v").agg(F.count("*").alias("n"))
            n, one = F.col("n"), F.lit(1).cast("long")
            parts.append(near.select(F.lit(u).alias("u"), "v", *((n.alias("n1"), one.alias("np1"), zero.alias("n2"), zero.alias("nc2")) if is_parent else (zero.alias("n1"), zero.alias("np1"), n.alias("n2"), one.alias("nc2")))))
    return reduce(DataFrame.unionByName, parts).groupBy("u", "v").agg(*(F.sum(c).alias(c) for c in ("n1", "np1", "n2", "nc2")))


def index_report(q: QueryGraph, adj: DataFrame, vertices: DataFrame, d1: dict[int, DataFrame], d2: dict[int, DataFrame]) -> DataFrame:
    """(u, w, all, d1, d2): candidates of each query vertex (w null) and data edges of each query edge, by label alone and with either flag."""
    base, parts = label_candidates(q, vertices), []
    for kind, cand in (("all", base), ("d1", d1), ("d2", d2)):
        parts.append(as_rows(cand).groupBy("u").agg(F.count("*").alias("n")).select("u", F.lit(None).cast("int").alias("w"), F.lit(kind).alias("kind"), "n"))
        parts.append(candidate_edges(q, adj, cand).groupBy("u", "w").agg(F.count("*").alias("n")).select("u", "w", F.lit(kind).alias("kind"), "n"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("u", "w").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("all", "d1", "d2")))


# ---- upkeep of the candidates ----


def dcs_update(q: QueryGraph, adj: DataFrame, changed: DataFrame, vertices: DataFrame, top: int, d1: dict[int, DataFrame], d2: dict[int, DataFrame], *, insert: bool) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """(d1, d2) after edges were inserted or deleted, from those before. ``adj`` and ``vertices`` are those after, ``changed`` has both directions.

    Only vertices at the end of a changed edge, or next to one whose flag changed, are looked at again: top-down for
    d1, then bottom-up for d2. New and removed vertices of ``vertices`` count as changed themselves.
    """
    order, dag = bfs_dag(q, top)
    base = label_candidates(q, vertices)

    def sweep(us, near, old: dict[int, DataFrame], within: dict[int, DataFrame], moved_within: dict[int, DataFrame]) -> tuple[dict, dict]:
        """One direction: ``near(u)`` are (other, edge label) that u depends on, ``within`` what the flag needs besides, ``moved_within`` what of that changed."""
        new, moved = {}, {}
        for u in us:
            touched = [moved_within[u]]
            for other, c in near(u):
                ends = (new if insert else old)[other].select(F.col("v").alias("dst"))
                touched.append(changed.filter(F.col("elabel") == c).join(ends, "dst", "left_semi").select(F.col("src").alias("v")))
                touched.append(adj.filter(F.col("elabel") == c).join(moved[other].select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v")))
            seen = reduce(DataFrame.unionByName, touched).distinct()
            look = cut(seen.join(within[u], "v", "left_semi").join(old[u], "v", "left_anti") if insert else seen.join(old[u], "v", "left_semi"), "look-again")
            own = adj.join(look.select(F.col("v").alias("src")), "src", "left_semi")
            good = look if insert else look.join(within[u], "v", "left_semi")
            for other, c in near(u):
                good = _reduce(good, own, c, new[other])
            moved[u] = cut(good if insert else look.join(good, "v", "left_anti"), "moved")
            new[u] = old[u].unionByName(moved[u]) if insert else old[u].join(moved[u], "v", "left_anti")
        return new, moved

    known = {u: (base[u].join(d1[u], "v", "left_anti") if insert else d1[u].join(base[u], "v", "left_anti")) if u == top else (d1[u].limit(0) if insert else d1[u].join(base[u], "v", "left_anti")) for u in order}
    new1, moved1 = sweep(order, lambda u: [(a, c) for a, b, c in dag if b == u], d1, base, known)
    new2, _ = sweep(list(reversed(order)), lambda u: [(b, c) for a, b, c in dag if a == u], d2, new1, moved1)
    return new1, new2


# ---- lit pairs ----


def _wants(q: QueryGraph, spark) -> DataFrame:
    """(u, w, c): the neighbours that a query vertex needs; as many rows as the query has edges, twice."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({u}, {w}, {c})" for u in range(q.size) for w, c in q.neighbours(u).items()) + " AS t(u, w, c)")


def _near_pairs(q: QueryGraph, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(u, v, w) for each data edge v-x that query edge u-w can be mapped to with (w, x) among ``ends``."""
    other = ends.select(F.col("u").alias("w"), F.col("v").alias("dst")).join(F.broadcast(_wants(q, edges.sparkSession)), "w")
    return edges.select("src", "dst", "elabel").join(other, "dst").filter(F.col("elabel") == F.col("c")).select("u", F.col("src").alias("v"), "w")


def _supported(q: QueryGraph, adj: DataFrame, pairs: DataFrame, lit: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) that have a lit neighbour for each query neighbour of u."""
    spark = adj.sparkSession
    degrees = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({u}, {q.degree(u)})" for u in range(q.size)) + " AS t(u, d)")
    met = _near_pairs(q, adj, lit).join(pairs, ["u", "v"], "left_semi").distinct()
    return met.groupBy("u", "v").agg(F.count("*").alias("k")).join(F.broadcast(degrees), "u").filter("k = d").select("u", "v")


def lighting(q: QueryGraph, adj: DataFrame, vertices: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(u, v) that stay lit: v has u's label and for each query neighbour a lit neighbour over the right edge.

    The greatest fixpoint: a round is one join of all lit pairs with the edges; it ends when none goes out. A chain of
    pairs that put each other out takes a round each; ``max_rounds`` only guards, and to reach it is an error.
    """
    lit = cut(as_rows(label_candidates(q, vertices)), "lit")
    n = lit.count()
    for _ in range(max_rounds):
        before, lit = lit, cut(lit.join(_supported(q, adj, lit, lit), ["u", "v"], "left_semi"), "lit")
        release(before)
        if (now := lit.count()) == n:
            return lit
        n = now
    raise RuntimeError(f"lighting: pairs still go out after {max_rounds} rounds")


def turn_off(q: QueryGraph, lit: DataFrame, adj: DataFrame, deleted: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Lit pairs after ``deleted`` (both directions of edges) left ``adj``: only pairs that lost a neighbour are looked at."""
    return _put_out(q, lit, adj, _near_pairs(q, deleted, lit).select("u", "v"), max_rounds)


def _put_out(q: QueryGraph, lit: DataFrame, adj: DataFrame, look: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``lit`` without the pairs of ``look`` that have lost their support, and those that lose it by that."""
    for _ in range(max_rounds):
        asked = cut(look.distinct().join(lit, ["u", "v"], "left_semi"), "asked")
        out = cut(asked.join(_supported(q, adj, asked, lit), ["u", "v"], "left_anti"), "out")
        release(asked)
        if out.isEmpty():
            return lit
        lit = cut(lit.join(out, ["u", "v"], "left_anti"), "lit")
        look = _near_pairs(q, adj, out).select("u", "v")
    raise RuntimeError(f"lit pairs: some still go out after {max_rounds} rounds")


def turn_on(q: QueryGraph, lit: DataFrame, adj: DataFrame, inserted: DataFrame, vertices: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Lit pairs after ``inserted`` (both directions of edges) came to ``adj``.

    Pairs that could light up are those reached from the new edges over pairs that are out; of these, what is left
    once those without support have gone joins the lit ones, which stay lit.
    """
    may = as_rows(label_candidates(q, vertices)).join(lit, ["u", "v"], "left_anti")
    may = cut(may, "unlit")
    region, front = [], cut(_near_pairs(q, inserted, as_rows(label_candidates(q, vertices))).select("u", "v").distinct().join(may, ["u", "v"], "left_semi"), "front")
    for _ in range(max_rounds):
        if front.isEmpty():
            break
        region.append(front)
        known = reduce(DataFrame.unionByName, region)
        front = cut(_near_pairs(q, adj, front).select("u", "v").distinct().join(may, ["u", "v"], "left_semi").join(known, ["u", "v"], "left_anti"), "front")
    else:
        raise RuntimeError(f"turn_on: still spreading after {max_rounds} rounds")
    if not region:
        return lit
    new = cut(reduce(DataFrame.unionByName, region), "region")
    release(may, *region)
    n = new.count()
    for _ in range(max_rounds):
        new = cut(new.join(_supported(q, adj, new, lit.unionByName(new)), ["u", "v"], "left_semi"), "region")
        if (now := new.count()) == n:
            return lit.unionByName(new)
        n = now
    raise RuntimeError(f"turn_on: pairs still go out after {max_rounds} rounds")


def representatives(q: QueryGraph, adj: DataFrame, lit: DataFrame) -> DataFrame:
    """Lit (u, v) whose query neighbours can all get different lit neighbours of v: Hall's condition over all sets of them.

    Each neighbour x of v is a bit mask of the query neighbours it can serve; a set of these is served if as many
    neighbours of v have a bit of it. Sets of neighbours that no vertex can serve together hold if their members do.
    """
    served = adj.select(F.col("src").alias("v"), "dst", "elabel")
    out = []
    for u in range(q.size):
        ws = list(q.neighbours(u))
        own = lit.filter(F.col("u") == u)
        meet = lambda a, b: q.label_set(a) is None or q.label_set(b) is None or q.label_set(a) & q.label_set(b)
        sets = [m for m in range(1, 1 << len(ws)) if any(meet(a, b) for i, a in enumerate(ws) for j, b in enumerate(ws) if i < j and m >> i & 1 and m >> j & 1)]
        if not sets:
            out.append(own.select("u", "v"))
            continue
        bits = [lit.filter(F.col("u") == w).select(F.col("v").alias("dst"), F.lit(q.neighbours(u)[w]).alias("elabel"), F.lit(1 << i).alias("bit")) for i, w in enumerate(ws)]
        masks = served.join(reduce(DataFrame.unionByName, bits), ["dst", "elabel"]).groupBy("v", "dst").agg(F.bit_or("bit").alias("mask"))
        enough = masks.groupBy("v").agg(*(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(m)) != 0, 1).otherwise(0)).alias(f"k{m}") for m in sets))
        ok = enough.filter(reduce(lambda a, b: a & b, [F.col(f"k{m}") >= bin(m).count("1") for m in sets])).select("v")
        out.append(own.join(ok, "v", "left_semi").select("u", "v"))
    return reduce(DataFrame.unionByName, out)


def lighting_apart(q: QueryGraph, adj: DataFrame, vertices: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Lit pairs whose neighbours can be given different vertices: both conditions over and over until nothing goes out."""
    lit = lighting(q, adj, vertices)
    for _ in range(max_rounds):
        apart = cut(representatives(q, adj, lit), "apart")
        gone = cut(lit.join(apart, ["u", "v"], "left_anti"), "gone")
        if gone.isEmpty():
            return apart
        lit = _put_out(q, apart, adj, _near_pairs(q, adj, gone).select("u", "v"))
    raise RuntimeError(f"lighting_apart: pairs still go out after {max_rounds} rounds")
