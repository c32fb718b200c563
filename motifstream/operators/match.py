"""Subgraph matching as a chain of equi-joins over adjacency; Catalyst and adaptive execution choose how to join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifstream.operators.lifetimes import FOREVER
from motifstream.operators.stats import star_sizes
from motifstream.operators.storage import cut
from motifstream.plans.planner import Step, costed, graphflow, steps
from motifstream.plans.query import QueryGraph

BOTH = "both"


def edge_side(adj: DataFrame, q: QueryGraph, u: int, v: int, elabel: int, tag: str) -> DataFrame:
    """Data edges that query edge u-v can be mapped to, as (u{u}, u{v}, start, end); labels are filtered at the scan."""
    out = adj.filter(F.col("elabel") == elabel)
    for side, x in (("src_label", u), ("dst_label", v)):
        if q.label_set(x) is not None:
            out = out.filter(F.col(side).isin(sorted(q.label_set(x))))
    return out.select(F.col("src").alias(f"u{u}"), F.col("dst").alias(f"u{v}"), F.col("start_seq").alias(f"s_{tag}"), F.col("end_seq").alias(f"e_{tag}"))


def _apart(q: QueryGraph, new: int, old: list[int]):
    tests = [F.col(f"u{new}") != F.col(f"u{x}") for x in old if q.may_be_equal(new, x)]
    return reduce(lambda a, b: a & b, tests) if tests else None


def overlap(out: DataFrame, e: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with lives (st, en) joined to edges with lives (s_new, e_new), where these overlap."""
    return out.join(e, keys).withColumn("st", F.greatest("st", "s_new")).withColumn("en", F.least("en", "e_new")).drop("s_new", "e_new").filter("st < en")


def extend(q: QueryGraph, adj: DataFrame, out: DataFrame | None, step: Step, done: list[int], *, homo: bool = False, candidates: dict[int, DataFrame] | None = None, before: list[tuple[int, int]] = ()) -> DataFrame:
    """Partial matches of the vertices ``done``, joined to ``step``'s vertex over all its earlier neighbours.

    Query edges of ``before`` (i, j) keep their starts as t{i}; i has to start before j."""
    at = {frozenset(e[:2]): i for i, e in enumerate(q.edges)}
    new = f"u{step.vertex}"

    def side(b: int) -> DataFrame:
        k = at[frozenset((b, step.vertex))]
        e = edge_side(adj, q, b, step.vertex, q.neighbours(b)[step.vertex], "new")
        if any(k == j for _, j in before):
            e = e.filter("s_new > 0")  # what starts after another is not there at first
        for x in (b, step.vertex):
            if candidates and x in candidates:
                e = e.join(candidates[x].select(F.col("v").alias(f"u{x}")), f"u{x}", "left_semi")
        return e.withColumn(f"t{k}", F.col("s_new")) if any(k in pair for pair in before) else e

    def timely(rows: DataFrame, had: list[str]) -> DataFrame:
        for i, j in before:
            if {f"t{i}", f"t{j}"} <= set(rows.columns) and not {f"t{i}", f"t{j}"} <= set(had):
                rows = rows.filter(F.col(f"t{i}") < F.col(f"t{j}"))
        return rows

    def distinct_ends(rows: DataFrame) -> DataFrame:
        apart = None if homo else _apart(q, step.vertex, done)
        return rows if apart is None else rows.filter(apart)

    first = lambda b: side(b).withColumnsRenamed({"s_new": "st", "e_new": "en"})
    if step.together:
        closing = reduce(lambda rows, b: overlap(rows, side(b), [new]), step.backward[1:], first(step.backward[0]))
        joined = overlap(out, closing.withColumnsRenamed({"st": "s_new", "en": "e_new"}), [f"u{b}" for b in step.backward])
        return timely(distinct_ends(joined), out.columns)
    for i, b in enumerate(step.backward):
        if out is None:
            out = first(b)
            continue
        had = out.columns
        out = overlap(out, side(b), [f"u{b}"] + ([new] if i else []))
        out = timely(out if i else distinct_ends(out), had)
    return out


def _plan(q: QueryGraph, adj: DataFrame, order: list[int] | None, sizes: dict | None) -> list[Step]:
    """Steps with joins chosen by sizes, if any has a choice. They are counted in a stored graph, or for an order that is given; else the first edge goes first."""
    plan = steps(q, order or graphflow(q))
    if all(len(s.backward) < 2 for s in plan) or not (sizes or order or getattr(adj, "staged", None)):
        return plan
    return costed(q, [s.vertex for s in plan], sizes or star_sizes(q, adj))


def matches(q: QueryGraph, adj: DataFrame, *, order: list[int] | None = None, homo: bool = False, candidates: dict[int, DataFrame] | None = None, sizes: dict | None = None, before: list[tuple[int, int]] = ()) -> DataFrame:
    """All embeddings as (u0 .. uk-1, st, en): each exists from update st to before update en.

    Joins follow ``order``. A vertex with several earlier neighbours is joined to the one that adds fewest rows and its
    other edges are equi-joins on both ends, or its edges are joined to each other first where this is less
    (``planner.costed``); lives that do not overlap are dropped at each join. ``candidates`` (query vertex -> DataFrame
    of ids ``v``) reduces the edges before any join. ``sizes`` are those of ``stats.star_sizes``, if they are known.
    """
    plan = _plan(q, adj, order, sizes)
    out, done = None, [plan[0].vertex]
    for step in plan[1:]:
        out = extend(q, adj, out, step, done, homo=homo, candidates=candidates, before=before)
        done.append(step.vertex)
    return out.select(*(f"u{i}" for i in range(q.size)), "st", "en")


def pruning_counters(q: QueryGraph, adj: DataFrame, *, order: list[int] | None = None, homo: bool = False, candidates: dict[int, DataFrame] | None = None) -> DataFrame:
    """(step, vertex, partial, extended, indexed, joinable, unvisited, dead_ends) of each step of a search in the graph of ``adj`` (lives are ignored).

    ``partial`` matches come in; ``extended`` by a neighbour of the right labels, of these ``indexed`` are candidates,
    ``joinable`` have the other edges as well and ``unvisited`` are new to the match; ``dead_ends`` got no extension.
    """
    plan, now, parts = steps(q, order or graphflow(q)), None, []
    joins = costed(q, [s.vertex for s in plan], star_sizes(q, adj))
    flat = adj.withColumns({"start_seq": F.lit(0).cast("long"), "end_seq": F.lit(FOREVER)})
    side = lambda b, w: edge_side(flat, q, b, w, q.neighbours(b)[w], "new").drop("s_new", "e_new")
    fits = lambda df, x: df.join(candidates[x].select(F.col("v").alias(f"u{x}")), f"u{x}", "left_semi") if candidates and x in candidates else df
    first = plan[0].vertex
    now = flat if q.label_set(first) is None else flat.filter(F.col("src_label").isin(sorted(q.label_set(first))))
    now, done = cut(fits(now.select(F.col("src").alias(f"u{first}")).distinct(), first), "partial"), [first]
    for i, (step, join) in enumerate(zip(plan[1:], joins[1:]), 1):
        near, at, new = side(step.backward[0], step.vertex), f"u{step.backward[0]}", f"u{step.vertex}"
        many = now.groupBy(at).agg(F.count("*").alias("many"))
        rows = lambda df: df.agg(F.count("*").alias("n"))
        # neighbours of all matches, counted without making them
        ways = lambda df: many.join(df.groupBy(at).agg(F.count("*").alias("ways")), at).agg(F.coalesce(F.sum(F.col("many") * F.col("ways")), F.lit(0)).alias("n"))  # noqa: E731, B023
        sides = [fits(side(b, step.vertex), step.vertex) for b in join.backward]
        if join.together:
            joinable = now.join(reduce(lambda x, y: x.join(y, new), sides), [f"u{b}" for b in join.backward])  # noqa: B023
        else:
            joinable = reduce(lambda x, y: x.join(y[1], [f"u{y[0]}", new]), list(zip(join.backward, sides))[1:], now.join(sides[0], f"u{join.backward[0]}"))  # noqa: B023
        joinable = cut(joinable, "partial")
        apart = None if homo else _apart(q, step.vertex, done)
        unvisited = joinable if apart is None else joinable.filter(apart)
        dead = now.join(unvisited.select(*(f"u{x}" for x in done)).distinct(), [f"u{x}" for x in done], "left_anti")
        for name, n in (("partial", rows(now)), ("extended", ways(near)), ("indexed", ways(fits(near, step.vertex))), ("joinable", rows(joinable)), ("unvisited", rows(unvisited)), ("dead_ends", rows(dead))):
            parts.append(n.select(F.lit(i).alias("step"), F.lit(step.vertex).alias("vertex"), F.lit(name).alias("name"), "n"))
        now = unvisited
        done.append(step.vertex)
    names = ("partial", "extended", "indexed", "joinable", "unvisited", "dead_ends")
    return reduce(DataFrame.unionByName, parts).groupBy("step", "vertex").agg(*(F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in names))


def initial_count(found: DataFrame) -> DataFrame:
    return found.filter("st = 0").agg(F.count("*").alias("initial"))


def deltas(found: DataFrame) -> DataFrame:
    """(seq, positives, negatives) of every update that makes or ends an embedding."""
    ends = F.explode(F.array(F.struct(F.col("st").alias("seq"), F.lit(1).alias("p"), F.lit(0).alias("n")), F.struct(F.col("en").alias("seq"), F.lit(0).alias("p"), F.lit(1).alias("n"))))
    each = found.select(ends.alias("x")).select("x.*").filter((F.col("seq") > 0) & (F.col("seq") < FOREVER))
    return each.groupBy("seq").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def summary(found: DataFrame) -> DataFrame:
    """One row: initial, positives, negatives."""
    one = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    return found.agg(one(F.col("st") == 0).alias("initial"), one(F.col("st") > 0).alias("positives"), one(F.col("en") < FOREVER).alias("negatives"))


def cap(per_update: DataFrame, max_results: int) -> DataFrame:
    """Counts of an update, ``max_results`` at most of either kind."""
    return per_update.select("seq", F.least("positives", F.lit(max_results)).alias("positives"), F.least("negatives", F.lit(max_results)).alias("negatives"))


def enumerate_matches(found: DataFrame, size: int, max_results: int | None = None) -> DataFrame:
    """(seq, sign, mapping): sign 0 initial, 1 appears, -1 disappears; at most ``max_results`` smallest mappings an update and sign."""
    from pyspark.sql import Window as W

    mapping = F.array(*(F.col(f"u{i}") for i in range(size))).alias("mapping")
    rows = found.select(mapping, "st", F.lit(FOREVER).alias("en")).select(F.col("st").alias("seq"), F.when(F.col("st") > 0, 1).otherwise(0).alias("sign"), "mapping")
    rows = rows.unionByName(found.filter(F.col("en") < FOREVER).select(F.col("en").alias("seq"), F.lit(-1).alias("sign"), mapping))
    if max_results is None:
        return rows
    by = W.partitionBy("seq", "sign").orderBy("mapping")
    return rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= max_results).drop("n")


def precedes(q: QueryGraph, adj: DataFrame, before: list[tuple[int, int]], **options) -> DataFrame:
    """Time-constrained matching: embeddings in which query edge i was inserted before query edge j, for all (i, j). Starts are compared as soon as both edges are there."""
    return matches(q, adj, before=before, **options)
