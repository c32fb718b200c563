"""Statistics of a labelled graph; ``adj`` holds both directions of each edge."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifstream.operators.storage import cut, release
from motifstream.plans.query import QueryGraph


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def neighbour_label_freq(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("id"), F.col("dst_label").alias("label")).agg(F.count("*").alias("n"))


def edge_label_freq(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("id"), "elabel").agg(F.count("*").alias("n"))


def triple_freq(adj: DataFrame) -> DataFrame:
    """How many directed edges have each (source label, target label, edge label)."""
    return adj.groupBy("src_label", "dst_label", "elabel").agg(F.count("*").alias("n"))


def vertex_label_freq(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("label").agg(F.count("*").alias("n"))


def nlf_index(adj: DataFrame) -> DataFrame:
    """(id, vl, el): neighbours by label and edges by label, as maps whose size is the number of labels."""
    vl = neighbour_label_freq(adj).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("vl"))
    el = edge_label_freq(adj).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("elabel", "n")))).alias("el"))
    return vl.join(el, "id")


def nlf_change(events: DataFrame) -> DataFrame:
    """Signed changes of the neighbour counts from (src, dst, src_label, dst_label, is_add)."""
    sign = F.when(F.col("is_add"), 1).otherwise(-1)
    both = events.select(F.col("src").alias("id"), F.col("dst_label").alias("label"), sign.alias("n")).unionByName(events.select(F.col("dst").alias("id"), F.col("src_label").alias("label"), sign.alias("n")))
    return both.groupBy("id", "label").agg(F.sum("n").alias("n"))


def query_statistics(q: QueryGraph, adj: DataFrame, vertices: DataFrame) -> tuple[dict, dict]:
    """Frequency of each query edge's triple and of each query vertex's label. As many numbers as there are labels come to the driver."""
    triples = {(r["src_label"], r["dst_label"], r["elabel"]): r["n"] for r in triple_freq(adj).collect()}
    labels = {r["label"]: r["n"] for r in vertex_label_freq(vertices).collect()}
    fits = lambda x, u: q.label_set(u) is None or x in q.label_set(u)
    freq = {(u, v): sum(n for (a, b, el), n in triples.items() if el == c and fits(a, u) and fits(b, v)) for u, v, c in q.edges}
    return freq, {u: sum(n for x, n in labels.items() if fits(x, u)) for u in range(q.size)}


_STARS: dict[tuple, dict] = {}  # (stored graph, query) -> sizes; a stored graph does not change
MOST_ARMS = 6  # neighbours of a query vertex of which all sets are counted; of more, single ones and pairs


def star_sizes(q: QueryGraph, adj: DataFrame) -> dict[tuple[int, frozenset], float]:
    """(w, neighbours of w) -> how many rows their query edges have when joined at w by labels alone. One row comes to the driver."""
    key = getattr(adj, "staged", None), q
    if key[0] and key in _STARS:
        return _STARS[key]
    sets = [(w, frozenset(s)) for w in range(q.size) for k in range(1, q.degree(w) + 1) if k <= 2 or q.degree(w) <= MOST_ARMS for s in combinations(q.neighbours(w), k)]
    arms, fits = {}, lambda c, x: F.lit(True) if q.label_set(x) is None else F.col(c).isin(sorted(q.label_set(x)))
    for w in range(q.size):
        for b, c in q.neighbours(w).items():
            arms[w, b] = (F.col("elabel") == c) & fits("src_label", w) & fits("dst_label", b)
    name = {arm: f"d{i}" for i, arm in enumerate(arms)}
    used = adj.filter(reduce(lambda a, b: a | b, arms.values()))
    each = used.groupBy("src").agg(*(F.count_if(test).cast("double").alias(name[arm]) for arm, test in arms.items()))
    sums = [F.coalesce(F.sum(reduce(lambda a, b: a * b, [F.col(name[w, b]) for b in sorted(s)])), F.lit(0.0)).alias(f"n{i}") for i, (w, s) in enumerate(sets)]
    out = dict(zip(sets, each.agg(*sums).first()))
    if key[0]:
        _STARS[key] = out
    return out


def induced(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in ``vertices`` (id)."""
    ids = vertices.select("id").distinct()
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


SOURCES, PAIRS = 16, 20_000_000  # of the searches at once: the first ones', and the most (source, vertex) rows of later ones


def diameter(edges: DataFrame, max_rounds: int = 256, max_vertices: int | None = None) -> int:
    """Longest shortest path of a graph, exact; paths over ``max_rounds`` are an error, as are more vertices than ``max_vertices``, if given.

    Breadth-first searches from some vertices, a join a step, bound how far any vertex has others: one at distance d
    from a source that has others up to e away has them max(d, e - d) to e + d away. The next sources are those with
    the highest and the lowest bounds (then most neighbours) of all that may still have a longer path, twice as many each time, until none
    may. Few are needed where some vertices are central; in a ring each vertex is a source in the end. Rows of the
    searches are far larger than their files, so those are never broadcast.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both, "small-graph")
    state = cut(both.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree")).withColumns({"lo": F.lit(None).cast("int"), "hi": F.lit(None).cast("int")}), "bounds")
    kept, far, k = [both, state], 0, SOURCES
    try:
        if (n := state.count()) > (n if max_vertices is None else max_vertices):
            raise ValueError(f"diameter: {n} vertices, at most {max_vertices} are wanted")
        while True:
            longer = state.filter(F.col("hi").isNull() | (F.col("hi") > far))
            some = lambda m, *by: longer.orderBy(*by, F.xxhash64("v")).limit(m).select("v")  # noqa: E731, B023
            sources = some(k - k // 2, F.col("hi").desc_nulls_first()).unionByName(some(k // 2, F.col("lo").asc_nulls_last(), F.col("degree").desc())).distinct()
            fronts = [cut(sources.select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(0).alias("d")), "frontier")]
            kept += fronts
            if fronts[0].isEmpty():
                return far
            while not fronts[-1].isEmpty():
                if len(fronts) > max_rounds + 1:
                    raise RuntimeError(f"diameter: paths of more than {max_rounds} edges")
                near = fronts[-1].join(both.hint("merge"), fronts[-1]["b"] == both["src"]).select("a", F.col("dst").alias("b")).distinct()
                known = reduce(DataFrame.unionByName, fronts[-2:]).select("a", "b")  # neighbours are at most a step nearer or farther
                fronts.append(cut(near.join(known.hint("merge"), ["a", "b"], "left_anti").withColumn("d", F.lit(len(fronts))), "frontier"))
                kept.append(fronts[-1])
            reached = reduce(DataFrame.unionByName, fronts)
            own = reached.groupBy("a").agg(F.max("d").alias("e"))
            far = max(far, len(fronts) - 2)
            bounds = reached.join(F.broadcast(own), "a").groupBy(F.col("b").alias("v")).agg(F.max(F.greatest("d", F.col("e") - F.col("d"))).alias("_lo"), F.min(F.col("e") + F.col("d")).alias("_hi"))
            state = cut(state.join(bounds.hint("merge"), "v", "left").select("v", "degree", F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi")), "bounds")
            release(*kept[1:])
            kept, k = [both, state], max(1, min(2 * k, PAIRS // n))
    finally:
        release(*kept)


def edge_labels_of(pairs: DataFrame, adj: DataFrame, seq: int = 0) -> DataFrame:
    """``pairs`` (src, dst) with the label of the edge between them once update ``seq`` is applied, null where there is none."""
    alive = adj.filter((F.col("start_seq") <= seq) & (F.col("end_seq") > seq)).select("src", "dst", "elabel")
    return pairs.select("src", "dst").join(alive, ["src", "dst"], "left")
