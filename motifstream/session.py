"""The entry to continuous subgraph matching."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from motifstream.functions.limits import tuned_partitions, within
from motifstream.operators import counting, delta, index, lifetimes, stats
from motifstream.operators import match as m
from motifstream.operators.sjtree import joined_leaves
from motifstream.plans import planner
from motifstream.plans.query import QueryGraph


class Strategy(Protocol):
    """How embeddings are found. ``CsmSession.register`` adds one by name; all must give the same answers."""

    def plan(self, query: QueryGraph, adj: DataFrame, vertices: DataFrame, *, homo: bool, order: list[int] | None) -> DataFrame:
        """(u0 .., st, en): each embedding exists from update st to before update en."""

    def shell(self, query: QueryGraph) -> list[int]:
        """Query vertices that may be counted instead of joined; none of them touch."""


@dataclass(frozen=True)
class Direct:
    """Joins in a fixed order without an index; counts leave out the vertices that the order puts last and nothing depends on."""

    name: str

    def plan(self, query, adj, vertices, *, homo, order):
        return m.matches(query, adj, order=order or planner.plan_order(query, self.name), homo=homo)

    def shell(self, query):
        if self.name == "calig":
            return planner.kernel_shell(query, *query.edges[0][:2])[1]
        return planner.isolated(query, planner.newsp(query)) if self.name == "newsp" else []


class SjTree:
    """Binary joins of query edges: the rarest first, then those that add fewest rows."""

    def plan(self, query, adj, vertices, *, homo, order):
        freq, _ = stats.query_statistics(query, adj, vertices)
        return joined_leaves(query, adj, planner.sj_leaves(query, freq, stats.star_sizes(query, adj)), homo=homo)

    def shell(self, query):
        return []


@dataclass(frozen=True)
class Reduced:
    """Candidates reduced by semi-joins both ways along the query first, then joins in the strategy's order."""

    name: str

    def plan(self, query, adj, vertices, *, homo, order):
        freq, label_freq = stats.query_statistics(query, adj, vertices)
        top = planner.root(query, freq, label_freq)
        sizes = None if query.is_tree() else stats.star_sizes(query, adj)
        _, d2 = index.dcs(query, adj, _all_ids(vertices, adj), top, store=True)
        if not order and self.name == "turboflux":
            tree = planner.spanning_tree(query, top, freq)
            paths = {r["u"]: r["paths"] for r in index.explicit_paths(query, adj, d2, tree, top).collect()}
            order = planner.plan_order(query, self.name, freq, label_freq, paths)
        elif not order and self.name == "symbi":
            counts = {r["u"]: r["n"] for r in index.as_rows(d2).groupBy("u").count().withColumnRenamed("count", "n").collect()}
            order = planner.by_candidates(query, top, counts, sizes)
        return m.matches(query, adj, order=order or planner.plan_order(query, self.name, freq, label_freq), homo=homo, candidates=d2, sizes=sizes)

    def shell(self, query):
        return []


@dataclass
class Result:
    """Lazy results of one query: attributes are DataFrames, ``run`` computes them under the time limits."""

    query: QueryGraph
    found: DataFrame
    max_results: int | None = None
    report_initial: bool = True
    initial_time_limit: float | None = None
    time_limit: float | None = None

    @property
    def matches(self) -> DataFrame:
        """(seq, sign, mapping)."""
        rows = m.enumerate_matches(self.found, self.query.size, self.max_results)
        return rows if self.report_initial else rows.filter("sign <> 0")

    @property
    def deltas(self) -> DataFrame:
        rows = m.deltas(self.found)
        return rows if self.max_results is None else m.cap(rows, self.max_results)

    @property
    def summary(self) -> DataFrame:
        out = m.summary(self.found)
        return out if self.report_initial else out.drop("initial")

    def run(self) -> dict[str, int]:
        """initial (if reported), positives and negatives; each of both phases raises TimeLimitExceeded beyond its limit."""
        spark, out = self.found.sparkSession, {}
        if self.report_initial:
            out["initial"] = within(spark, self.initial_time_limit, lambda: m.initial_count(self.found).first()["initial"])
        row = within(spark, self.time_limit, lambda: m.summary(self.found.filter((m.F.col("st") > 0) | (m.F.col("en") < lifetimes.FOREVER))).first())
        return out | {"positives": row["positives"], "negatives": row["negatives"]}


@dataclass
class CsmSession:
    """Matches queries in a graph under a stream of updates.

    ``strategy`` names the planner: graphflow, sj-tree, turboflux, symbi, iedyn (tree queries only), newsp or calig, or one
    that was registered. All give the same answers; symbi, turboflux and iedyn also reduce candidates first.
    ``auto_tuning`` sets the number of shuffle partitions from the size of the edges.
    """

    spark: SparkSession
    auto_tuning: bool = False
    strategies: dict[str, Strategy] = field(default_factory=lambda: {n: SjTree() if n == "sj-tree" else Reduced(n) if n in ("turboflux", "symbi", "iedyn") else Direct(n) for n in planner.STRATEGIES})

    def register(self, name: str, strategy: Strategy) -> None:
        self.strategies[name] = strategy

    def match(self, query: QueryGraph, vertices: DataFrame, edges: DataFrame, updates: DataFrame | None = None, *, homo: bool = False, strategy: str = "graphflow",
              max_results: int | None = None, orders: list[int] | None = None, report_initial: bool = True, cascade_vertex_delete: bool = True,
              initial_time_limit: float | None = None, time_limit: float | None = None) -> Result:
        if self.auto_tuning:
            n_bytes = int(str(edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            if n_bytes < 1 << 60:  # more means that Spark does not know
                self.spark.conf.set("spark.sql.shuffle.partitions", tuned_partitions(self.spark, n_bytes))
        adj = lifetimes.build_adjacency(vertices, edges, updates, cascade_vertex_delete)
        return Result(query, self.plan(query, adj, vertices, homo=homo, strategy=strategy, order=orders), max_results, report_initial, initial_time_limit, time_limit)

    def _strategy(self, name: str) -> Strategy:
        if name not in self.strategies:
            raise ValueError(f"no strategy {name}; there are {', '.join(self.strategies)}")
        return self.strategies[name]

    def plan(self, query: QueryGraph, adj: DataFrame, vertices: DataFrame, *, homo: bool = False, strategy: str = "graphflow", order: list[int] | None = None) -> DataFrame:
        """(u0 .., st, en) by the strategy's order and reductions."""
        return self._strategy(strategy).plan(query, adj, vertices, homo=homo, order=order)

    def count_deltas(self, query: QueryGraph, adj: DataFrame, *, strategy: str = "calig", after: int = 0, upto: int = lifetimes.FOREVER - 1, orders: dict[int, list[int]] | None = None) -> DataFrame:
        """(seq, positives, negatives) of the updates in (after, upto], from the updates outwards.

        Vertices that the strategy sets apart (calig's shell, newsp's isolated ones) are counted, not joined.
        ``orders`` has orders of its own for some query edges and joins all vertices.
        """
        shell = [] if orders else self._strategy(strategy).shell(query)
        if shell:
            return counting.shell_deltas(query, adj, shell, after, upto)
        return delta.anchored_deltas(query, adj, after, upto, orders=orders)


def _all_ids(vertices: DataFrame, adj: DataFrame) -> DataFrame:
    """Ids with the labels they have in any edge life: a superset over all updates."""
    return adj.selectExpr("src AS id", "src_label AS label").distinct()
