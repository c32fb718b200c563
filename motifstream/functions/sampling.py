"""Query samplers and graph generators."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifstream.operators.storage import cut
from motifstream.plans.query import QueryGraph


def _neighbours(adj: DataFrame, ids: list[int], most: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """The ``most`` smallest neighbours of each vertex, with labels: a bounded look from the driver into the graph.

    Ranks are cut off before rows are shuffled, so a hub sends no more than that from a task.
    """
    rows = adj.filter(F.col("src").isin(ids)).select("src", "dst", "elabel", "src_label", "dst_label")
    near = rows.withColumn("n", F.dense_rank().over(W.partitionBy("src").orderBy("dst", "elabel"))).filter(F.col("n") <= most).drop("n").distinct()
    out: dict[int, list] = {}
    for r in sorted(near.collect()):
        out.setdefault(r["src"], []).append(tuple(r)[1:])
    return out


def sample_query(adj: DataFrame, size: int, seed: int = 0, kind: str | None = None, walk: bool = True, tries: int = 20, most: int = 200) -> QueryGraph:
    """A query of ``size`` vertices taken from the graph by a random walk or breadth first, with all edges between them.

    ``kind`` asks for tree, sparse (average degree under 3) or dense; a tree keeps the walk's own edges only.
    """
    rng = random.Random(seed)
    starts = [r["src"] for r in adj.select("src").distinct().orderBy(F.xxhash64(F.lit(seed), "src")).limit(tries).collect()]
    for start in starts:
        known: dict[int, list] = {}
        chosen, via, at = [start], [], start
        for _ in range(size * 20):
            if len(chosen) == size:
                break
            if at not in known:
                known |= _neighbours(adj, [at], most)
            options = known.get(at) or []
            if not options:
                break
            nxt = rng.choice(options)[0]
            if nxt not in chosen:
                chosen.append(nxt)
                via.append((at, nxt))
            at = nxt if walk else chosen[rng.randrange(len(chosen))]
        if len(chosen) < size:
            continue
        rows = adj.filter(F.col("src").isin(chosen) & F.col("dst").isin(chosen) & (F.col("src") < F.col("dst"))).select("src", "dst", "elabel", "src_label", "dst_label").distinct().collect()
        names, labels = {v: i for i, v in enumerate(chosen)}, [None] * size
        for r in rows:
            labels[names[r["src"]]], labels[names[r["dst"]]] = r["src_label"], r["dst_label"]
        keep = {frozenset(e) for e in via}
        edges = sorted({(names[r["src"]], names[r["dst"]]): r["elabel"] for r in rows if kind != "tree" or frozenset((r["src"], r["dst"])) in keep}.items())
        q = QueryGraph.of(labels, [(a, b, c) for (a, b), c in edges])
        if kind in (None, q.kind()):
            return q
    raise ValueError(f"no {kind or ''} query of {size} vertices found in {tries} tries")


def random_graph(spark: SparkSession, n_vertices: int, n_edges: int, n_vertex_labels: int = 1, n_edge_labels: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Uniform random labelled graph: ends and labels are hashes of the row number, so any task can make its part."""
    pick = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(n))
    vertices = spark.range(n_vertices).select("id", pick(0, n_vertex_labels).cast("int").alias("label"))
    edges = spark.range(n_edges).select(pick(1, n_vertices).alias("a"), pick(2, n_vertices).alias("b"), pick(3, n_edge_labels).cast("int").alias("elabel")).filter("a <> b")
    return vertices, edges.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "elabel").groupBy("src", "dst").agg(F.min("elabel").alias("elabel"))


def erdos_renyi(spark: SparkSession, n_vertices: int, p: float, seed: int = 0, block_edges: int = 1_000_000) -> DataFrame:
    """Each of the pairs is an edge with chance ``p``: gaps between edges are drawn, so work follows the edges, not the pairs.

    Pairs are numbered row by row and split into blocks of about ``block_edges`` edges, each with a generator of its own.
    """
    pairs = n_vertices * (n_vertices - 1) // 2
    block = max(1, math.ceil(block_edges / max(p, 1e-12)))

    def draw(batches):
        for b in batches:
            for i in b["id"].to_pylist():
                rng, size, at = np.random.default_rng([seed, i]), min(block, pairs - i * block), [np.zeros(0, np.int64)]
                last = -1
                while last < size and p > 0:
                    at.append(last + np.cumsum(rng.geometric(min(p, 1), int(size * min(p, 1) * 1.1) + 16)))
                    last = int(at[-1][-1])
                k = np.concatenate(at)
                k = k[k < size] + i * block
                src = ((2 * n_vertices - 1 - np.sqrt((2.0 * n_vertices - 1) ** 2 - 8.0 * k)) / 2).astype(np.int64)
                first = lambda a: a * (2 * n_vertices - a - 1) // 2
                src -= first(src) > k  # where the root was rounded
                src += first(src + 1) <= k
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(src + 1 + k - first(src)), pa.array(np.zeros(len(k), np.int32))], ["src", "dst", "elabel"])

    return spark.range(math.ceil(pairs / block)).mapInArrow(draw, "src long, dst long, elabel int")


def dense_ids(vertices: DataFrame) -> DataFrame:
    """(id, new_id): ids as 0 .. n - 1 in order: sizes of ranges first, then places in them."""
    ranged = vertices.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ranged.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy("id"))).join(before, "part").select("id", (F.col("before") + F.col("own") - 1).cast("long").alias("new_id"))
