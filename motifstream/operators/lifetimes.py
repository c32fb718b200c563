"""Ordered updates as lifetimes: each vertex or edge lives over update numbers [start_seq, end_seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The end of what is never deleted.
FOREVER = 9223372036854775807


def _alternating(ops: DataFrame, key: list[str]) -> DataFrame:
    """(key, label, start_seq, end_seq) from ops (key, seq, is_add, label): an op that leaves the state as it was is dropped."""
    by = W.partitionBy(*key).orderBy("seq")
    was = F.coalesce(F.lag("is_add").over(by), F.lit(False))
    real = ops.withColumn("was", was).filter(F.col("is_add") != F.col("was"))
    ends = real.withColumn("end_seq", F.coalesce(F.lead("seq").over(by), F.lit(FOREVER)))
    return ends.filter("is_add").select(*key, "label", F.col("seq").alias("start_seq"), "end_seq")


def vertex_lifetimes(vertices: DataFrame, updates: DataFrame | None = None) -> DataFrame:
    """(id, label, start_seq, end_seq). The first label of a life wins; a vertex added again starts a new life."""
    first = vertices.select("id", "label").groupBy("id").agg(F.min("label").alias("label"))
    ops = first.select("id", F.lit(0).cast("long").alias("seq"), F.lit(True).alias("is_add"), "label")
    if updates is None:
        return ops.select("id", "label", F.col("seq").alias("start_seq"), F.lit(FOREVER).alias("end_seq"))
    more = updates.filter("kind = 'v'").select(F.col("id1").alias("id"), "seq", "is_add", "label")
    return _alternating(ops.unionByName(more), ["id"])


def edge_ops(edges: DataFrame, updates: DataFrame, cascade_vertex_delete: bool = True) -> DataFrame:
    """(lo, hi, seq, is_add, label): edges given at first, edge updates, and a delete for each edge of a deleted vertex."""
    first = edges.filter("src <> dst").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.lit(0).cast("long").alias("seq"), F.lit(True).alias("is_add"), F.col("elabel").alias("label"))
    first = first.groupBy("lo", "hi", "seq", "is_add").agg(F.min("label").alias("label"))
    later = updates.filter("kind = 'e' and id1 <> id2").select(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi"), "seq", "is_add", "label")
    ops = first.unionByName(later)
    if cascade_vertex_delete:
        ops = ops.unionByName(closings(ops, updates))
    return ops


def closings(ops: DataFrame, updates: DataFrame) -> DataFrame:
    """For each add the first delete of either end after it, as a delete of the edge: no more rows than twice the adds.

    A vertex brings the list of its own deletes to its edges, so a hub that is deleted often costs its edges one look
    into that list each.
    """
    gone = updates.filter("kind = 'v' and not is_add").groupBy(F.col("id1").alias("id")).agg(F.collect_set("seq").alias("ats"))
    adds = ops.filter("is_add").select("lo", "hi", "seq")
    first = F.array_min(F.filter("ats", lambda x: x > F.col("seq")))
    ends = [adds.join(gone, adds[end] == gone["id"]).select("lo", "hi", first.alias("at")) for end in ("lo", "hi")]
    hit = ends[0].unionByName(ends[1]).filter("at is not null").distinct()
    return hit.select("lo", "hi", F.col("at").alias("seq"), F.lit(False).alias("is_add"), F.lit(None).cast("int").alias("label"))


def edge_lifetimes(edges: DataFrame, updates: DataFrame | None = None, cascade_vertex_delete: bool = True) -> DataFrame:
    """(src, dst, elabel, start_seq, end_seq) with src < dst. Repeated adds and deletes of missing edges do nothing."""
    if updates is None:
        lo, hi = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
        return edges.filter("src <> dst").select(lo, hi, "elabel").groupBy("src", "dst").agg(F.min("elabel").alias("elabel")).select(
            "src", "dst", "elabel", F.lit(0).cast("long").alias("start_seq"), F.lit(FOREVER).alias("end_seq"))
    return _alternating(edge_ops(edges, updates, cascade_vertex_delete), ["lo", "hi"]).select(
        F.col("lo").alias("src"), F.col("hi").alias("dst"), F.col("label").cast("int").alias("elabel"), "start_seq", "end_seq")


def ignored_updates(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """(seq) of edge updates that change nothing."""
    by = W.partitionBy("lo", "hi").orderBy("seq")
    ops = edge_ops(edges, updates).withColumn("was", F.coalesce(F.lag("is_add").over(by), F.lit(False)))
    return ops.filter("is_add = was").join(updates.filter("kind = 'e'").select("seq"), "seq", "left_semi").select("seq").distinct()


def label_edges(lives: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edge lives with src_label and dst_label; ``vertices`` may have lives of its own, in which an edge must start."""
    timed = "start_seq" in vertices.columns
    for end in ("src", "dst"):
        v = vertices.select(F.col("id").alias("_id"), F.col("label").alias(f"{end}_label"), *([F.col("start_seq").alias("_from"), F.col("end_seq").alias("_to")] if timed else []))
        on = lives[end] == v["_id"]
        lives = lives.join(v, on & (lives["start_seq"] >= v["_from"]) & (lives["start_seq"] < v["_to"]) if timed else on).drop("_id", "_from", "_to")
    return lives


def adjacency(labelled: DataFrame) -> DataFrame:
    """Both directions of labelled edge lives."""
    names = ["src", "dst", "elabel", "src_label", "dst_label", "start_seq", "end_seq"]
    turned = labelled.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "elabel", F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label"), "start_seq", "end_seq")
    return labelled.select(*names).unionByName(turned)


def build_adjacency(vertices: DataFrame, edges: DataFrame, updates: DataFrame | None = None, cascade_vertex_delete: bool = True) -> DataFrame:
    """From raw tables to symmetric labelled lives."""
    timed = updates is not None and not updates.filter("kind = 'v'").isEmpty()
    v = vertex_lifetimes(vertices, updates if timed else None)
    return adjacency(label_edges(edge_lifetimes(edges, updates, cascade_vertex_delete), v if timed else v.select("id", "label")))


def snapshot(adj: DataFrame, seq: int = 0) -> DataFrame:
    """What is alive once update ``seq`` is applied."""
    return adj.filter((F.col("start_seq") <= seq) & (F.col("end_seq") > seq))


NAMES = ["src", "dst", "elabel", "src_label", "dst_label", "start_seq", "end_seq"]


def store_adjacency(adj: DataFrame, path: str) -> DataFrame:
    """``adj`` written once for many queries: a folder for each edge label, and in each file rows by label and vertex.

    A query edge then reads its edge label's folder only, and of its files the parts with its vertex labels.
    """
    adj.select(*NAMES).sortWithinPartitions("elabel", "src_label", "dst_label", "src").write.partitionBy("elabel").parquet(path)
    return read_adjacency(adj.sparkSession, path)


def read_adjacency(spark, path: str) -> DataFrame:
    kinds = {"elabel": "int", "src_label": "int", "dst_label": "int"}
    out = spark.read.schema(", ".join(f"{c} {kinds.get(c, 'long')}" for c in NAMES)).parquet(path).select(*NAMES)
    out.staged = path
    return out
