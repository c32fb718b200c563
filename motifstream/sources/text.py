"""Text formats of graphs and update streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifstream.plans.query import QueryGraph


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x"))


def _at(i: int, kind: str = "long"):
    return F.get("x", F.lit(i)).cast(kind)


def read_graph(spark: SparkSession, path: str, edge_labels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, label), edges(src, dst, elabel)). Headers, more fields, self loops and broken lines are skipped."""
    x = _tokens(spark, path)
    vertices = x.filter("x[0] = 'v'").select(_at(1).alias("id"), _at(2, "int").alias("label")).filter("id is not null")
    elabel = F.coalesce(_at(3, "int"), F.lit(0)) if edge_labels else F.lit(0)
    edges = x.filter("x[0] = 'e'").select(_at(1).alias("src"), _at(2).alias("dst"), elabel.alias("elabel"))
    return vertices, edges.filter("src <> dst")


def restrict_to_labels(vertices: DataFrame, edges: DataFrame, q: QueryGraph) -> tuple[DataFrame, DataFrame]:
    """Only vertices whose label the query has, and edges between them."""
    labels = sorted(set().union(*(q.label_set(u) or set() for u in range(q.size))))
    own = vertices if any(q.label_set(u) is None for u in range(q.size)) else vertices.filter(F.col("label").isin(labels))
    ids = own.select("id")
    kept = edges.join(ids, edges["src"] == ids["id"], "left_semi")
    return own, kept.join(ids, kept["dst"] == ids["id"], "left_semi")


def number_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (value) read from files, with ``seq`` from 1: files by name, lines in order.

    A line's place in its part of a file comes from the scan; lines before that part are counted by part, which is a
    row for each, so nothing is sorted or sent to Python.
    """
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parts = placed.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(parts.withColumn("before", before).drop("n"), ["file", "block"]).select((F.col("at") - F.col("first") + F.col("before") + 1).alias("seq"), "value")


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """(seq, kind, is_add, id1, id2, label) of a stream of ``v -v e -e`` lines."""
    x = number_lines(spark.read.text(path)).select("seq", F.split(F.trim("value"), r"\s+").alias("x"))
    op = F.get("x", F.lit(0))
    edge = op.endswith("e")
    return x.filter(op.isin("v", "-v", "e", "-e")).select(
        "seq", F.when(edge, "e").otherwise("v").alias("kind"), (~op.startswith("-")).alias("is_add"), _at(1).alias("id1"),
        F.when(edge, _at(2)).alias("id2"), F.when(edge, _at(3, "int")).otherwise(_at(2, "int")).alias("label"))


def decode_signed_updates(rows: DataFrame) -> DataFrame:
    """(seq, a, b) with deletions as -id - 1 -> updates without edge labels."""
    gone = F.col("a") < 0
    real = lambda c: F.when(F.col(c) < 0, -F.col(c) - 1).otherwise(F.col(c))
    return rows.select("seq", F.lit("e").alias("kind"), (~gone).alias("is_add"), real("a").alias("id1"), real("b").alias("id2"), F.lit(0).alias("label"))


def read_signed_updates(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """``e a b`` lines, deletions as -id - 1; only the first so many where asked for."""
    x = number_lines(spark.read.text(path)).select("seq", F.split(F.trim("value"), r"\s+").alias("x")).filter("x[0] = 'e'")
    rows = x.select("seq", _at(1).alias("a"), _at(2).alias("b"))
    return decode_signed_updates(rows if first is None else rows.filter(F.col("seq") <= first))


def read_queries(spark: SparkSession, folder: str, edge_labels: bool = True) -> dict[str, QueryGraph]:
    """All query graphs of a folder by file name. Query graphs are tiny; they are read to the driver."""
    lines = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return {r["name"]: QueryGraph.parse(r["value"], edge_labels) for r in lines.collect()}


def read_timed_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src dst elabel srclabel dstlabel ts`` lines."""
    x = _tokens(spark, path).filter(F.size("x") >= 6)
    names = (("src", "long"), ("dst", "long"), ("elabel", "int"), ("src_label", "int"), ("dst_label", "int"), ("ts", "long"))
    return x.select(*(_at(i, kind).alias(c) for i, (c, kind) in enumerate(names)))


def graph_lines(vertices: DataFrame, edges: DataFrame, edge_labels: bool = True) -> DataFrame:
    v = vertices.select(F.lit(0).alias("o"), F.col("id").alias("k"), F.concat_ws(" ", F.lit("v"), "id", "label").alias("value"))
    e = edges.select(F.lit(1).alias("o"), F.col("src").alias("k"), F.concat_ws(" ", F.lit("e"), "src", "dst", *(["elabel"] if edge_labels else [])).alias("value"))
    return v.unionByName(e)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, edge_labels: bool = True) -> None:
    """Vertices before edges, as the loader of the text format needs them: ranges of lines, in order over the part files."""
    graph_lines(vertices, edges, edge_labels).orderBy("o", "k").select("value").write.text(path)


def update_lines(updates: DataFrame) -> DataFrame:
    """(seq, value): updates as ``v -v e -e`` lines."""
    op = F.concat(F.when(F.col("is_add"), "").otherwise("-"), "kind")
    return updates.select("seq", F.concat_ws(" ", op, "id1", "id2", F.when(F.col("is_add") | (F.col("kind") == "v"), F.col("label"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """(seq, value) as text, in order over the part files."""
    lines.orderBy("seq", "value").select("value").write.text(path)


def timed_edge_lines(edges: DataFrame) -> DataFrame:
    """``src dst elabel srclabel dstlabel ts`` lines."""
    return edges.select(F.concat_ws(" ", "src", "dst", "elabel", "src_label", "dst_label", "ts").alias("value"))


def encode_signed_updates(updates: DataFrame) -> DataFrame:
    """Edge updates as ``e a b`` lines with deletions as -id - 1."""
    put = lambda c: F.when(F.col("is_add"), F.col(c)).otherwise(-F.col(c) - 1)
    return updates.filter("kind = 'e'").select("seq", F.concat_ws(" ", F.lit("e"), put("id1"), put("id2")).alias("value"))
