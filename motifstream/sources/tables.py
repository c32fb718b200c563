"""Property graphs over relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from motifstream.operators.lifetimes import FOREVER, adjacency, label_edges

#: Id offsets and labels of the vertex tables, and the edge labels.
CUSTOMER, PART, SUPPLIER, NATION = 1_000_000_000, 2_000_000_000, 3_000_000_000, 4_000_000_000
CUSTOMERS, PART_LABEL, SUPPLIER_LABEL, NATION_LABEL = (0, 1, 2, 3, 4), 10, 20, 30
BUYS, SUPPLIED_BY, OF_NATION, IN_NATION = 0, 1, 2, 3


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label): customers by market segment, parts, suppliers, nations."""
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    segments = customer.select("c_mktsegment").distinct().withColumn("label", (F.dense_rank().over(W.orderBy("c_mktsegment")) - 1).cast("int"))
    one = lambda t, c, base, label: _read(spark, sf_dir, t).select((F.col(c) + base).cast("long").alias("id"), F.lit(label).alias("label"))
    out = customer.join(segments, "c_mktsegment").select((F.col("c_custkey") + CUSTOMER).cast("long").alias("id"), "label")
    return out.unionByName(one("part", "p_partkey", PART, PART_LABEL)).unionByName(one("supplier", "s_suppkey", SUPPLIER, SUPPLIER_LABEL)).unionByName(one("nation", "n_nationkey", NATION, NATION_LABEL))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of customers and suppliers to their nations, as in ``trade_edges``."""
    at = lambda c, base, name: (F.col(c) + base).cast("long").alias(name)
    none = F.lit(None).cast("long").alias("ord")
    out = _read(spark, sf_dir, "customer").select(at("c_custkey", CUSTOMER, "src"), at("c_nationkey", NATION, "dst"), F.lit(OF_NATION).alias("elabel"), none)
    return out.unionByName(_read(spark, sf_dir, "supplier").select(at("s_suppkey", SUPPLIER, "src"), at("s_nationkey", NATION, "dst"), F.lit(IN_NATION).alias("elabel"), none))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, elabel, ord): ``ord`` is the place of a purchase's first line, null for the other edges."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    at = lambda c, base, name: (F.col(c) + base).cast("long").alias(name)
    buys = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ord"))
    none = F.lit(None).cast("long").alias("ord")
    out = buys.select(at("o_custkey", CUSTOMER, "src"), at("l_partkey", PART, "dst"), F.lit(BUYS).alias("elabel"), "ord")
    out = out.unionByName(lines.select("l_partkey", "l_suppkey").distinct().select(at("l_partkey", PART, "src"), at("l_suppkey", SUPPLIER, "dst"), F.lit(SUPPLIED_BY).alias("elabel"), none))
    return out.unionByName(_nations(spark, sf_dir))


def trade_bounds(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The last place of all lines, and the place after which purchases are inserted by the stream."""
    last = _read(spark, sf_dir, "lineitem").agg(F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("m")).first()["m"] or 0
    return int(last), int(last) * 9 // 10


def trade_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges at first, updates): the last tenth of purchases is inserted, then every 200th old one is deleted."""
    last, cut = trade_bounds(spark, sf_dir)
    edges = trade_edges(spark, sf_dir)
    first = edges.filter(F.col("ord").isNull() | (F.col("ord") <= cut)).select("src", "dst", "elabel")
    op = lambda df, seq, add: df.select(seq.alias("seq"), F.lit("e").alias("kind"), F.lit(add).alias("is_add"), F.col("src").alias("id1"), F.col("dst").alias("id2"), F.col("elabel").alias("label"))
    adds = op(edges.filter(F.col("ord") > cut), F.col("ord") - cut, True)
    gone = op(edges.filter((F.col("ord") <= cut) & (F.col("ord") % 200 == 1)), F.col("ord") + (last - cut), False)
    return first, adds.unionByName(gone)


def _life(place, last: int, cut: int) -> list:
    """start_seq and end_seq of a purchase by its place; those of other edges, where it is null, have no end."""
    start = F.when(place > cut, place - cut).otherwise(0).cast("long")
    end = F.when((place <= cut) & (place % 200 == 1), place + (last - cut)).otherwise(FOREVER).cast("long")
    return [start.alias("start_seq"), end.alias("end_seq")]


def trade_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, elabel, start_seq, end_seq) of the same stream without going through its updates: each pair changes once."""
    return trade_edges(spark, sf_dir).select("src", "dst", "elabel", *_life(F.col("ord"), *trade_bounds(spark, sf_dir)))


def trade_adjacency(spark: SparkSession, sf_dir: str, vertices: DataFrame) -> DataFrame:
    """``trade_lives``, labelled by ``vertices``, in both directions.

    The lines are most of it, so they are labelled on their way: an order brings its customer's label, and where lines are
    dealt by part both their label and what repeats among them are there. Each line is dealt to its order and to its part,
    and once to its part and to its supplier as a pair, instead of to both ends again as an edge. An id that ``vertices``
    has several times labels its edges as often: ``many`` counts these, since equal purchases and pairs are made one between.
    """
    at = lambda c, base, name: (F.col(c) + base).cast("long").alias(name)
    known = vertices.groupBy("id", "label").agg(F.count("*").cast("int").alias("many"))
    label = lambda df, end: df.join(known.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"), F.col("many").alias(f"{end}_many")), end)
    lines, ends = _read(spark, sf_dir, "lineitem"), ["src", "dst", "src_label", "dst_label", "src_many", "dst_many"]
    buyers = label(_read(spark, sf_dir, "orders").select("o_orderkey", at("o_custkey", CUSTOMER, "src")), "src")
    buys = lines.select("l_orderkey", "l_linenumber", at("l_partkey", PART, "dst")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    buys = buys.withColumn("place", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")).drop("l_orderkey", "l_linenumber", "o_orderkey")
    buys = label(buys, "dst").groupBy(*ends).agg(F.min("place").alias("place")).withColumn("elabel", F.lit(BUYS))
    pairs = label(lines.select(at("l_partkey", PART, "src"), at("l_suppkey", SUPPLIER, "dst")), "src").distinct()
    pairs = label(pairs, "dst").select(*ends, F.lit(None).cast("long").alias("place"), F.lit(SUPPLIED_BY).alias("elabel"))
    both = lambda df, *life: df.select(F.inline(F.flatten(F.array_repeat(F.array(*(F.struct(
        F.col(a).alias("src"), F.col(b).alias("dst"), "elabel", F.col(f"{a}_label").alias("src_label"), F.col(f"{b}_label").alias("dst_label"), *life) for a, b in (("src", "dst"), ("dst", "src")))), F.col("src_many") * F.col("dst_many")))))
    life = _life(F.col("place"), *trade_bounds(spark, sf_dir))
    out = both(buys, *life).unionByName(both(pairs, *life))
    return out.unionByName(adjacency(label_edges(_nations(spark, sf_dir).select("src", "dst", "elabel", *_life(F.col("ord"), 0, 0)), vertices)))


EVENT_TYPE = 1_000_000_000


def event_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream: users and event types joined by edges; every third event deletes, every 97th deletes its user."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", F.crc32(F.col("event_type").cast("binary")).alias("t"))
    seq = (F.col("event_id") + 1).cast("long")
    gone = F.col("event_id") % 97 == 0
    return e.select(seq.alias("seq"), F.when(gone, "v").otherwise("e").alias("kind"), (~gone & (F.col("event_id") % 3 != 0)).alias("is_add"), F.col("user_id").cast("long").alias("id1"),
        F.when(~gone, (F.lit(EVENT_TYPE) + F.col("t") % 1000).cast("long")).alias("id2"), (F.col("event_id") % 2).cast("int").alias("label"))
