"""The stored trade graph: right for keys that repeat or lead nowhere, and what storing it deals out."""

import time

import duckdb
import pytest

from motifstream import queries
from motifstream.operators import lifetimes
from motifstream.operators.storage import FILE_CLEANUP
from motifstream.sources import tables

COLUMNS = "src, dst, elabel, src_label, dst_label, start_seq, end_seq"


@pytest.fixture
def odd(tmp_path):
    """Customer 1 has two segments, customer 2 two equal rows, part 3 three; some orders, parts, suppliers and customers are missing, some keys null."""
    con = duckdb.connect()
    for name, rows in {
        "nation": "SELECT i::INT AS n_nationkey FROM range(4) t(i)",
        "customer": "SELECT * FROM (SELECT i AS c_custkey, (i % 5)::INT AS c_nationkey, 'S' || i % 3 AS c_mktsegment FROM range(20) t(i) UNION ALL VALUES (1::BIGINT, 2::INT, 'S0'), (2, 2, 'S2'), (6, NULL, 'S0'))",
        "supplier": "SELECT i AS s_suppkey, (i % 5)::INT AS s_nationkey FROM range(7) t(i) UNION ALL VALUES (3::BIGINT, 3::INT)",
        "part": "SELECT i AS p_partkey FROM range(12) t(i) UNION ALL VALUES (3::BIGINT), (3)",
        "orders": "SELECT i AS o_orderkey, CASE WHEN i % 13 = 5 THEN NULL ELSE i * 7 % 23 END AS o_custkey FROM range(98) t(i) UNION ALL VALUES (4::BIGINT, 5::BIGINT)",
        "lineitem": "SELECT i // 4 AS l_orderkey, (i % 4)::INT AS l_linenumber, CASE WHEN i % 31 = 7 THEN NULL ELSE i * 5 % 14 END AS l_partkey, CASE WHEN i % 37 = 9 THEN NULL ELSE i * 3 % 8 END AS l_suppkey FROM range(400) t(i)",
    }.items():
        con.execute(f"CREATE VIEW {name} AS {rows}")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path), con


def test_adjacency_of_odd_keys_is_that_of_the_sql_and_of_labelled_lives(spark, odd):
    path, con = odd
    want = sorted(con.execute(queries.SQL["adjacency_symmetric"]).fetchall())
    assert len(set(want)) < len(want) and {r[6] for r in want} != {lifetimes.FOREVER} and {r[5] for r in want} != {0}
    vertices = tables.trade_vertices(spark, path)
    plain = lifetimes.adjacency(lifetimes.label_edges(tables.trade_lives(spark, path), vertices))
    for adj in (plain, tables.trade_adjacency(spark, path, vertices), queries.adj(spark, path)):
        assert sorted(tuple(r) for r in adj.select(*COLUMNS.split(", ")).collect()) == want


def dealt(df):
    """Rows that the exchanges of ``df`` wrote, once for those that are used again; collects it."""
    df.collect()
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "Exchange":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name != "ReusedExchange":
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_a_line_is_dealt_four_times_on_its_way_into_the_graph(spark, tmp_path):
    n, con = 4000, duckdb.connect()
    for name, rows in {
        "nation": "SELECT i::INT AS n_nationkey FROM range(5) t(i)",
        "customer": "SELECT i AS c_custkey, (i % 5)::INT AS c_nationkey, 'S' || i % 3 AS c_mktsegment FROM range(200) t(i)",
        "supplier": "SELECT i AS s_suppkey, (i % 5)::INT AS s_nationkey FROM range(20) t(i)",
        "part": "SELECT i AS p_partkey FROM range(200) t(i)",
        "orders": "SELECT i AS o_orderkey, i AS o_custkey FROM range(200) t(i)",
        "lineitem": f"SELECT i // 20 AS l_orderkey, (i % 20)::INT AS l_linenumber, i % 200 AS l_partkey, i // 200 AS l_suppkey FROM range({n}) t(i)",
    }.items():
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert dealt(tables.trade_adjacency(spark, str(tmp_path), queries.vertices(spark, str(tmp_path)))) <= 5 * n  # as an edge by both ends once more: 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_storing_the_graph_leaves_no_shuffle_files(spark, odd):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(blocks.getAllFiles().mkString("\n").split("\n"))
    shuffles = lambda: {x for x in files() if "/shuffle_" in x}
    was, before = spark.conf.get(FILE_CLEANUP, None), shuffles()
    queries.adj(spark, odd[0])
    end = time.time() + 5  # they go in the background
    while (left := shuffles() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(FILE_CLEANUP, None) == was
