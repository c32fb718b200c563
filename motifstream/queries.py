"""One query for each operator over the trade graph and the event stream, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifstream.functions import sampling
from motifstream.functions.timing import trimmed_mean
from motifstream.operators import counting, delta, index, lifetimes, multi, sjtree, stats
from motifstream.operators import match as m
from motifstream.operators.storage import cut, exists, put, shared_path, shuffles_released
from motifstream.plans import planner
from motifstream.plans.query import QueryGraph
from motifstream.session import CsmSession
from motifstream.sources import tables, text
from motifstream.sources.text import decode_signed_updates
from motifstream.streaming.driver import UPDATES, ContinuousMatcher

C = tables.CUSTOMERS
CYCLE = QueryGraph.of((C, 10, 20, 30), [(0, 1, 0), (1, 2, 1), (0, 3, 2), (2, 3, 3)])
TREE = QueryGraph.of((C, 10, 20), [(0, 1, 0), (1, 2, 1)])
EQUAL = QueryGraph.of((C, 10, C, 30), [(0, 1, 0), (2, 1, 0), (0, 3, 2), (2, 3, 2)])
TWO = QueryGraph.of((C, 10, 20, 20, 30), [(0, 1, 0), (1, 2, 1), (1, 3, 1), (2, 4, 3), (3, 4, 3), (0, 4, 2)])
PAIR = QueryGraph.of((C, 10, 10), [(0, 1, 0), (0, 2, 0)])
STAR = QueryGraph.of((0, 10, 10, 10), [(0, 1, 0), (0, 2, 0), (0, 3, 0)])
SELECTIVE = QueryGraph.of((0, 10, 20, 30), [(0, 1, 0), (1, 2, 1), (0, 3, 2), (2, 3, 3)])
MANY = {"cycle": CYCLE, "tree": TREE, "selective": SELECTIVE}
AFTER, UPTO = 100, 3000  # the range of updates of the query whose feature is a range
CAP = 2


SIX = QueryGraph.of((4, 5, 1, 3, 2, 2), [(0, 2, 0), (0, 4, 0), (2, 4, 0), (2, 3, 0), (0, 1, 0), (3, 5, 0)])
_STORED: dict[tuple[str, str, str], str] = {}  # (application, tables, what) -> path


def _stored(spark: SparkSession, sf_dir: str, what: str, make, write, read) -> DataFrame:
    """A graph is stored once for all queries of an application, as a database loads it before it is asked."""
    key = spark.sparkContext.applicationId, sf_dir, what
    if key not in _STORED or not exists(spark, _STORED[key]):
        path = shared_path(spark, what)
        with shuffles_released(spark):
            write(make(), path)
        _STORED[key] = path
    return read(_STORED[key])


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "id long, label int"
    return _stored(spark, sf_dir, "vertices", lambda: tables.trade_vertices(spark, sf_dir), lambda df, path: df.write.parquet(path), lambda path: spark.read.schema(schema).parquet(path))


def adj(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda: tables.trade_adjacency(spark, sf_dir, vertices(spark, sf_dir))
    return _stored(spark, sf_dir, "adjacency", make, lifetimes.store_adjacency, lambda path: lifetimes.read_adjacency(spark, path))


def _found(q: QueryGraph, **options):
    return lambda spark, sf: m.matches(q, adj(spark, sf), **options)


def _initial(q: QueryGraph, **options):
    return lambda spark, sf: m.initial_count(_found(q, **options)(spark, sf))


def _strategy(q: QueryGraph, strategy: str, order=None):
    return lambda spark, sf: m.summary(CsmSession(spark).plan(q, adj(spark, sf), vertices(spark, sf), strategy=strategy, order=order))


# ---- SQL ----

_HUGE = lifetimes.FOREVER
_TRADE = f"""bounds AS (SELECT max(l_orderkey * 10 + l_linenumber) AS mx, max(l_orderkey * 10 + l_linenumber) * 9 // 10 AS cut FROM lineitem),
    buys AS (SELECT (o_custkey + {tables.CUSTOMER})::BIGINT AS src, (l_partkey + {tables.PART})::BIGINT AS dst, min(l_orderkey * 10 + l_linenumber)::BIGINT AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    vertices AS (SELECT (c_custkey + {tables.CUSTOMER})::BIGINT AS id, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS label FROM customer
        UNION ALL SELECT (p_partkey + {tables.PART})::BIGINT, 10 FROM part UNION ALL SELECT (s_suppkey + {tables.SUPPLIER})::BIGINT, 20 FROM supplier UNION ALL SELECT (n_nationkey + {tables.NATION})::BIGINT, 30 FROM nation),
    edges AS (SELECT src, dst, 0 AS elabel, (CASE WHEN ord > cut THEN ord - cut ELSE 0 END)::BIGINT AS start_seq, (CASE WHEN ord <= cut AND ord % 200 = 1 THEN ord + mx - cut ELSE {_HUGE} END)::BIGINT AS end_seq FROM buys, bounds
        UNION ALL SELECT DISTINCT (l_partkey + {tables.PART})::BIGINT, (l_suppkey + {tables.SUPPLIER})::BIGINT, 1, 0::BIGINT, {_HUGE}::BIGINT FROM lineitem
        UNION ALL SELECT (c_custkey + {tables.CUSTOMER})::BIGINT, (c_nationkey + {tables.NATION})::BIGINT, 2, 0::BIGINT, {_HUGE}::BIGINT FROM customer
        UNION ALL SELECT (s_suppkey + {tables.SUPPLIER})::BIGINT, (s_nationkey + {tables.NATION})::BIGINT, 3, 0::BIGINT, {_HUGE}::BIGINT FROM supplier),
    labelled AS (SELECT e.*, a.label AS src_label, b.label AS dst_label FROM edges e JOIN vertices a ON a.id = e.src JOIN vertices b ON b.id = e.dst),
    adj AS (SELECT src, dst, elabel, src_label, dst_label, start_seq, end_seq FROM labelled UNION ALL SELECT dst, src, elabel, dst_label, src_label, start_seq, end_seq FROM labelled)"""


def _labels(q: QueryGraph, u: int, col: str) -> str:
    s = q.label_set(u)
    return "true" if s is None else f"{col} IN ({', '.join(map(str, sorted(s)))})"


def match_cte(q: QueryGraph, homo: bool = False) -> str:
    """Explicit self-join of all query edges: u0 .., s0 .., st, en."""
    names, tests, tables_ = {}, [], []
    for i, (u, v, c) in enumerate(q.edges):
        tables_.append(f"adj e{i}")
        tests += [f"e{i}.elabel = {c}", _labels(q, u, f"e{i}.src_label"), _labels(q, v, f"e{i}.dst_label")]
        for x, side in ((u, "src"), (v, "dst")):
            if x in names:
                tests.append(f"{names[x]} = e{i}.{side}")
            else:
                names[x] = f"e{i}.{side}"
    if not homo:
        tests += [f"{names[a]} <> {names[b]}" for a in range(q.size) for b in range(a)]
    n = range(len(q.edges))
    starts, ends = ", ".join(f"e{i}.start_seq" for i in n), ", ".join(f"e{i}.end_seq" for i in n)
    cols = ", ".join([f"{names[u]} AS u{u}" for u in range(q.size)] + [f"e{i}.start_seq AS s{i}" for i in n])
    return f"SELECT {cols}, greatest({starts}) AS st, least({ends}) AS en FROM {', '.join(tables_)} WHERE {' AND '.join(tests)} AND greatest({starts}) < least({ends})"


def _with(sql: str, q: QueryGraph | None = None, homo: bool = False, more: str = "") -> str:
    found = f", found AS ({match_cte(q, homo)})" if q else ""
    return f"WITH {_TRADE}{found}{more and ', '}{more} {sql}"


_SUMMARY = f"SELECT count(*) FILTER (st = 0) AS initial, count(*) FILTER (st > 0) AS positives, count(*) FILTER (en < {_HUGE}) AS negatives FROM found"
_DELTAS = f"SELECT seq, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM (SELECT st AS seq, 1 AS p, 0 AS n FROM found WHERE st > 0 UNION ALL SELECT en, 0, 1 FROM found WHERE en < {_HUGE}) GROUP BY seq"
_INITIAL = "SELECT count(*) AS initial FROM found WHERE st = 0"
_EVENTS = f"""changes AS (SELECT start_seq AS seq, src, dst, elabel, least(src_label, dst_label) AS lo, greatest(src_label, dst_label) AS hi, true AS is_add FROM adj WHERE start_seq > 0 AND src < dst
    UNION ALL SELECT end_seq, src, dst, elabel, least(src_label, dst_label), greatest(src_label, dst_label), false FROM adj WHERE end_seq < {_HUGE} AND src < dst)"""
_UPDATES = f"""updates AS (SELECT (event_id + 1)::BIGINT AS seq, CASE WHEN event_id % 97 = 0 THEN 'v' ELSE 'e' END AS kind, event_id % 97 <> 0 AND event_id % 3 <> 0 AS is_add, user_id::BIGINT AS id1, event_type, (event_id % 2)::INT AS label FROM events)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# ---- scans, mutation, lookups ----

_add("scan_vertices", tables.trade_vertices, _with("SELECT id, label FROM vertices"))
_add("scan_edges", lambda spark, sf: tables.trade_edges(spark, sf).select("src", "dst", "elabel"), _with("SELECT src, dst, elabel FROM edges"))
_add("adjacency_symmetric", adj, _with("SELECT src, dst, elabel, src_label, dst_label, start_seq, end_seq FROM adj"))


# ---- text formats: written and read again ----


def _text_graph(spark, sf):
    path = shared_path(spark, "graph-text")
    text.write_graph(vertices(spark, sf), tables.trade_edges(spark, sf), path)
    return text.read_graph(spark, path)


def _text_updates(spark, updates, lines, read):
    path = shared_path(spark, "stream-text")
    text.write_lines(lines(updates), path)
    return read(spark, path)


def _user_updates(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select((F.col("event_id") + 1).cast("long").alias("seq"), F.lit("v").alias("kind"), (F.col("event_id") % 3 != 0).alias("is_add"), F.col("user_id").cast("long").alias("id1"), F.lit(None).cast("long").alias("id2"), (F.col("event_id") % 5).cast("int").alias("label"))


def _timed(spark, sf):
    path = shared_path(spark, "timed-text")
    text.timed_edge_lines(adj(spark, sf).filter("src < dst").withColumn("ts", F.col("start_seq"))).write.text(path)
    return text.read_timed_edges(spark, path)


def _folder(spark, sf):
    path = shared_path(spark, "queries")
    for name, q in (("selective", SELECTIVE), ("star", STAR), ("six", SIX)):
        put(spark, f"{path}/{name}", q.to_text())
    rows = [(name, u, v, c, q.labels[u], q.labels[v]) for name, q in text.read_queries(spark, path).items() for u, v, c in q.edges]
    return spark.createDataFrame(rows, "name string, u int, w int, elabel int, u_label int, w_label int")


_add("text_graph_vertices", lambda s, d: _text_graph(s, d)[0], _with("SELECT id, label FROM vertices"))
_add("text_graph_edges", lambda s, d: _text_graph(s, d)[1], _with("SELECT src, dst, elabel FROM edges"))
_add("text_update_scan", lambda s, d: _text_updates(s, tables.trade_stream(s, d)[1], text.update_lines, text.read_updates),
     _with("SELECT row_number() OVER (ORDER BY seq, src, dst) AS seq, 'e' AS kind, is_add, src AS id1, dst AS id2, CASE WHEN is_add THEN elabel END AS label FROM changes", more=_EVENTS))
_add("text_vertex_update_scan", lambda s, d: _text_updates(s, _user_updates(s, d), text.update_lines, text.read_updates),
     "SELECT row_number() OVER (ORDER BY event_id) AS seq, 'v' AS kind, event_id % 3 <> 0 AS is_add, user_id::BIGINT AS id1, NULL::BIGINT AS id2, (event_id % 5)::INT AS label FROM events")
_add("signed_stream_scan", lambda s, d: _text_updates(s, tables.trade_stream(s, d)[1], text.encode_signed_updates, text.read_signed_updates),
     _with("SELECT row_number() OVER (ORDER BY seq, src, dst) AS seq, 'e' AS kind, is_add, src AS id1, dst AS id2, 0 AS label FROM changes", more=_EVENTS))
_add("timed_edges_scan", _timed, _with("SELECT src, dst, elabel, src_label, dst_label, start_seq AS ts FROM adj WHERE src < dst"))
_add("label_restricted_scan", lambda s, d: text.restrict_to_labels(vertices(s, d), tables.trade_edges(s, d).select("src", "dst", "elabel"), TREE)[1], _with("SELECT src, dst, elabel FROM labelled WHERE src_label IN (0, 1, 2, 3, 4, 10, 20) AND dst_label IN (0, 1, 2, 3, 4, 10, 20)"))
_add("query_folder_scan", _folder, "SELECT * FROM (VALUES " + ", ".join(f"('{name}', {u}, {v}, {c}, {q.labels[u]}, {q.labels[v]})" for name, q in (("selective", SELECTIVE), ("star", STAR), ("six", SIX)) for u, v, c in q.edges) + ") t(name, u, w, elabel, u_label, w_label)")


def _random(spark, sf):
    v, e = sampling.random_graph(spark, 1000, 5000, 3, 2, seed=1)
    one = e.agg((F.count("*") > 4500).alias("many_edges"), F.count_if(F.expr("src >= dst")).alias("loops"), (F.count("*") - F.count_distinct("src", "dst")).alias("repeated"), F.count_distinct("elabel").alias("edge_labels"))
    return one.crossJoin(v.agg(F.count("*").alias("vertices"), F.count_distinct("label").alias("vertex_labels")))


def _sparse(spark, sf):
    e = sampling.erdos_renyi(spark, 3000, 0.01, seed=1, block_edges=1000)
    return e.agg(F.count("*").between(44000, 46000).alias("as_many_as_expected"), F.count_if(F.expr("src >= dst or src < 0 or dst >= 3000")).alias("outside"), (F.count("*") - F.count_distinct("src", "dst")).alias("repeated"))


def _sampled(spark, sf):
    q = sampling.sample_query(adj(spark, sf), 4, seed=3, kind="tree")
    found = m.initial_count(m.matches(q, adj(spark, sf))).first()["initial"]
    return spark.createDataFrame([(q.size, len(q.edges), q.is_tree(), found > 0)], "size int, edges int, tree boolean, found boolean")


_add("random_graph", _random, "SELECT 1000::BIGINT AS vertices, 3::BIGINT AS vertex_labels, true AS many_edges, 0::BIGINT AS loops, 0::BIGINT AS repeated, 2::BIGINT AS edge_labels")
_add("erdos_renyi_graph", _sparse, "SELECT true AS as_many_as_expected, 0::BIGINT AS outside, 0::BIGINT AS repeated")
_add("sampled_query", _sampled, "SELECT 4 AS size, 3 AS edges, true AS tree, true AS found")


def _stream_lives(spark, sf):
    return lifetimes.edge_lifetimes(*tables.trade_stream(spark, sf))


_add("edge_lifetimes", _stream_lives, _with("SELECT src, dst, elabel, start_seq, end_seq FROM edges"))


def _no_edges(spark):
    return spark.sql("SELECT CAST(id AS BIGINT) AS src, CAST(id AS BIGINT) AS dst, 0 AS elabel FROM range(0)")


def _event_lives(spark, sf, cascade=True):
    updates = tables.event_updates(spark, sf)
    types = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("other"), (F.lit(tables.EVENT_TYPE) + F.crc32(F.col("event_type").cast("binary")) % 1000).cast("long").alias("dst")).distinct()
    return lifetimes.edge_lifetimes(_no_edges(spark), updates, cascade).join(types, "dst").select("src", "other", "elabel", "start_seq", "end_seq")


_OPS = "ops AS (SELECT id1 AS src, event_type AS other, seq, is_add, label FROM updates WHERE kind = 'e'"
_GONE = " UNION ALL SELECT p.src, p.other, u.seq, false, NULL FROM (SELECT DISTINCT id1 AS src, event_type AS other FROM updates WHERE kind = 'e' AND is_add) p JOIN updates u ON u.kind = 'v' AND NOT u.is_add AND u.id1 = p.src"
_KEPT = f"""marked AS (SELECT *, coalesce(lag(is_add) OVER (PARTITION BY src, other ORDER BY seq), false) AS was FROM ops), real AS (SELECT *, coalesce(lead(seq) OVER (PARTITION BY src, other ORDER BY seq), {_HUGE})::BIGINT AS end_seq FROM marked WHERE is_add <> was)"""
_add("vertex_delete_cascade", _event_lives, f"WITH {_UPDATES}, {_OPS}{_GONE}), {_KEPT} SELECT src, other, label AS elabel, seq AS start_seq, end_seq FROM real WHERE is_add")
_add("vertex_delete_plain", lambda spark, sf: _event_lives(spark, sf, False), f"WITH {_UPDATES}, {_OPS}), {_KEPT} SELECT src, other, label AS elabel, seq AS start_seq, end_seq FROM real WHERE is_add")
_add("duplicate_insert_noop", lambda spark, sf: lifetimes.ignored_updates(_no_edges(spark), tables.event_updates(spark, sf)),
     f"WITH {_UPDATES}, {_OPS}{_GONE}), {_KEPT} SELECT DISTINCT seq FROM marked WHERE is_add = was AND seq IN (SELECT seq FROM updates WHERE kind = 'e')")


def _vertex_ops(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    ops = e.select((F.col("event_id") + 1).cast("long").alias("seq"), F.lit("v").alias("kind"), (F.col("event_id") % 3 != 0).alias("is_add"), F.col("user_id").cast("long").alias("id1"), F.lit(None).cast("long").alias("id2"), (F.col("event_id") % 5).cast("int").alias("label"))
    return lifetimes.vertex_lifetimes(spark.sql("SELECT CAST(id AS BIGINT) AS id, 0 AS label FROM range(0)"), ops)


_add("vertex_lifetimes", _vertex_ops, f"""WITH o AS (SELECT user_id::BIGINT AS id, (event_id + 1)::BIGINT AS seq, event_id % 3 <> 0 AS is_add, (event_id % 5)::INT AS label FROM events),
    w AS (SELECT *, coalesce(lag(is_add) OVER (PARTITION BY id ORDER BY seq), false) AS was FROM o), k AS (SELECT *, coalesce(lead(seq) OVER (PARTITION BY id ORDER BY seq), {_HUGE})::BIGINT AS end_seq FROM w WHERE is_add <> was)
    SELECT id, label, seq AS start_seq, end_seq FROM k WHERE is_add""")
_add("degree", lambda s, d: stats.degree(adj(s, d)), _with("SELECT src AS id, count(*) AS degree FROM adj GROUP BY 1"))
_add("neighbor_label_freq", lambda s, d: stats.neighbour_label_freq(adj(s, d)), _with("SELECT src AS id, dst_label AS label, count(*) AS n FROM adj GROUP BY 1, 2"))
_add("edge_label_freq", lambda s, d: stats.edge_label_freq(adj(s, d)), _with("SELECT src AS id, elabel, count(*) AS n FROM adj GROUP BY 1, 2"))
_add("label_triple_freq", lambda s, d: stats.triple_freq(adj(s, d)), _with("SELECT src_label, dst_label, elabel, count(*) AS n FROM adj GROUP BY 1, 2, 3"))
_add("vertex_label_freq", lambda s, d: stats.vertex_label_freq(vertices(s, d)), _with("SELECT label, count(*) AS n FROM vertices GROUP BY 1"))
_add("get_edge_label", lambda s, d: adj(s, d).filter((F.col("src_label") == 20) & (F.col("dst_label") == 30)).select("src", "dst", "elabel"), _with("SELECT src, dst, elabel FROM adj WHERE src_label = 20 AND dst_label = 30"))



def _pairs(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_suppkey") + tables.SUPPLIER).cast("long").alias("src"), "s_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    return s.select("src", ((F.col("s_nationkey") + F.col("step")) % 25 + tables.NATION).cast("long").alias("dst"))


_add("get_edge_label_of_pairs", lambda s, d: stats.edge_labels_of(_pairs(s, d), adj(s, d)),
     _with(f"SELECT (s_suppkey + {tables.SUPPLIER})::BIGINT AS src, ((s_nationkey + step) % 25 + {tables.NATION})::BIGINT AS dst, CASE WHEN step = 0 THEN 3 END AS elabel FROM supplier, (VALUES (0), (1)) v(step)"))

# ---- matching ----

for _name, _q in (("cycle", CYCLE), ("tree", TREE), ("equal_labels", EQUAL), ("two_suppliers", TWO)):
    _add(f"initial_match_{_name}", _initial(_q), _with(_INITIAL, _q))
_add("isomorphism_count", _initial(TWO), _with(_INITIAL, TWO))
_add("homomorphism_count", _initial(TWO, homo=True), _with(_INITIAL, TWO, True))
_add("delta_summary", lambda s, d: m.summary(_found(CYCLE)(s, d)), _with(_SUMMARY, CYCLE))
_add("update_deltas", lambda s, d: m.deltas(_found(CYCLE)(s, d)), _with(_DELTAS, CYCLE))
_add("positive_deltas", lambda s, d: m.deltas(_found(CYCLE)(s, d)).filter("positives > 0").select("seq", "positives"), _with("SELECT st AS seq, count(*) AS positives FROM found WHERE st > 0 GROUP BY 1", CYCLE))
_add("negative_deltas", lambda s, d: m.deltas(_found(CYCLE)(s, d)).filter("negatives > 0").select("seq", "negatives"), _with(f"SELECT en AS seq, count(*) AS negatives FROM found WHERE en < {_HUGE} GROUP BY 1", CYCLE))
_add("anchored_delta_batch", lambda s, d: delta.anchored_deltas(CYCLE, adj(s, d), AFTER, UPTO), _with(f"SELECT * FROM ({_DELTAS}) WHERE seq > {AFTER} AND seq <= {UPTO}", CYCLE))


def _whole(run):
    """``run(adj, after, upto)`` over all updates: after 0 up to the last one."""

    def over(spark, sf):
        a = adj(spark, sf)
        last = delta.update_events(a).agg(F.max("seq").alias("m")).first()["m"] or 0
        return run(a, 0, last)

    return over


_count = lambda found: found.groupBy("seq").agg(F.count("*").alias("positives"))
_add("anchored_delta_whole", _whole(lambda a, after, upto: delta.anchored_deltas(CYCLE, a, after, upto)), _with(_DELTAS, CYCLE))
_add("homo_once_delta", _whole(lambda a, after, upto: _count(delta.anchored(EQUAL, a, after, upto, homo=True))), _with("SELECT st AS seq, count(*) AS positives FROM found WHERE st > 0 GROUP BY 1", EQUAL, True))
_add("homo_multiplicity_delta", _whole(lambda a, after, upto: _count(delta.anchored(EQUAL, a, after, upto, homo=True, homo_multiplicity=True))),
     _with(f"SELECT st AS seq, sum({' + '.join(f'(s{i} = st)::INT' for i in range(4))})::BIGINT AS positives FROM found WHERE st > 0 GROUP BY 1", EQUAL, True))
_add("max_results_cap", lambda s, d: m.cap(m.deltas(_found(CYCLE)(s, d)), CAP), _with(f"SELECT seq, least(positives, {CAP}) AS positives, least(negatives, {CAP}) AS negatives FROM ({_DELTAS})", CYCLE))


def _enumerated(spark, sf):
    return m.enumerate_matches(_found(SELECTIVE)(spark, sf), SELECTIVE.size, CAP).select("seq", "sign", F.array_join("mapping", ",").alias("mapping"))


_ROWS = f"(SELECT st AS seq, CASE WHEN st > 0 THEN 1 ELSE 0 END AS sign, [u0, u1, u2, u3] AS mapping FROM found UNION ALL SELECT en, -1, [u0, u1, u2, u3] FROM found WHERE en < {_HUGE})"
_add("enumerate_capped", _enumerated, _with(f"SELECT seq, sign, array_to_string(mapping, ',') AS mapping FROM {_ROWS} QUALIFY row_number() OVER (PARTITION BY seq, sign ORDER BY mapping) <= {CAP}", SELECTIVE))
_add("enumerate_matches", lambda s, d: m.enumerate_matches(_found(SELECTIVE)(s, d), SELECTIVE.size).select("seq", "sign", F.array_join("mapping", ",").alias("mapping")), _with(f"SELECT seq, sign, array_to_string(mapping, ',') AS mapping FROM {_ROWS}", SELECTIVE))
_add("time_constrained", lambda s, d: m.precedes(EQUAL, adj(s, d), [(0, 1)]).filter("st > 0").groupBy(F.col("st").alias("seq")).agg(F.count("*").alias("positives")), _with("SELECT st AS seq, count(*) AS positives FROM found WHERE s0 < s1 AND st > 0 GROUP BY 1", EQUAL))
for _name in ("symbi", "turboflux", "newsp", "calig", "sj-tree"):
    _add(f"strategy_{_name.replace('-', '_')}", _strategy(SELECTIVE, _name), _with(_SUMMARY, SELECTIVE))
_add("strategy_iedyn", _strategy(TREE, "iedyn"), _with(_SUMMARY, TREE))
_add("user_order", _strategy(SELECTIVE, "graphflow", [3, 2, 1, 0]), _with(_SUMMARY, SELECTIVE))

# ---- classification ----

_TRIPLES = "VALUES " + ", ".join(map(str, sorted(SELECTIVE.triples())))
_IN = f"(lo, hi, elabel) IN (SELECT (a, b, c) FROM ({_TRIPLES}) t(a, b, c))"
_NAMES = "seq, src, dst, elabel, is_add"
_add("classify_unsafe", lambda s, d: delta.classify(SELECTIVE, adj(s, d)).select(*_NAMES.split(", ")), _with(f"SELECT {_NAMES} FROM changes WHERE {_IN}", more=_EVENTS))
_add("classify_safe", lambda s, d: delta.classify(SELECTIVE, adj(s, d), False).select(*_NAMES.split(", ")), _with(f"SELECT {_NAMES} FROM changes WHERE NOT {_IN}", more=_EVENTS))
_add("effective_updates", lambda s, d: m.deltas(_found(SELECTIVE)(s, d)).select("seq"), _with(f"SELECT DISTINCT seq FROM ({_DELTAS})", SELECTIVE))
_add("update_kinds", lambda s, d: delta.update_events(adj(s, d)).groupBy("is_add").agg(F.count("*").alias("n")), _with(f"SELECT is_add, count(*) AS n FROM changes GROUP BY 1", more=_EVENTS))

# ---- indexes ----

_ORDER, _DAG = planner.bfs_dag(CYCLE, 3)


def _dcs_sql(table: str = "adj") -> str:
    near = lambda c, other: f"v IN (SELECT a.src FROM {table} a JOIN {other} o ON o.v = a.dst WHERE a.elabel = {c})"
    out = [f"c{u} AS MATERIALIZED (SELECT id AS v FROM vertices WHERE {_labels(CYCLE, u, 'label')})" for u in _ORDER]
    out += [f"d1_{u} AS MATERIALIZED (SELECT v FROM c{u} WHERE true" + "".join(f" AND {near(c, f'd1_{a}')}" for a, b, c in _DAG if b == u) + ")" for u in _ORDER]
    out += [f"d2_{u} AS MATERIALIZED (SELECT v FROM d1_{u} WHERE true" + "".join(f" AND {near(c, f'd2_{b}')}" for a, b, c in _DAG if a == u) + ")" for u in reversed(_ORDER)]
    return ", ".join(out)


_all = lambda d: " UNION ALL ".join(f"SELECT {u} AS u, v FROM {d}_{u}" for u in range(CYCLE.size))


def _dcs(spark, sf):
    return index.dcs(CYCLE, adj(spark, sf), vertices(spark, sf), 3, store=True)


_add("dcs_d1", lambda s, d: index.as_rows(_dcs(s, d)[0]), f"WITH {_TRADE}, {_dcs_sql()} {_all('d1')}")
_add("dcs_d2", lambda s, d: index.as_rows(_dcs(s, d)[1]), f"WITH {_TRADE}, {_dcs_sql()} {_all('d2')}")
_add("dcs_index_size", lambda s, d: index.index_size(*_dcs(s, d)), f"WITH {_TRADE}, {_dcs_sql()} SELECT u, count(*) FILTER (d = 1) AS d1, count(*) FILTER (d = 2) AS d2 FROM (SELECT 1 AS d, u FROM ({_all('d1')}) UNION ALL SELECT 2, u FROM ({_all('d2')})) GROUP BY u")


def _candidate_edges(spark, sf):
    a = adj(spark, sf)
    return index.candidate_edges(CYCLE, a, index.dcs(CYCLE, a, vertices(spark, sf), 3, store=True)[1]).groupBy("u", "w").agg(F.count("*").alias("n"))


_add("dcs_candidate_edges", _candidate_edges, f"WITH {_TRADE}, {_dcs_sql()} " + " UNION ALL ".join(f"SELECT {u} AS u, {w} AS w, count(*) AS n FROM adj WHERE elabel = {c} AND src IN (SELECT v FROM d2_{u}) AND dst IN (SELECT v FROM d2_{w})" for u, w, c in CYCLE.edges))
_add("dcs_counters", lambda s, d: index.dcs_counters(CYCLE, adj(s, d), vertices(s, d), *_dcs(s, d), 3),
     f"WITH {_TRADE}, {_dcs_sql()}, n AS (" + " UNION ALL ".join(f"SELECT {u} AS u, src AS v, count(*) AS {n}, 1 AS {k}, 0 AS {n_}, 0 AS {k_} FROM adj WHERE elabel = {c} AND src IN (SELECT v FROM c{u}) AND dst IN (SELECT v FROM {d}_{w}) GROUP BY src" if n == "n1" else
         f"SELECT {u} AS u, src AS v, 0 AS n1, 0 AS np1, count(*) AS n2, 1 AS nc2 FROM adj WHERE elabel = {c} AND src IN (SELECT v FROM c{u}) AND dst IN (SELECT v FROM {d}_{w}) GROUP BY src"
         for a, b, c in _DAG for u, w, d, n, k, n_, k_ in ((b, a, "d1", "n1", "np1", "n2", "nc2"), (a, b, "d2", "n2", "nc2", "n1", "np1"))) + ") SELECT u, v, sum(n1)::BIGINT AS n1, sum(np1)::BIGINT AS np1, sum(n2)::BIGINT AS n2, sum(nc2)::BIGINT AS nc2 FROM n GROUP BY u, v")
_add("dcs_index_report", lambda s, d: index.index_report(CYCLE, adj(s, d), vertices(s, d), *_dcs(s, d)),
     f"WITH {_TRADE}, {_dcs_sql()} " + " UNION ALL ".join([f"SELECT {u} AS u, NULL::INT AS w, (SELECT count(*) FROM c{u}) AS \"all\", (SELECT count(*) FROM d1_{u}) AS d1, (SELECT count(*) FROM d2_{u}) AS d2" for u in range(CYCLE.size)]
         + [f"SELECT {u}, {w}, " + ", ".join(f"(SELECT count(*) FROM adj WHERE elabel = {c} AND src IN (SELECT v FROM {d}{u}) AND dst IN (SELECT v FROM {d}{w}))" for d in ("c", "d1_", "d2_")) for u, w, c in CYCLE.edges]))


def _updated(spark, sf):
    """Adjacency at first, after all insertions, and after all deletions; the inserted and the deleted edges. (Both directions.)"""
    a = adj(spark, sf)
    return a.filter("start_seq = 0"), a, a.filter(F.col("end_seq") == _HUGE), a.filter("start_seq > 0"), a.filter(F.col("end_seq") < _HUGE)


def _flags(d1, d2):
    return index.as_rows(d1).withColumn("flag", F.lit(1)).unionByName(index.as_rows(d2).withColumn("flag", F.lit(2)))


def _dcs_insert(spark, sf):
    first, grown, _, new, _ = _updated(spark, sf)
    v = vertices(spark, sf)
    return index.dcs_update(CYCLE, grown, new, v, 3, *index.dcs(CYCLE, first, v, 3, store=True), insert=True)


def _dcs_delete(spark, sf):
    _, grown, left, _, gone = _updated(spark, sf)
    v = vertices(spark, sf)
    return index.dcs_update(CYCLE, left, gone, v, 3, *index.dcs(CYCLE, grown, v, 3, store=True), insert=False)


def _dcs_vertices(spark, sf):
    """Every seventh customer comes late, with all edges; then every fifth part goes."""
    a, v = adj(spark, sf), vertices(spark, sf)
    late, gone = (F.col("label") < 5) & (F.col("id") % 7 == 0), (F.col("label") == 10) & (F.col("id") % 5 == 0)
    of = lambda test: v.filter(test).select(F.col("id").alias("x"))
    at = lambda df, test, how: df.join(of(test), F.col("src") == F.col("x"), how).join(of(test), F.col("dst") == F.col("x"), how)
    touch = lambda df, test: df.join(of(test), F.col("src") == F.col("x"), "left_semi").unionByName(df.join(of(test), F.col("dst") == F.col("x"), "left_semi"))
    without = at(a, late, "left_anti")
    d1, d2 = index.dcs(CYCLE, without, v.filter(~late), 3, store=True)
    d1, d2 = index.dcs_update(CYCLE, a, touch(a, late), v, 3, d1, d2, insert=True)
    return index.dcs_update(CYCLE, at(a, gone, "left_anti"), touch(a, gone), v.filter(~gone), 3, d1, d2, insert=False)


_all_flags = " UNION ALL ".join(f"SELECT u, v, {k} AS flag FROM ({_all(f'd{k}')})" for k in (1, 2))
_add("dcs_insert", lambda s, d: _flags(*_dcs_insert(s, d)), f"WITH {_TRADE}, {_dcs_sql()} {_all_flags}")
_add("dcs_delete", lambda s, d: _flags(*_dcs_delete(s, d)), f"WITH {_TRADE}, left_over AS (SELECT * FROM adj WHERE end_seq = {_HUGE}), {_dcs_sql('left_over')} {_all_flags}")
_add("dcs_vertex_updates", lambda s, d: _flags(*_dcs_vertices(s, d)), f"WITH {_TRADE}, left_over AS (SELECT * FROM adj WHERE NOT (src_label = 10 AND src % 5 = 0) AND NOT (dst_label = 10 AND dst % 5 = 0)), {_dcs_sql('left_over').replace('(SELECT id AS v FROM vertices WHERE label IN (10))', '(SELECT id AS v FROM vertices WHERE label IN (10) AND id % 5 <> 0)')} {_all_flags}")
_add("nlf_index", lambda s, d: stats.nlf_index(adj(s, d)).select("id", F.array_join(F.transform(F.map_entries("vl"), lambda x: F.concat_ws(":", x["key"], x["value"])), ",").alias("vl"), F.array_join(F.transform(F.map_entries("el"), lambda x: F.concat_ws(":", x["key"], x["value"])), ",").alias("el")),
     _with("SELECT id, vl, el FROM (SELECT id, string_agg(label || ':' || n, ',' ORDER BY label) AS vl FROM (SELECT src AS id, dst_label AS label, count(*) AS n FROM adj GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT id, string_agg(elabel || ':' || n, ',' ORDER BY elabel) AS el FROM (SELECT src AS id, elabel, count(*) AS n FROM adj GROUP BY 1, 2) GROUP BY 1) USING (id)"))


def _cover(q, spark, sf):
    return index.nlf_cover(q, stats.nlf_index(adj(spark, sf)), vertices(spark, sf))


def _cover_sql(q: QueryGraph) -> str:
    parts = []
    for u in range(q.size):
        tests = [_labels(q, u, "v.label")]
        wants: dict = {}
        for w, c in q.neighbours(u).items():
            wants[("elabel", c)] = wants.get(("elabel", c), 0) + 1
            if len(q.label_set(w)) == 1:
                wants[("dst_label", *q.label_set(w))] = wants.get(("dst_label", *q.label_set(w)), 0) + 1
        tests += [f"(SELECT count(*) FROM adj a WHERE a.src = v.id AND a.{col} = {x}) >= {n}" for (col, x), n in wants.items()]
        parts.append(f"SELECT {u} AS u, id AS v FROM vertices v WHERE {' AND '.join(tests)}")
    return " UNION ALL ".join(parts)


_add("nlf_cover_candidates", lambda s, d: _cover(TWO, s, d), f"WITH {_TRADE} {_cover_sql(TWO)}")


def _nlf_unsafe(spark, sf):
    a = adj(spark, sf)
    return index.candidate_unsafe(SELECTIVE, delta.update_events(a), cut(_cover(SELECTIVE, spark, sf), "cover"))


_add("nlf_safe_detect", _nlf_unsafe, f"WITH {_TRADE}, {_EVENTS}, cover AS ({_cover_sql(SELECTIVE)}), both_ways AS (SELECT seq, elabel, src AS a, dst AS b FROM changes UNION ALL SELECT seq, elabel, dst, src FROM changes) SELECT DISTINCT seq FROM ("
     + " UNION ALL ".join(f"SELECT seq FROM both_ways WHERE elabel = {c} AND a IN (SELECT v FROM cover WHERE u = {u}) AND b IN (SELECT v FROM cover WHERE u = {w})" for u, w, c in SELECTIVE.edges) + ")")


def _signed_changes(spark, sf):
    one = adj(spark, sf).filter("src < dst")
    events = lambda test, add: one.filter(test).select("src", "dst", "src_label", "dst_label", F.lit(add).alias("is_add"))
    return stats.nlf_change(events("start_seq > 0", True).unionByName(events(F.col("end_seq") < _HUGE, False)))


_add("nlf_change", _signed_changes, _with(f"SELECT id, label, sum(n)::BIGINT AS n FROM (SELECT src AS id, dst_label AS label, 1 AS n FROM adj WHERE start_seq > 0 UNION ALL SELECT src, dst_label, -1 FROM adj WHERE end_seq < {_HUGE}) GROUP BY 1, 2"))
_SPREAD = match_cte(TREE, True).split(" AND greatest")[0]
_add("lighting_index", lambda s, d: index.lighting(TREE, adj(s, d), vertices(s, d)), _with(" UNION ALL ".join(f"SELECT {u} AS u, u{u} AS v FROM (SELECT DISTINCT u{u} FROM spread)" for u in range(TREE.size)), more=f"spread AS ({_SPREAD})"))


def _lit_sql(q: QueryGraph, rounds: int = 6, name: str = "lit", start: str | None = None, table: str = "adj") -> str:
    """The fixpoint by as many rounds as the queries here can need, from all pairs of equal labels or from ``start``."""
    col = "label"
    out = [f"{name}0 AS MATERIALIZED ({start or ' UNION ALL '.join(f'SELECT {u} AS u, id AS v FROM vertices WHERE {_labels(q, u, col)}' for u in range(q.size))})"]
    for i in range(rounds):
        near = lambda w, c, i=i: f"v IN (SELECT a.src FROM {table} a JOIN {name}{i} o ON o.v = a.dst AND o.u = {w} WHERE a.elabel = {c})"
        out.append(f"{name}{i + 1} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT u, v FROM {name}{i} WHERE u = {u}' + ''.join(' AND ' + near(w, c) for w, c in q.neighbours(u).items()) for u in range(q.size))})")
    return ", ".join([*out, f"{name} AS (SELECT * FROM {name}{rounds})"])


_add("lighting_cycle", lambda s, d: index.lighting(SELECTIVE, adj(s, d), vertices(s, d)), f"WITH {_TRADE}, {_lit_sql(SELECTIVE)} SELECT u, v FROM lit")


def _sdr(spark, sf):
    a = adj(spark, sf)
    return index.representatives(EQUAL, a, index.lighting(EQUAL, a, vertices(spark, sf))).groupBy("u").agg(F.count("*").alias("n"))


_add("lighting_sdr", _sdr, f"""WITH {_TRADE}, {_lit_sql(EQUAL)}, ends AS (SELECT DISTINCT a.src, a.dst, a.elabel FROM adj a JOIN lit o ON o.v = a.dst AND o.u IN (0, 2))
    SELECT u, count(*) AS n FROM lit WHERE u IN (0, 2) OR v IN (SELECT src FROM ends WHERE elabel = CASE u WHEN 1 THEN 0 ELSE 2 END GROUP BY src HAVING count(DISTINCT dst) > 1) GROUP BY u""")
_TWICE = lambda lit: f"""SELECT u, v FROM {lit} WHERE u IN (0, 2) OR v IN (SELECT a.src FROM adj a JOIN {lit} o ON o.v = a.dst AND o.u IN (0, 2) WHERE a.elabel = CASE {lit}.u WHEN 1 THEN 0 ELSE 2 END GROUP BY a.src HAVING count(DISTINCT a.dst) > 1)"""
_add("lighting_apart", lambda s, d: index.lighting_apart(EQUAL, adj(s, d), vertices(s, d)),
     f"WITH {_TRADE}, {_lit_sql(EQUAL)}, {_lit_sql(EQUAL, 6, 'litb', _TWICE('lit'))}, {_lit_sql(EQUAL, 6, 'litc', _TWICE('litb'))} SELECT u, v FROM litc")


def _turned(spark, sf, on):
    first, grown, left, new, gone = _updated(spark, sf)
    v = vertices(spark, sf)
    lit = index.lighting(SELECTIVE, first, v)
    lit = index.turn_on(SELECTIVE, lit, grown, new, v)
    return lit if on else index.turn_off(SELECTIVE, lit, left, gone)


def _lit_unsafe(spark, sf):
    a = adj(spark, sf)
    return index.candidate_unsafe(SELECTIVE, delta.update_events(a), index.lighting(SELECTIVE, a, vertices(spark, sf)))


_add("lighting_turn_on", lambda s, d: _turned(s, d, True), f"WITH {_TRADE}, {_lit_sql(SELECTIVE, 8)} SELECT u, v FROM lit")
_add("lighting_turn_off", lambda s, d: _turned(s, d, False), f"WITH {_TRADE}, left_over AS (SELECT * FROM adj WHERE end_seq = {_HUGE}), {_lit_sql(SELECTIVE, 8, table='left_over')} SELECT u, v FROM lit")
_add("lit_safe_detect", _lit_unsafe, f"WITH {_TRADE}, {_EVENTS}, {_lit_sql(SELECTIVE, 8)}, both_ways AS (SELECT seq, elabel, src AS a, dst AS b FROM changes UNION ALL SELECT seq, elabel, dst, src FROM changes) SELECT DISTINCT seq FROM ("
     + " UNION ALL ".join(f"SELECT seq FROM both_ways WHERE elabel = {c} AND a IN (SELECT v FROM lit WHERE u = {u}) AND b IN (SELECT v FROM lit WHERE u = {w})" for u, w, c in SELECTIVE.edges) + ")")
_add("explicit_path_counts", lambda s, d: index.explicit_paths(TREE, adj(s, d), index.label_candidates(TREE, vertices(s, d)), [(0, 1, 0), (1, 2, 1)], 0),
     _with("SELECT 0 AS u, count(*)::BIGINT AS paths FROM vertices WHERE label < 5 UNION ALL SELECT 1, count(*)::BIGINT FROM adj WHERE elabel = 0 AND src_label < 5 UNION ALL SELECT 2, count(*)::BIGINT FROM adj a JOIN adj b ON b.src = a.dst WHERE a.elabel = 0 AND a.src_label < 5 AND b.elabel = 1 AND b.src_label = 10"))


def _sj_nodes(spark, sf):
    a = adj(spark, sf)
    freq, _ = stats.query_statistics(SELECTIVE, a, vertices(spark, sf))
    order = list(SELECTIVE.edges)
    assert sorted(planner.sj_tree(SELECTIVE, freq)) == sorted(order)
    nodes = sjtree.partial_matches(SELECTIVE, a, order)
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n")).select(F.lit(i).alias("node"), "n") for i, x in enumerate(nodes)])


def _sj_sql() -> str:
    parts = []
    for i in range(len(SELECTIVE.edges)):
        e = SELECTIVE.edges[: i + 1]
        names = {x: k for k, x in enumerate(dict.fromkeys(x for a, b, _ in e for x in (a, b)))}
        q = QueryGraph.of([SELECTIVE.labels[x] for x in names], [(names[a], names[b], c) for a, b, c in e])
        sql = match_cte(q)
        if i == 0:  # greatest and least of one value
            sql = sql.replace("greatest(e0.start_seq)", "e0.start_seq").replace("least(e0.end_seq)", "e0.end_seq")
        parts.append(f"SELECT {i} AS node, count(*) AS n FROM ({sql})")
    return " UNION ALL ".join(parts)


_add("sj_tree_partial_matches", _sj_nodes, _with(_sj_sql()))


def _sj_append(spark, sf):
    first, grown, _, new, _ = _updated(spark, sf)
    order = list(SELECTIVE.edges)
    nodes = sjtree.partial_matches(SELECTIVE, first, order)
    both = [a.unionByName(b) for a, b in zip(nodes, sjtree.append(SELECTIVE, nodes, grown, new, order))]
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n")).select(F.lit(i).alias("node"), "n") for i, x in enumerate(both)])


_add("sj_tree_append", _sj_append, _with(_sj_sql()))


def _counters(spark, sf):
    a = adj(spark, sf)
    return m.pruning_counters(TWO, a, order=[4, 2, 1, 3, 0], candidates={2: index.label_candidates(TWO, vertices(spark, sf).filter("id % 3 <> 0"))[2]})


_STEPS = """p1 AS (SELECT id AS u4 FROM vertices WHERE label = 30 AND id IN (SELECT src FROM adj)), e1 AS (SELECT p1.*, dst AS u2 FROM p1 JOIN adj ON src = u4 AND elabel = 3 AND dst_label = 20), i1 AS (SELECT * FROM e1 WHERE u2 % 3 <> 0),
    e2 AS (SELECT i1.*, dst AS u1 FROM i1 JOIN adj ON src = u2 AND elabel = 1 AND dst_label = 10), e3 AS (SELECT e2.*, dst AS u3 FROM e2 JOIN adj ON src = u4 AND elabel = 3 AND dst_label = 20),
    j3 AS (SELECT e3.* FROM e3 JOIN adj ON src = u1 AND dst = u3 AND elabel = 1), v3 AS (SELECT * FROM j3 WHERE u3 <> u2), e4 AS (SELECT v3.*, dst AS u0 FROM v3 JOIN adj ON src = u4 AND elabel = 2 AND dst_label < 5),
    j4 AS (SELECT e4.* FROM e4 JOIN adj ON src = u1 AND dst = u0 AND elabel = 0)"""
_n = lambda t: f"(SELECT count(*) FROM {t})"
_add("pruning_counters", _counters, f"""WITH {_TRADE}, {_STEPS} SELECT 1 AS step, 2 AS vertex, {_n('p1')} AS partial, {_n('e1')} AS extended, {_n('i1')} AS indexed, {_n('i1')} AS joinable, {_n('i1')} AS unvisited, {_n('p1 WHERE u4 NOT IN (SELECT u4 FROM i1)')} AS dead_ends
    UNION ALL SELECT 2, 1, {_n('i1')}, {_n('e2')}, {_n('e2')}, {_n('e2')}, {_n('e2')}, {_n('i1 WHERE u2 NOT IN (SELECT u2 FROM e2)')}
    UNION ALL SELECT 3, 3, {_n('e2')}, {_n('e3')}, {_n('e3')}, {_n('j3')}, {_n('v3')}, {_n('e2 WHERE (u2, u1) NOT IN (SELECT (u2, u1) FROM v3)')}
    UNION ALL SELECT 4, 0, {_n('v3')}, {_n('e4')}, {_n('e4')}, {_n('j4')}, {_n('j4')}, {_n('v3 WHERE (u2, u1, u3) NOT IN (SELECT (u2, u1, u3) FROM j4)')}""")
_add("sj_tree_delta", lambda s, d: m.deltas(CsmSession(s).plan(SELECTIVE, adj(s, d), vertices(s, d), strategy="sj-tree")), _with(_DELTAS, SELECTIVE))

# ---- counting without enumeration ----

_now = lambda s, d: lifetimes.snapshot(adj(s, d))
_N = "SELECT count(*) AS n FROM found WHERE st = 0"
_add("shell_count_1", lambda s, d: counting.count_with_shell(CYCLE, _now(s, d), [2]), _with(_N, CYCLE))
_add("shell_count_2", lambda s, d: counting.count_with_shell(PAIR, _now(s, d), [1, 2]), _with(_N, PAIR))
_add("shell_of_two_cores", lambda s, d: counting.count_with_shell(EQUAL, _now(s, d), [2]), _with(_N, EQUAL))
_add("shell_count_3", lambda s, d: counting.count_with_shell(STAR, _now(s, d), [1, 2, 3]), _with(_N, STAR))
_add("isolated_vertex_count", lambda s, d: counting.count_with_shell(TWO, _now(s, d), [2, 3]), _with(_N, TWO))

_add("shell_deltas_calig", lambda s, d: CsmSession(s).count_deltas(TWO, adj(s, d), strategy="calig"), _with(_DELTAS, TWO))
_add("isolated_deltas_newsp", lambda s, d: CsmSession(s).count_deltas(EQUAL, adj(s, d), strategy="newsp"), _with(_DELTAS, EQUAL))
_add("orders_by_edge", lambda s, d: CsmSession(s).count_deltas(SELECTIVE, adj(s, d), orders={0: [1, 0, 2, 3], 2: [3, 0, 2, 1], 3: [2, 3, 1, 0]}), _with(_DELTAS, SELECTIVE))


def _limited(spark, sf):
    found = CsmSession(spark).match(SELECTIVE, vertices(spark, sf), *tables.trade_stream(spark, sf), initial_time_limit=600, time_limit=600).run()
    return spark.createDataFrame([tuple(found.values())], "initial long, positives long, negatives long")


_add("time_limited", _limited, _with(_SUMMARY, SELECTIVE))

# ---- planning, many queries, streams, the rest ----


def _orders(spark, sf):
    named = {"cycle": CYCLE, "tree": TREE, "equal": EQUAL, "two": TWO, "star": STAR, "six": SIX}
    rows = [f"('{n}', '{s}', '{'-'.join(map(str, planner.plan_order(q, s)))}')" for n, q in named.items() for s in planner.STRATEGIES if s != "iedyn" or q.is_tree()]
    rows += [f"('{n}', 'anchor {i}', '{'-'.join(map(str, o))}')" for n, q in named.items() for i, o in enumerate(planner.anchor_orders(q))]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(query, strategy, plan)")


#: The orders that the rules give for these queries, written down; those of "six" by anchor are known ones.
_ORDERS = """
cycle: graphflow 0-1-2-3, sj-tree 0-1-3-2, turboflux 1-0-3-2, symbi 1-0-2-3, newsp 0-1-2-3, calig 0-1-2-3, anchor 0 0-1-2-3, anchor 1 2-1-0-3, anchor 2 3-0-1-2, anchor 3 3-2-0-1
tree: graphflow 1-0-2, sj-tree 0-1-2, turboflux 1-2-0, symbi 1-0-2, iedyn 1-0-2, newsp 0-1-2, calig 0-1-2, anchor 0 1-0-2, anchor 1 2-1-0
equal: graphflow 0-1-2-3, sj-tree 0-1-3-2, turboflux 1-0-3-2, symbi 1-0-2-3, newsp 0-1-2-3, calig 0-1-2-3, anchor 0 0-1-2-3, anchor 1 2-1-0-3, anchor 2 3-0-1-2, anchor 3 3-2-0-1
two: graphflow 1-0-4-2-3, sj-tree 0-1-4-2-3, turboflux 1-0-4-3-2, symbi 1-0-2-3-4, newsp 0-1-4-2-3, calig 0-1-4-2-3, anchor 0 1-0-4-2-3, anchor 1 4-0-1-2-3, anchor 2 2-1-4-0-3, anchor 3 2-4-1-0-3, anchor 4 3-1-4-0-2, anchor 5 3-4-1-0-2
star: graphflow 0-1-2-3, sj-tree 0-1-2-3, turboflux 0-3-2-1, symbi 0-1-2-3, iedyn 0-1-2-3, newsp 1-0-2-3, calig 0-1-2-3, anchor 0 0-1-2-3, anchor 1 2-0-1-3, anchor 2 3-0-1-2
six: graphflow 0-2-4-3-1-5, sj-tree 0-1-2-4-3-5, turboflux 0-2-3-5-4-1, symbi 0-1-2-4-3-5, newsp 0-2-4-3-1-5, calig 0-2-3-1-4-5, anchor 0 0-2-4-3-1-5, anchor 1 4-0-2-3-1-5, anchor 2 4-2-0-3-1-5, anchor 3 3-2-0-4-1-5, anchor 4 1-0-2-4-3-5, anchor 5 5-3-2-0-4-1
"""


def _orders_sql() -> str:
    rows = [(name, *entry.rsplit(" ", 1)) for name, entries in (line.split(": ") for line in _ORDERS.strip().split("\n")) for entry in entries.split(", ")]
    return "SELECT * FROM (VALUES " + ", ".join(map(str, rows)) + ") t(query, strategy, plan)"


_add("planner_orders", _orders, _orders_sql())
_add("multi_query_dispatch", lambda s, d: multi.dispatch(MANY, adj(s, d)).groupBy("qid", "qedge").agg(F.count("*").alias("n")),
     f"WITH {_TRADE}, {_EVENTS}, t AS (SELECT * FROM (VALUES " + ", ".join(f"({min(a, b)}, {max(a, b)}, {c}, '{k}', {i})" for k, q in MANY.items() for i, (u, v, c) in enumerate(q.edges) for a in sorted(q.label_set(u)) for b in sorted(q.label_set(v))) + ") v(lo, hi, elabel, qid, qedge)) SELECT qid, qedge, count(*) AS n FROM changes JOIN t USING (lo, hi, elabel) GROUP BY 1, 2")
_add("multi_query_deltas", lambda s, d: multi.multi_deltas(MANY, adj(s, d)),
     f"WITH {_TRADE} " + " UNION ALL ".join(f"SELECT '{k}' AS qid, seq, positives, negatives FROM ({_DELTAS.replace('FROM found', f'FROM ({match_cte(q)})')})" for k, q in MANY.items()))


def _two_parts(spark, sf):
    v, e = vertices(spark, sf), tables.trade_edges(spark, sf).select("src", "dst", "elabel")
    return stats.induced(v.filter("label in (0, 1, 10)"), e), stats.induced(v.filter("label in (1, 2, 10)"), e)


_part = lambda x: f"SELECT src, dst, elabel FROM labelled WHERE src_label IN {x} AND dst_label IN {x}"
_add("induced_union", lambda s, d: (lambda a, b: a.unionByName(b).distinct())(*_two_parts(s, d)), _with(f"{_part('(0, 1, 10)')} UNION {_part('(1, 2, 10)')}"))
_add("induced_intersection", lambda s, d: (lambda a, b: a.intersect(b))(*_two_parts(s, d)), _with(f"{_part('(0, 1, 10)')} INTERSECT {_part('(1, 2, 10)')}"))


def _diameter(spark, sf):
    e = tables.trade_edges(spark, sf).filter("elabel = 3").select("src", "dst")
    regions = spark.read.parquet(f"{sf}/nation.parquet").select((F.col("n_nationkey") + tables.NATION).alias("src"), (F.col("n_regionkey") + 5_000_000_000).alias("dst"))
    return spark.sql(f"SELECT {stats.diameter(e.unionByName(regions))} AS diameter")


_add("diameter_small", _diameter, f"""WITH RECURSIVE {_TRADE}, small AS (SELECT src, dst FROM edges WHERE elabel = 3 UNION ALL SELECT n_nationkey + {tables.NATION}, n_regionkey + 5000000000 FROM nation),
    two_way AS (SELECT src, dst FROM small UNION SELECT dst, src FROM small), walk(a, b, n) AS (SELECT DISTINCT src, src, 0 FROM two_way UNION SELECT a, dst, n + 1 FROM walk JOIN two_way ON src = b WHERE n < 8),
    shortest AS (SELECT a, b, min(n) AS n FROM walk GROUP BY 1, 2) SELECT max(n) AS diameter FROM shortest""")


def _decoded(spark, sf):
    u = tables.trade_stream(spark, sf)[1]
    signed = lambda c: F.when(F.col("is_add"), F.col(c)).otherwise(-F.col(c) - 1).alias({"id1": "a", "id2": "b"}[c])
    return decode_signed_updates(u.select("seq", signed("id1"), signed("id2"))).select("seq", "is_add", "id1", "id2")


_add("calig_stream_decode", _decoded, _with(f"SELECT seq, is_add, src AS id1, dst AS id2 FROM changes", more=_EVENTS))


def _micro_batches(spark, sf):
    first, updates = tables.trade_stream(spark, sf)
    folder = shared_path(spark, "stream")
    parts = 3
    last = updates.agg(F.max("seq").alias("m")).first()["m"] or 0
    for i in range(parts):
        own = updates.filter((F.col("seq") > last * i // parts) & (F.col("seq") <= last * (i + 1) // parts))
        own.coalesce(1).write.mode("append").json(f"{folder}/in")
    matcher = ContinuousMatcher(spark, SELECTIVE, vertices(spark, sf), folder)
    matcher.start_from(first)
    stream = spark.readStream.schema("seq long, kind string, is_add boolean, id1 long, id2 long, label int").option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    matcher.start(stream).awaitTermination()
    return matcher.deltas()


_add("stream_microbatch_deltas", _micro_batches, _with(_DELTAS, SELECTIVE))


def _late_customers(spark, sf):
    """(vertices at first, edges at first, updates): every third customer is inserted by the stream, and then its nation edge."""
    v, (first, updates) = vertices(spark, sf), tables.trade_stream(spark, sf)
    key = F.col("id") - tables.CUSTOMER
    late = v.filter((F.col("label") < 5) & (key % 3 == 0))
    at = (F.col("id") - tables.CUSTOMER) % 500 * 10
    adds = late.select((at + 9).cast("long").alias("seq"), F.lit("v").alias("kind"), F.lit(True).alias("is_add"), F.col("id").alias("id1"), F.lit(None).cast("long").alias("id2"), "label")
    theirs = (F.col("elabel") == tables.OF_NATION) & ((F.col("src") - tables.CUSTOMER) % 3 == 0)
    nations = first.filter(theirs).select(((F.col("src") - tables.CUSTOMER) % 500 * 10 + 10).cast("long").alias("seq"), F.lit("e").alias("kind"), F.lit(True).alias("is_add"), F.col("src").alias("id1"), F.col("dst").alias("id2"), F.col("elabel").alias("label"))
    return v.join(late, "id", "left_anti"), first.filter(~theirs), updates.unionByName(adds).unionByName(nations)


def _late_batch(spark, sf):
    return CsmSession(spark).match(SELECTIVE, *_late_customers(spark, sf)).deltas


def _late_stream(spark, sf):
    """The stream in three files; after each the matcher stops, and a new one goes on with the same folder."""
    known, first, updates = _late_customers(spark, sf)
    folder = shared_path(spark, "stream")
    updates = cut(updates, "updates")
    last = updates.agg(F.max("seq").alias("m")).first()["m"] or 0
    ContinuousMatcher(spark, SELECTIVE, known, folder).start_from(first)
    for lo, hi in ((0, last // 90), (last // 90, last // 20), (last // 20, last)):
        updates.filter((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1).write.mode("append").json(f"{folder}/in")
        matcher = ContinuousMatcher(spark, SELECTIVE, known, folder)
        matcher.start(spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).json(f"{folder}/in")).awaitTermination()
    return matcher.deltas()


_LATE = f"({{x}} - {tables.CUSTOMER}) % 3 = 0 AND {{x}} < {tables.PART}"
_late_adj = f"""late_edges AS (SELECT src, dst, elabel, src_label, dst_label, CASE WHEN elabel = 2 AND {_LATE.format(x='src')} THEN (src - {tables.CUSTOMER}) % 500 * 10 + 10 ELSE start_seq END AS start_seq, end_seq FROM labelled),
    late_kept AS (SELECT * FROM late_edges WHERE NOT ({_LATE.format(x='src')}) OR start_seq >= (src - {tables.CUSTOMER}) % 500 * 10 + 9),
    late_adj AS (SELECT * FROM late_kept UNION ALL SELECT dst, src, elabel, dst_label, src_label, start_seq, end_seq FROM late_kept)"""
_late_sql = f"WITH {_TRADE}, {_late_adj}, found AS ({match_cte(SELECTIVE).replace('adj e', 'late_adj e')}) {_DELTAS}"
_add("vertex_insert_deltas", _late_batch, _late_sql)
_add("stream_restart_deltas", _late_stream, _late_sql)
_add("trimmed_mean_runtime", lambda s, d: trimmed_mean(s.read.parquet(f"{d}/events.parquet"), "event_type", "value", 100.0).select("event_type", "runs", F.round("success_rate", 6).alias("success_rate"), F.round("trimmed_mean", 4).alias("trimmed_mean")),
     """WITH r AS (SELECT event_type, least(coalesce(value, 100.0), 100.0) AS ms, (value IS NOT NULL AND value < 100.0)::INT AS ok FROM events),
        p AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ms) AS place FROM r)
        SELECT event_type, count(*) AS runs, round(avg(ok), 6) AS success_rate, round(avg(ms) FILTER (place > floor(n * 0.1) AND place <= n - floor(n * 0.1)), 4) AS trimmed_mean FROM p GROUP BY 1""")
