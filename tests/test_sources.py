import pytest

from motifstream.functions import sampling
from motifstream.functions.timing import trimmed_mean
from motifstream.operators import lifetimes
from motifstream.plans.query import QueryGraph
from motifstream.session import CsmSession
from motifstream.sources import text
from motifstream.streaming.driver import UPDATES, ContinuousMatcher

TOY = "t # 1\nv 0 0\nv 1 0\ne 0 1 0\nv 2 1\ne 0 2 1\ne 2 1 2\n"


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "g").write_text(TOY)
    v, e = text.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, v.collect())) == [(0, 0), (1, 0), (2, 1)] and sorted(map(tuple, e.collect())) == [(0, 1, 0), (0, 2, 1), (2, 1, 2)]
    text.write_graph(v, e, str(tmp_path / "out"))
    again = text.read_graph(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, e.collect()))
    (tmp_path / "u").write_text("v 3 1\ne 2 3 2\n-v 2 1\n-e 0 1 0\n")
    u = text.read_updates(spark, str(tmp_path / "u"))
    assert [tuple(r) for r in u.orderBy("seq").collect()] == [(1, "v", True, 3, None, 1), (2, "e", True, 2, 3, 2), (3, "v", False, 2, None, 1), (4, "e", False, 0, 1, 0)]
    q = QueryGraph.parse(TOY)
    s = CsmSession(spark).match(q, v, e, u).summary.first()
    assert (s["initial"], s["positives"], s["negatives"]) == (1, 0, 1)
    kept, inside = text.restrict_to_labels(v, e, QueryGraph.of((0, 0), [(0, 1)]))
    assert kept.count() == 2 and inside.count() == 1


def test_query_folder_and_signed_stream(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q/Q_1").write_text(TOY)
    (tmp_path / "q/Q_2").write_text("v 0 1\nv 1 2\ne 0 1\n")
    assert sorted(text.read_queries(spark, str(tmp_path / "q"))) == ["Q_1", "Q_2"]
    (tmp_path / "s").write_text("e 1 2\ne -2 -3\ne 4 5\n")
    got = text.read_signed_updates(spark, str(tmp_path / "s"), first=2).orderBy("seq").collect()
    assert [(r["is_add"], r["id1"], r["id2"]) for r in got] == [(True, 1, 2), (False, 1, 2)]


def _stream(spark, tmp_path, q, v, e, batches, restart=(), **options):
    """Deltas of a stream whose files come one after the other; a new matcher goes on after the batches of ``restart``."""
    m = ContinuousMatcher(spark, q, v, str(tmp_path / "state"), **options)
    m.start_from(e)
    for i, ops in enumerate(batches):
        spark.createDataFrame(ops, UPDATES).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if i in restart or i == len(batches) - 1:
            m.start(spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))).awaitTermination()
            m = ContinuousMatcher(spark, q, v, str(tmp_path / "state"), **options)
    return m, sorted(map(tuple, m.deltas().collect()))


OPS = [(1, "e", True, 2, 3, 0), (2, "e", True, 3, 4, 0), (3, "e", False, 1, 2, 0), (4, "e", True, 1, 2, 0), (5, "v", False, 3, None, 0), (6, "e", True, 4, 5, 0), (7, "e", True, 4, 5, 0),
       (8, "v", True, 9, None, 1), (9, "e", True, 2, 9, 0), (10, "e", True, 4, 9, 0), (11, "e", True, 2, 8, 0), (12, "v", True, 8, None, 1), (13, "e", True, 4, 8, 0), (14, "v", False, 9, None, 1),
       (15, "v", True, 3, None, 1), (16, "e", True, 3, 4, 0), (17, "e", False, 2, 8, 0), (18, "e", True, 2, 8, 0), (19, "e", True, 2, 3, 1)]


@pytest.mark.parametrize("size,restart,compact", [(4, (0, 1, 3), 2), (7, (), 16), (5, (), 1)])
def test_streaming_equals_batch_also_after_restarts(spark, tmp_path, size, restart, compact):
    v = spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, label int")
    e = spark.createDataFrame([(0, 1, 0), (1, 2, 0)], "src long, dst long, elabel int")
    q = QueryGraph.of((0, 1, 0), [(0, 1, 0), (1, 2, 0)])
    want = sorted(map(tuple, CsmSession(spark).match(q, v, e, spark.createDataFrame(OPS, UPDATES)).deltas.collect()))
    assert {s for s, _, _ in want} >= {2, 3, 4, 5, 10, 14, 18} and len(want) > 6
    m, got = _stream(spark, tmp_path, q, v, e, [OPS[i : i + size] for i in range(0, len(OPS), size)], restart, compact_every=compact)
    assert got == want
    assert len(m.done()) <= 2 * compact + 1
    # a batch that is run again changes nothing, an update that was done is late
    last = m.done()[-1][0]
    m.process(spark.createDataFrame(OPS[last * size : (last + 1) * size], UPDATES), last)
    assert sorted(map(tuple, m.deltas().collect())) == want
    with pytest.raises(ValueError, match="late"):
        m.process(spark.createDataFrame(OPS[:1], UPDATES), last + 1)
    with pytest.raises(ValueError, match="started"):
        m.start_from(e)


def test_batches_write_what_they_touch(spark, tmp_path):
    v = spark.createDataFrame([(i, 0) for i in range(500)], "id long, label int")
    e = spark.createDataFrame([(i, i + 1, 0) for i in range(499)], "src long, dst long, elabel int")
    q = QueryGraph.of((0, 0, 0), [(0, 1, 0), (1, 2, 0)])
    m, got = _stream(spark, tmp_path, q, v, e, [[(1, "e", True, 0, 5, 0)], [(2, "e", False, 0, 5, 0)]])
    assert got == [(1, 6, 0), (2, 0, 6)]
    assert [m._read("edges", b, False).count() for b in (0, 1)] == [1, 1] and m._read("vertices", 0, False).count() == 0


def test_samplers_and_generators(spark):
    v, e = sampling.random_graph(spark, 40, 200, 2, 2, seed=3)
    assert e.filter("src >= dst").count() == 0 and e.groupBy("src", "dst").count().filter("count > 1").count() == 0
    adj = lifetimes.build_adjacency(v, e)
    q = sampling.sample_query(adj, 5, seed=1)
    assert q.size == 5
    assert CsmSession(spark).plan(q, adj, v).count() >= 1
    assert sampling.sample_query(adj, 4, seed=2, kind="tree", walk=False).is_tree()
    n = sampling.erdos_renyi(spark, 60, 0.3).count()
    assert 0.2 * 1770 < n < 0.4 * 1770
    blocks = sampling.erdos_renyi(spark, 300, 0.1, seed=2, block_edges=50)
    assert 0.08 * 44850 < blocks.count() < 0.12 * 44850 and blocks.distinct().count() == blocks.count() and blocks.filter("src >= dst or dst >= 300 or src < 0").count() == 0
    assert sampling.erdos_renyi(spark, 40, 1.0).count() == 780 and sampling.erdos_renyi(spark, 40, 0.0).count() == 0
    ids = spark.createDataFrame([(i * 7,) for i in range(20)], "id long")
    assert sorted(map(tuple, sampling.dense_ids(ids).collect())) == [(i * 7, i) for i in range(20)]


def test_trimmed_mean(spark):
    runs = spark.createDataFrame([("a", float(x)) for x in range(1, 10)] + [("a", None)], "k string, ms double")
    r = trimmed_mean(runs, "k", "ms", 100.0).first()
    assert r["runs"] == 10 and r["success_rate"] == 0.9 and r["trimmed_mean"] == sum(range(2, 10)) / 8
    import random

    r = random.Random(4)
    data = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, 5.0, 5.0, r.random() * 120, r.gauss(50, 1)])) for _ in range(3000)] + [("one", 7.0), ("same", 3.0), ("same", 3.0)]
    got = {x["k"]: x for x in trimmed_mean(spark.createDataFrame(data, "k string, ms double"), "k", "ms", 100.0).collect()}
    for k in {k for k, _ in data}:
        ms = sorted(min(100.0, 100.0 if v is None else v) for x, v in data if x == k)
        own = ms[len(ms) // 10 : len(ms) - len(ms) // 10]
        assert got[k]["runs"] == len(ms) and abs(got[k]["trimmed_mean"] - sum(own) / len(own)) < 1e-9


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        (tmp_path / f"in/part-{2 - f}").write_text("".join(f"e {2 - f} {i}\n" for i in range(4000 * (f + 1))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = text.number_lines(spark.read.text(str(tmp_path / "in"))).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"e {f} {i}" for f in range(3) for i in range(4000 * (3 - f))]
    assert [r["seq"] for r in got] == list(range(1, len(want) + 1)) and [r["value"] for r in got] == want
