"""Registered queries that cover all updates, on the smallest tables."""

from motifstream import queries as q
from motifstream.operators import match as m

SF = "/root/testdata/sf0.001"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_anchored_queries_cover_the_whole_stream(spark):
    adj = q.adj(spark, SF).cache()
    want = rows(m.deltas(m.matches(q.CYCLE, adj)))
    assert rows(q.QUERIES["anchored_delta_whole"](spark, SF)) == want and any(seq <= q.AFTER for seq, _, _ in want) and any(n for _, _, n in want)
    homo = {(seq, p) for seq, p, _ in rows(m.deltas(m.matches(q.EQUAL, adj, homo=True))) if p}
    once = rows(q.QUERIES["homo_once_delta"](spark, SF))
    assert once == homo and any(seq <= q.AFTER for seq, _ in once)
    many = dict(rows(q.QUERIES["homo_multiplicity_delta"](spark, SF)))
    assert many.keys() == dict(once).keys() and all(many[seq] >= n for seq, n in once) and many != dict(once)
    adj.unpersist()


def test_all_mappings_and_both_signs(spark):
    adj = q.adj(spark, SF).cache()
    initial = m.initial_count(m.matches(q.SELECTIVE, adj)).first()["initial"]
    got = q.QUERIES["enumerate_matches"](spark, SF)
    assert got.filter("seq = 0").distinct().count() == initial > q.CAP
    n = {r["is_add"]: r["n"] for r in q.QUERIES["update_kinds"](spark, SF).collect()}
    change = q.QUERIES["nlf_change"](spark, SF).agg(q.F.sum("n").alias("n"), q.F.min("n").alias("low")).first()
    assert change["n"] == 2 * (n[True] - n[False]) and change["low"] < 0
    adj.unpersist()
