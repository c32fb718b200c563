"""Connected components as DataFrames: smallest labels spread over links and hook roots, then labels jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifstream.llm.common import materialize, release


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b): the smallest node that can be reached.

    A node takes the smallest label among its neighbours and sends it to its own label's node too, so whole trees
    are hooked and rounds grow with the logarithm of a chain (19 on the worst of the orders tried on one of 2^18
    nodes). Rounds go on until no label moves; ``max_rounds`` only guards, and to reach it is an error.

    A round is a few joins and minima with partial aggregation, so a node with very many links is only split and
    reduced; labels are cut from their lineage in the shared folder each round. Null ends are left out.
    """
    links = links.filter("a is not null and b is not null")
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        own = materialize(labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), "near"), "near-labels")
        hook = own.filter("near < was").groupBy(F.col("was").alias("root")).agg(F.min("near").alias("hook"))
        hooked = materialize(own.join(hook, own["node"] == hook["root"], "left").select("node", "was", F.least("was", "near", "hook").alias("now")), "hooked-labels")
        jump = hooked.select(F.col("node").alias("at"), F.col("now").alias("far"))
        before = labels
        labels = materialize(hooked.join(jump, hooked["now"] == jump["at"], "left").select("node", F.least("now", F.coalesce("far", "now")).alias("component"), (F.col("was") > F.least("now", F.coalesce("far", "now"))).alias("moved")), "labels")
        release(before, own, hooked)
        if labels.filter("moved").isEmpty():
            release(both)
            return labels.select("node", "component")
    raise RuntimeError(f"components: labels still move after {max_rounds} rounds")
