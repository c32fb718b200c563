"""Summaries of run times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1024  # of the values of a key


def trimmed_mean(runs: DataFrame, key: str, value: str, limit: float, trim: float = 0.1) -> DataFrame:
    """(key, runs, success_rate, trimmed_mean): missing or late values count as ``limit``; a share ``trim`` goes at either end.

    Values of a key are counted in buckets; only the buckets in which the cuts lie are ranked, value by value, so a key
    of a third of all rows is no single task's.
    """
    ms = F.least(F.coalesce(F.col(value), F.lit(limit)), F.lit(limit)).cast("double").alias("ms")
    rows = runs.select(F.col(key).alias("k"), ms, (F.col(value).isNotNull() & (F.col(value) < limit)).cast("int").alias("ok"))
    per = rows.groupBy("k").agg(F.count("*").alias("runs"), F.avg("ok").alias("success_rate"), F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    per = per.withColumn("cut", F.floor(F.col("runs") * trim))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("ms") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    bounds = per.select(F.col("k").alias("key"), "lo", "hi")
    placed = rows.join(bounds, F.col("k").eqNullSafe(F.col("key"))).select("k", "ms", place.alias("bucket"))
    sums = placed.groupBy("k", "bucket").agg(F.count("*").alias("n"), F.sum("ms").alias("total"))
    before = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before(W.partitionBy("k").orderBy("bucket")))
    sums = sums.join(per.select(F.col("k").alias("key"), "runs", "cut"), F.col("k").eqNullSafe(F.col("key"))).drop("key")
    first, last = F.greatest("before", "cut"), F.least(F.col("before") + F.col("n"), F.col("runs") - F.col("cut"))
    sums = sums.withColumn("left", F.greatest(last - first, F.lit(0)))  # how many of the bucket are between the cuts
    whole = sums.filter(F.col("left") == F.col("n")).select("k", "left", "total")
    edge = sums.filter((F.col("left") > 0) & (F.col("left") < F.col("n"))).select(F.col("k").alias("key"), F.col("bucket").alias("b"), F.col("before").alias("start"), "runs", "cut")
    values = placed.join(edge, F.col("k").eqNullSafe(F.col("key")) & (F.col("bucket") == F.col("b"))).groupBy("k", "bucket", "ms", "start", "runs", "cut").agg(F.count("*").alias("n"))
    values = values.withColumn("at", F.col("start") + before(W.partitionBy("k", "bucket").orderBy("ms")))
    inside = F.greatest(F.least(F.col("at") + F.col("n"), F.col("runs") - F.col("cut")) - F.greatest("at", "cut"), F.lit(0))
    parts = whole.unionByName(values.select("k", inside.alias("left"), (inside * F.col("ms")).alias("total")))
    means = parts.groupBy("k").agg((F.sum("total") / F.sum("left")).alias("trimmed_mean")).withColumnRenamed("k", "key")
    return per.join(means, F.col("k").eqNullSafe(F.col("key")), "left").select(F.col("k").alias(key), "runs", "success_rate", "trimmed_mean")
