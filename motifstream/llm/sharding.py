"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters whole records into memory-sized buckets by seeded hashes and writes the buckets to the shared
folder. Pass two reads a bucket at a time, puts it in a Fisher-Yates order (Spark's ``shuffle`` draws its
permutation that way), numbers the slots and writes the shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from motifstream.llm.common import documents, free_name, materialize, new_path, release

BUCKET_BYTES = 16 << 20  # of text in a bucket: a task holds one at a time


def key_shard(key: Column, n_shards: int, seed: int) -> Column:
    """Consistent shard of a key: the largest ``s`` below ``n_shards`` whose seeded hash is a multiple of ``s + 1``.

    Going from n to n + 1 shards only adds the test for shard n, so rows move into the new shard or stay.
    """
    tests = [F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(s), key), F.lit(s + 1)) == 0, F.lit(s)) for s in range(n_shards - 1, 0, -1)]
    return F.coalesce(*tests, F.lit(0)).cast("int")


def scatter(docs: DataFrame, *, n_shards: int = 24, seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pass one: (shard, bucket, records) with the whole records of a bucket as an array, written to the shared folder.

    Buckets are counted by the bytes of each shard, so that they hold about ``bucket_bytes`` of text also where a shard
    is hot. A row's bucket comes from its place in the scan, so rows that repeat one key or text spread over all
    buckets of their shard.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    shard = key_shard(docs["doc_id"], n_shards, seed)
    bytes_of = {r["shard"]: r["bytes"] for r in docs.groupBy(shard.alias("shard")).agg(F.sum(size).alias("bytes")).collect()}  # one number a shard
    n_buckets = [max(1, math.ceil(bytes_of.get(s, 0) / bucket_bytes)) for s in range(n_shards)]
    rows = docs.select(shard.alias("shard"), F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id(), docs["doc_id"]).alias("hash"), F.struct(*(docs[c] for c in docs.columns)).alias("record"))
    # buckets have numbers of their own over all shards, and each is a partition of its own
    of_shard = F.get(F.array(*(F.lit(n) for n in n_buckets)), F.col("shard"))
    before = F.get(F.array(*(F.lit(sum(n_buckets[:s])) for s in range(n_shards))), F.col("shard"))
    rows = rows.select("shard", (before + F.pmod("hash", of_shard)).cast("int").alias("bucket"), "record").repartition(sum(n_buckets), "bucket")
    return materialize(rows.groupBy("shard", "bucket").agg(F.collect_list("record").alias("records")), "buckets")


def shuffle_shards(docs: DataFrame, *, n_shards: int = 24, seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(shard, slot, bucket, record): every whole record with its shard and its slot there, gapless from 0, in shuffled order.

    Pass two. A bucket is one row of what pass one wrote, so its permutation does not change if a task runs again.
    """
    buckets = scatter(docs, n_shards=n_shards, seed=seed, bucket_bytes=bucket_bytes)
    first = F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row a bucket; written, so that Spark knows its size and sends it to the buckets as long as it is small
    starts = materialize(buckets.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.size("records").cast("long").alias("n")).select("b", first.alias("first")), "bucket-starts")
    placed = buckets.join(starts, buckets["bucket"] == starts["b"]).select("shard", "bucket", "first", F.posexplode(F.shuffle("records", seed + 2)).alias("at", "record"))
    out = placed.select("shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), "bucket", "record")
    out.uses = buckets, starts
    return out


def write_shards(docs: DataFrame, path: str, *, n_shards: int = 24, **options) -> tuple[DataFrame, str, str]:
    """Write whole records as Parquet in shuffled order, a folder for each shard; read back, with the names of shard and slot.

    These are ``_shard`` and ``_slot``, longer where ``docs`` has such columns. Null texts, null ids, repeated rows and
    extra columns are records like any other; an empty table makes no shard.
    """
    shard, slot = free_name("_shard", docs.columns), free_name("_slot", docs.columns)
    rows = shuffle_shards(docs, n_shards=n_shards, **options)
    out = rows.select("record.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    release(*rows.uses)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.sparkSession.read.schema(f"{kinds}, `{slot}` long, `{shard}` int").parquet(path), shard, slot


def shard_digests(docs: DataFrame, path: str, *, n_shards: int = 24, seed: int = 20, **options) -> DataFrame:
    """Shuffle ``docs`` into shards under ``path`` and read them back: a row for each record, as it stands in its shard.

    Null texts count no bytes (size 8), null ids are a key like any other, repeated rows get slots of their own, and an
    empty table gives no rows.
    """
    back, shard, slot = write_shards(docs, path, n_shards=n_shards, seed=seed, **options)
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id")
    grown = F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(n_shards), key), F.lit(n_shards + 1)) == 0, F.lit(n_shards)).otherwise(F.col(shard))
    return back.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        F.col(shard).alias("shard"), F.col(slot).alias("slot"), grown.cast("int").alias("grown_shard"))


def op2_shuffle(spark, sf_dir):
    return shard_digests(documents(spark, sf_dir), new_path(spark, "shards"))


QUERIES = {"op2_shuffle": op2_shuffle}
SQL: dict[str, str] = {}
