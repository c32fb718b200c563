"""Continuous matching over a Structured Streaming source of updates.

Each micro-batch extends the tables of vertex and edge lives and runs the anchored plans for its own updates only.
Tables are kept as segments: a batch writes the lives it touched, and every so many batches the open ones are written
anew as a base. A batch counts once its manifest is there, so a driver that starts again finds what was done, and a
batch that is run again overwrites what it wrote before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from motifstream.operators.delta import anchored_deltas, triples_of
from motifstream.operators.lifetimes import FOREVER, _alternating, adjacency, closings
from motifstream.operators.storage import cut, exists, release, remove
from motifstream.plans.query import QueryGraph

VERTICES = "id long, label int, start_seq long, end_seq long"
EDGES = "src long, dst long, elabel int, src_label int, dst_label int, start_seq long, end_seq long"
DELTAS = "seq long, positives long, negatives long"
UPDATES = "seq long, kind string, is_add boolean, id1 long, id2 long, label int"
MANIFEST = "upto long, base boolean"
KEYS = {"vertices": (VERTICES, ["id"]), "edges": (EDGES, ["src", "dst"])}


@dataclass
class ContinuousMatcher:
    """State of one query over one stream; all of it is in ``folder``, which all executors and later drivers share.

    ``vertices`` (id, label) are known from the start, more come as updates. Lives are those of the batch engine: an
    edge is labelled by its ends' lives at its start, and if an end has none then it matches nothing.
    Updates must come in ascending ``seq``; those at or below the last finished batch's are rejected as late.
    """

    spark: SparkSession
    query: QueryGraph
    vertices: DataFrame
    folder: str
    homo: bool = False
    cascade_vertex_delete: bool = True
    compact_every: int = 16

    # ---- state ----

    def done(self) -> list[tuple[int, int, bool]]:
        """(batch, last update, whether it wrote a base) of the finished batches since the last base but one, in order."""
        path = f"{self.folder}/manifest"
        if not exists(self.spark, path):
            return []
        rows = self.spark.read.schema(f"{MANIFEST}, batch int").json(path).collect()  # a row a batch
        return sorted((r["batch"], r["upto"], r["base"]) for r in rows)

    def _finish(self, batch: int, upto: int, base: bool) -> None:
        self.spark.createDataFrame([(upto, base)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/batch={batch}")

    def _read(self, table: str, batch: int, base: bool) -> DataFrame:
        return self.spark.read.schema(KEYS[table][0]).parquet(f"{self.folder}/{table}/{'base' if base else 'segment'}={batch}")

    def _write(self, rows: DataFrame, table: str, batch: int, base: bool) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/{'base' if base else 'segment'}={batch}")
        return self._read(table, batch, base)

    def _open(self, table: str, known: list[tuple[int, int, bool]]) -> DataFrame:
        """Lives that are open after the batches ``known``: those of the last base but for keys that later segments hold, and theirs."""
        schema, keys = KEYS[table]
        at = max(i for i, (*_, base) in enumerate(known) if base)
        lives = self._read(table, known[at][0], True)
        later = [self._read(table, b, False).withColumn("batch", F.lit(b)) for b, *_ in known[at + 1 :]]
        if not later:
            return lives
        # of the batches since the base the last word on each key, which is as much as they touched
        newer = reduce(DataFrame.unionByName, later)
        last = newer.groupBy(*keys).agg(F.max("batch").alias("batch"))
        own = cut(newer.join(last, [*keys, "batch"], "left_semi").select(lives.columns), "since-base")
        return lives.join(own.select(*keys), keys, "left_anti").unionByName(own.filter(F.col("end_seq") == FOREVER))

    # ---- batches ----

    def start_from(self, edges: DataFrame) -> None:
        """Store the initial graph as batch -1."""
        if self.done():
            raise ValueError(f"{self.folder} holds a stream that has started")
        first = self.vertices.groupBy("id").agg(F.min("label").alias("label"))
        zero, never = F.lit(0).cast("long").alias("start_seq"), F.lit(FOREVER).alias("end_seq")
        vertices = self._write(first.select("id", "label", zero, never), "vertices", -1, True)
        pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "elabel").groupBy("src", "dst").agg(F.min("elabel").alias("elabel"))
        self._write(_labelled(pairs.select("src", "dst", "elabel", zero, never), vertices), "edges", -1, True)
        self._finish(-1, 0, True)

    def process(self, updates: DataFrame, batch: int) -> None:
        """One micro-batch: new lives of what it touches, then the matches that its updates make or end."""
        known = [x for x in self.done() if x[0] < batch]
        if not known:
            raise ValueError("start_from has to store the initial graph first")
        after = max(upto for _, upto, _ in known)
        updates = cut(updates.select("seq", "kind", "is_add", "id1", "id2", "label"), "updates")
        bounds = updates.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
        if bounds["b"] is None:
            return
        if bounds["a"] <= after:
            raise ValueError(f"update {bounds['a']} is late: updates up to {after} are done")
        open_v, open_e = self._open("vertices", known), self._open("edges", known)
        # vertices
        ops = updates.filter("kind = 'v'").select(F.col("id1").alias("id"), "seq", "is_add", "label")
        held = open_v.join(ops.select("id").distinct(), "id", "left_semi").select("id", F.col("start_seq").alias("seq"), F.lit(True).alias("is_add"), "label")
        new_v = self._write(_alternating(held.unionByName(ops), ["id"]).select("id", "label", "start_seq", "end_seq"), "vertices", batch, False)
        now_v = open_v.join(ops.select("id").distinct(), "id", "left_anti").unionByName(new_v)
        # edges: pairs with updates, and open ones at a deleted vertex
        ops = updates.filter("kind = 'e' and id1 <> id2").select(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi"), "seq", "is_add", "label")
        touched = ops.select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
        if self.cascade_vertex_delete:
            gone = updates.filter("kind = 'v' and not is_add").select(F.col("id1").alias("id")).distinct()
            for end in ("src", "dst"):
                touched = touched.unionByName(open_e.join(gone, open_e[end] == gone["id"], "left_semi").select("src", "dst"))
        held = open_e.join(touched.distinct(), ["src", "dst"], "left_semi")
        ops = ops.unionByName(held.select(F.col("src").alias("lo"), F.col("dst").alias("hi"), F.col("start_seq").alias("seq"), F.lit(True).alias("is_add"), F.col("elabel").alias("label")))
        if self.cascade_vertex_delete:
            ops = ops.unionByName(closings(ops, updates))
        lives = _alternating(ops, ["lo", "hi"]).select(F.col("lo").alias("src"), F.col("hi").alias("dst"), F.col("label").cast("int").alias("elabel"), "start_seq", "end_seq")
        # lives from before keep their labels, new ones get those of their ends
        older = lives.filter(F.col("start_seq") <= after).join(held.select("src", "dst", "src_label", "dst_label"), ["src", "dst"])
        new_e = self._write(_labelled(lives.filter(F.col("start_seq") > after), now_v).unionByName(older), "edges", batch, False)
        now = open_e.join(new_e.select("src", "dst").distinct(), ["src", "dst"], "left_anti").unionByName(new_e)
        adj = adjacency(self._useful(now)).persist()  # of this batch only; what an executor loses is made again from the segments
        try:
            found = anchored_deltas(self.query, adj, after, int(bounds["b"]), homo=self.homo)
            found.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        finally:
            adj.unpersist()
        segments = len(known) - max(i for i, (*_, is_base) in enumerate(known) if is_base)  # since the last base, with this batch's
        base = segments >= self.compact_every
        if base:
            state = [*known, (batch, 0, False)]
            for table in KEYS:
                self._write(self._open(table, state), table, batch, True)
        self._finish(batch, int(bounds["b"]), base)
        release(updates)
        if base:
            self._forget(known)

    def _forget(self, known: list[tuple[int, int, bool]]) -> None:
        """Delete the state from before the last base but one: this batch may still run again, which takes that base."""
        kept = max(b for b, _, base in known if base)
        for b in (b for b, *_ in known if b < kept):
            remove(self.spark, f"{self.folder}/manifest/batch={b}", *(f"{self.folder}/{table}/{kind}={b}" for table in KEYS for kind in ("base", "segment")))

    def _useful(self, lives: DataFrame) -> DataFrame:
        """Lives of edges that some query edge can be mapped to."""
        t = triples_of(self.query, self.spark)
        on = (F.least("src_label", "dst_label") == F.col("lo")) & (F.greatest("src_label", "dst_label") == F.col("hi")) & (F.col("elabel") == F.col("el"))
        return lives.filter("src_label is not null and dst_label is not null").join(F.broadcast(t), on, "left_semi")  # as many rows as the query has triples

    def start(self, stream: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        """Run over a streaming DataFrame of updates until it has no more."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint or f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def deltas(self) -> DataFrame:
        """(seq, positives, negatives) of all finished batches."""
        path, done = f"{self.folder}/deltas", self.done()
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], DELTAS)
        rows = self.spark.read.schema(f"{DELTAS}, batch int").parquet(path)
        return rows.filter(F.col("batch") <= max(b for b, *_ in done)).drop("batch")


def _labelled(lives: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edge lives with the labels that their ends have at the start, null where an end has no life then."""
    for end in ("src", "dst"):
        v = vertices.select(F.col("id").alias("_id"), F.col("label").alias(f"{end}_label"), F.col("start_seq").alias("_from"), F.col("end_seq").alias("_to"))
        on = (lives[end] == v["_id"]) & (lives["start_seq"] >= v["_from"]) & (lives["start_seq"] < v["_to"])
        lives = lives.join(v, on, "left").drop("_id", "_from", "_to")
    return lives.select("src", "dst", "elabel", "src_label", "dst_label", "start_seq", "end_seq")
