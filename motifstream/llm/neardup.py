"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

Texts of equal words are one class. MinHash bands of the classes make buckets; in each bucket all members are
compared with its leader, the member whose buckets are largest (the text that a group of copies was made from), then
with a second one where components are left apart. A pair is dropped if parity bitmaps of its full sets prove it to
be no link, or if its odd sketches (parity bitmaps of the MinHash samples) put its similarity far too low; the full
shingle sets decide on the rest. What two leaders leave apart meets by its rarest shingles: two sets that overlap
enough share one of these, so that no link is lost and members that are only alike do not meet.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifstream.llm.common import documents, lean, materialize, release
from motifstream.llm.components import components

WORDS = 5  # of a shingle
BANDS, ROWS = 32, 4  # a pair at 0.8 shares no band with a chance of (1 - 0.8 ** 4) ** 32 = 5e-8
BITS = 1024
PERCENT = 80
QUERY_WORDS = 4  # what the query op4 asks for
MARGIN = 0.25  # of the sketch's estimate below the threshold: seven deviations of 128 samples
CACHE = 200_000
LEADERS = 1  # of a bucket, before rare shingles
COUNTERS = 1 << 18  # of shingles: their order is by these, so the numbers that go to the driver have a fixed size
SIZE_STEP = 1.05  # from one class of set sizes to the next
_RNG = np.random.default_rng(4)
_MUL = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_SALT = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        self.words, self.known, self.hash, self.digest = words, {}, xxh3_64_intdigest, xxh3_128_digest

    def split(self, text: str | None) -> list[bytes]:
        return (text or "").encode().translate(_FOLD).split()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.words:
            return np.array([self.hash(b" ".join(words), len(words))], np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        for x in {x for x in words if x not in self.known}:
            self.known[x] = self.hash(x)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.words + 1
        out = h[:n]
        for i in range(1, self.words):
            out = mix(out + np.uint64(0x9E3779B97F4A7C15)) + h[i : n + i]
        return np.unique(mix(out))


def minhash(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        out = np.minimum(out, (_MUL[:, None] * x[None, i : i + 2048] + _ADD[:, None]).min(1))
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    x = mix(samples.astype(np.uint64) + _SALT).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out + x[:, i])
    return out.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap: each (place, sample) flips one of the bits, so equal samples of two texts cancel in the XOR."""
    bit = mix(samples.astype(np.uint64) ^ _SALT) % np.uint64(BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of all shingles. The XOR of two has at most as many bits as there are shingles in one set only."""
    bit = shingles % np.uint64(BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def estimate(flipped: int) -> float:
    """Similarity from the population count of the XOR of two sketches."""
    return 1 + BITS / (4 * BANDS * ROWS) * math.log(max(1e-9, 1 - 2 * flipped / BITS))


def most_flipped(similarity: float) -> int:
    """The largest population count whose estimate is at least ``similarity``."""
    return max(i for i in range(BITS // 2) if estimate(i) >= similarity)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, class, n_shingles, bands, sketch, parity, z) for every row; ``class`` is a digest of all its words, ``z`` its compressed text."""

    def run(batches):
        import zstandard

        own, zip_ = Shingler(words), zstandard.ZstdCompressor(level=1)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, out = b.slice(lo, 512), []
                for text in part["text"]:
                    t = text.as_py()
                    ws = own.split(t)
                    sh = own.shingles(ws)
                    if len(sh):
                        m = minhash(sh)
                        out.append((own.digest(b" ".join(ws)), len(sh), band_keys(m), odd_sketch(m), parity(sh), zip_.compress(t.encode())))
                    else:
                        out.append((None, 0, None, None, None, None))
                cols = list(zip(*out))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), *(pa.array(c, longs) for c in cols[2:5]), pa.array(cols[5], pa.binary())],
                    ["doc_id", "class", "n_shingles", "bands", "sketch", "parity", "z"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id {kind}, class binary, n_shingles long, bands array<long>, sketch array<long>, parity array<long>, z binary")


def _flipped(x: str, y: str) -> Column:
    """Population count of the XOR of two bitmaps."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)])


def _possible(percent: int) -> Column:
    """False only for pairs that cannot reach the threshold: sizes too different, or too many shingles in one set only."""
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sized & (_flipped("parity_a", "parity_b") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def _near(pairs: DataFrame, classes: DataFrame, percent: int, sketched: bool = True) -> DataFrame:
    """Pairs that are possible and (if ``sketched``) whose similarity the odd sketches do not put far too low."""
    a, b = (classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("parity").alias(f"parity_{x}")) for x in "ab")
    likely = _flipped("sketch_a", "sketch_b") <= most_flipped(percent / 100 - MARGIN)
    return pairs.join(a, "a").join(b, "b").filter(_possible(percent) & likely if sketched else _possible(percent)).select("a", "b")


class _Texts:
    """Shingles of compressed texts, the last few remembered."""

    def __init__(self, words: int):
        import zstandard

        self.unzip, self.own, self.last = zstandard.ZstdDecompressor(), Shingler(words), {}

    def shingles(self, z: bytes) -> np.ndarray:
        if z not in self.last:
            if len(self.last) >= 64:
                self.last.clear()
            self.last[z] = self.own.shingles(self.unzip.decompress(z).translate(_FOLD).split())
        return self.last[z]


def confirm(pairs: DataFrame, classes: DataFrame, *, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets reach the threshold.

    Each text meets its pairs in one join (adaptive execution splits a text of very many pairs).
    """

    def run(batches):
        texts = _Texts(words)
        for b in batches:
            keep = []
            for x, y in zip(b["za"], b["zb"]):
                p, q = texts.shingles(x.as_py()), texts.shingles(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    met = asked.join(classes.select("id", "z"), "id").groupBy("a", "b").agg(F.min(F.when(F.col("id") == F.col("a"), F.col("z"))).alias("za"), F.min(F.when(F.col("id") == F.col("b"), F.col("z"))).alias("zb"))
    return met.mapInArrow(lean(run, 512), "a long, b long")


def _with_label(df: DataFrame, labels: DataFrame | None, of: str, name: str) -> DataFrame:
    """``df`` with the component of ``of``: its own id where it has no link."""
    if labels is None:
        return df.withColumn(name, F.col(of))
    at = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return df.join(at, F.col(of) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", of)).drop("_node", "_component")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links, which join whole components: only one node of each takes part."""
    if labels is None:
        return components(links)
    ends = _with_label(_with_label(links, labels, "a", "x"), labels, "b", "y").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    more = components(ends)
    known = labels.unionByName(more.select("node", F.col("node").alias("component"))).dropDuplicates(["node"])
    return materialize(_with_label(known, more, "component", "now").select("node", F.col("now").alias("component")), "labels")


def size_classes(most: int) -> np.ndarray:
    """The smallest size of each class, from 1 on."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * SIZE_STEP)))
    return np.array(out)


def prefixes(n: int, percent: int, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(own class, partner's class, length): a set of ``n`` shares one of its first so many shingles with any partner.

    Two sets that overlap in k places share one of the first n - k + 1 of either, in any order common to both.
    """
    low, high, at = -(-percent * n // 100), 100 * n // percent, lambda x: int(np.searchsorted(starts, x, "right")) - 1
    need = lambda c: -(-percent * (n + max(low, int(starts[c]))) // (100 + percent))
    return [(at(n), c, n - need(c) + 1) for c in range(at(low), at(high) + 1)]


def rare_pairs(members: DataFrame, classes: DataFrame, *, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Pairs (a, b) of ``members`` (id, own) with different ``own`` that are possible and share a rare shingle as all links do.

    The order of shingles is by counters of their hashes, the rarest first. Sizes go by classes, so that a pair meets
    only in the first few shingles that its two sizes leave open: texts that are merely alike meet by what few of them
    have, not by what all of them share.
    """
    spark = classes.sparkSession
    members = materialize(members, "members")  # as a table of a known size, which Spark sends to the texts as long as it is small
    texts = materialize(members.join(classes.select("id", "z"), "id"), "member-texts")

    def count(batches):
        own, out = _Texts(words), np.zeros(COUNTERS, np.int64)
        for b in batches:
            for z in b["z"]:
                out += np.bincount((own.shingles(z.as_py()) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])

    found = texts.select("z").mapInArrow(lean(count, 512), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most COUNTERS rows
    counters = np.zeros(COUNTERS, np.int64)
    counters[found["at"].to_numpy()] = found["n"].to_numpy()
    held = spark.sparkContext.broadcast(counters)

    def emit(batches):
        own, starts, counts = _Texts(words), size_classes(1 << 40), held.value
        for b in batches:
            for i, label, z in zip(b["id"].to_pylist(), b["own"].to_pylist(), b["z"]):
                sh = own.shingles(z.as_py())
                sh = sh[np.lexsort((sh, counts[(sh % np.uint64(COUNTERS)).astype(np.int64)]))]
                found = prefixes(len(sh), percent, starts)
                keys = np.concatenate([mix(sh[:k] + np.uint64(min(c, d) << 32 | max(c, d))) for c, d, k in found]).view(np.int64)
                left = np.concatenate([len(sh) - np.arange(k) for *_, k in found])
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.full(len(keys), x)) for x in (i, label, len(sh))), pa.array(left)], ["key", "id", "own", "n", "left"])

    rows = materialize(texts.select("id", "own", "z").mapInArrow(lean(emit, 512), "key long, id long, own long, n long, left long"), "rare-shingles")
    # most keys are of one component only; the others are written, so that Spark knows how few they are before it joins
    met = materialize(rows.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo <> hi").select("key"), "met-keys")
    left = materialize(rows.join(met, "key"), "met-shingles")
    release(rows)
    a, b = (left.select("key", F.col("id").alias(x), F.col("own").alias(f"own_{x}"), F.col("n").alias(f"n{x}"), F.col("left").alias(f"left_{x}")) for x in "ab")
    # of the shingles that a pair shares the first has enough of either set after it
    room = F.least("left_a", "left_b") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    pairs = materialize(a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.col("own_a") != F.col("own_b")) & room).select("a", "b").distinct(), "met")
    out = materialize(_near(pairs, classes, percent, sketched=False), "rare-pairs")
    release(members, texts, met, left, pairs)
    return out


def class_links(banded: DataFrame, classes: DataFrame, *, percent: int = PERCENT, words: int = WORDS, leaders: int = LEADERS, first: DataFrame | None = None) -> DataFrame | None:
    """(node, component) of all classes with links: ``banded`` has (id, bands) of each, ``classes`` (id, n_shingles, sketch,
    parity, z) of these and maybe more to look up; ``first``: links known before.

    A round compares each bucket's members with its leader and takes the leader out; buckets whose other members are
    in one component are done. After ``leaders`` rounds the members that are left meet by rare shingles.
    """
    banded = banded.select("id", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    left, labels = materialize(banded.join(sizes, "key"), "buckets"), None
    for _ in range(leaders):
        popular = left.groupBy("id").agg(F.sum("n").alias("popular"))
        top = left.join(popular, "id").groupBy("key").agg(F.max(F.struct("popular", "id")).alias("top")).select("key", F.col("top.id").alias("leader"))
        held = materialize(left.join(top, "key").filter("id <> leader").select("id", "key", "leader"), "led-buckets")
        apart = _with_label(_with_label(held.select("leader", "id").distinct(), labels, "leader", "x"), labels, "id", "y").filter("x <> y")
        near = materialize(_near(apart.select(F.col("leader").alias("a"), F.col("id").alias("b")), classes, percent), "pairs")
        links = materialize(confirm(near, classes, percent=percent, words=words), "links")
        if labels is None:
            labels = components(links if first is None else links.unionByName(first))
        else:
            labels = _joined(labels, links)
        owned = _with_label(held, labels, "id", "own")
        open_ = owned.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", "n")
        before, left = left, materialize(held.select("id", "key").join(open_, "key"), "buckets")
        release(before, held, near, links)
        if left.isEmpty():
            release(left)
            return labels
    members = _with_label(left.select("id").distinct(), labels, "id", "own")
    pairs = rare_pairs(members, classes, percent=percent, words=words)
    links = materialize(confirm(pairs, classes, percent=percent, words=words), "links")
    labels = _joined(labels, links)
    release(left, pairs, links)
    return labels


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Texts without words are linked with nothing, as are rows without an id (their component is null, and they are
    kept). Rows that share an id are one document with all their texts: its links are those of any of them. Equal
    texts are one class and never paired. Other columns are ignored.
    """
    signed = materialize(signatures(docs, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    rows = signed.select("doc_id", "class", "n_shingles")
    own = signed.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    reps = own.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("x")).select(F.col("x.row").alias("id"), F.col("x.doc_id").alias("rep"))
    # of a class only its bands move; bitmaps and text of its first row are looked up where a pair asks for them
    classes = materialize(own.select("row", "class", "bands").join(reps.hint("merge"), F.col("row") == F.col("id")).select("id", "rep", "class", "bands"), "classes")
    looked = signed.select(F.col("row").alias("id"), "n_shingles", "sketch", "parity", "z")
    # texts of one document are linked; as a rule each has one
    several = own.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select(F.col("doc_id").alias("of"))
    texts = own.join(several, F.col("doc_id") == F.col("of")).select("of", F.col("class").alias("c")).distinct()
    texts = materialize(texts.join(classes.select("id", "class"), F.col("c") == F.col("class")).select("of", "id"), "texts-of-one")
    stars = texts.join(texts.groupBy("of").agg(F.min("id").alias("a")), "of").filter("a <> id").select("a", F.col("id").alias("b"))
    labels = class_links(classes, looked, percent=percent, words=words, first=None if texts.isEmpty() else stars)
    owned = _with_label(classes.select("id", "rep", "class"), labels, "id", "own")
    least = owned.groupBy("own").agg(F.min("rep").alias("component"))
    final = owned.join(least, "own").select(F.col("class").alias("c"), "component")
    out = rows.join(final, F.col("class") == F.col("c"), "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns as they were."""
    kept = near_duplicates(docs, percent=percent, words=words).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_gone"], "left_anti")


def op4_odd_sketch(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=QUERY_WORDS)


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {QUERY_WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {QUERY_WORDS - 2}))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(node, far) AS (SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.far),
        least_far AS (SELECT node, min(far) AS far FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(far, d.doc_id)) AS component_id, least(d.doc_id, coalesce(far, d.doc_id)) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_far ON node = d.doc_id"""


QUERIES = {"op4_odd_sketch": op4_odd_sketch}
SQL = {"op4_odd_sketch": _sql()}
