"""Best-fit packing planned on the histogram of lengths.

Texts are tokenized once into pieces. The driver sees only how many pieces have each length (at most
``capacity`` numbers) and runs best-fit decreasing over these counts. Its plan says, for each length, which
ranks take which slots; every piece then finds its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import bisect
import json
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifstream.llm.common import documents, lean, materialize

CAPACITY, END_ID = 2048, 0
CACHE = 300_000  # word encodings that a worker keeps
_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


class ChunkEncoder:
    """Ids of a text as little-endian 32-bit bytes, remembering the ids of space-led words.

    Special tokens of the vocabulary that stand in a text get their own ids, as its tokenizer gives them; between them
    the vocabulary's pattern never joins a word to the space after it, so a stretch without double or trailing spaces
    can be encoded word by word, each with the space before it. Other stretches are encoded whole.
    """

    def __init__(self, ranks_path: str, vocabulary_path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(vocabulary_path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError(f"{vocabulary_path}: special tokens that depend on their surroundings")
        self.special = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if added else lambda text: [text]
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return b"".join([self.special[x] if i % 2 else self._plain(x) for i, x in enumerate(self.split(text))])

    def _plain(self, text: str) -> bytes:
        if "  " in text or text.endswith(" "):
            return np.array(self.encode(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        known = self.known
        try:
            tail = b"".join(map(known.__getitem__, rest))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for x in {x for x in rest if x not in known}:
                known[x] = np.array(self.encode(" " + x), "<u4").tobytes()
            tail = b"".join(map(known.__getitem__, rest))
        return np.array(self.encode(head), "<u4").tobytes() + tail


def encoder(ranks_path: str, vocabulary_path: str) -> ChunkEncoder:
    key = ranks_path, vocabulary_path
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


def default_vocabulary() -> tuple[str, str]:
    """The rank file of the vocabulary in byte_bpe_50k.json (same ids), and that file, which names its special tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, after a shorter one if there is a rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each document's ids and the end id; a null text is empty.

    ``vocabulary`` is a rank file and the vocabulary file that names its special tokens.
    """
    paths = vocabulary or default_vocabulary()

    def run(batches):
        enc = encoder(*paths)
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                ids = enc.ids(text.as_py() or "") + END_ID.to_bytes(4, "little")
                out += [(doc, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b["doc_id"].type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(run, 512), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over counts: for each length, (first rank, first sequence, pieces a sequence, offset).

    Sequences with equal room stay together as ranges, so work and plan follow the number of lengths, not of
    pieces: each step uses up a range or a length.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free ids -> (first sequence, sequences)
    sizes: list[int] = []  # the keys of room in order
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0

    def add(free: int, first: int, n: int) -> None:
        if free and n:
            if not room[free]:
                bisect.insort(sizes, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, own = counts[length], 0, []
        while left:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                free = sizes[i]
                first, n = room[free].pop()
                if not room[free]:
                    sizes.pop(i)
            else:
                free, first, n = capacity, opened, math.ceil(left / (capacity // length))
                opened += n
            each = free // length
            full = min(n, left // each)
            own.append((rank, first, each, capacity - free))
            part = min(left - full * each, each - 1) if full < n else 0
            rank, left = rank + full * each + part, left - full * each - part
            add(free - each * length, first, full)
            if part:
                add(free - part * length, first + full, 1)
            add(free, first + full + bool(part), n - full - bool(part))
        slots[length] = own
    return slots


def pack(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: tuple[str, str] | None = None, bucket_rows: int = 1000) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Pieces are written to the shared folder once; a length of more than ``bucket_rows`` pieces is ranked in buckets of
    about so many, dealt by the row's own number, so a length, key or text of a third of all rows is spread. An empty text has the end id alone; null ids and repeated rows are packed like any other.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, capacity=capacity, vocabulary=vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast({k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in plan(counts, capacity).items()})
    # lengths of many pieces are dealt into buckets; the table of these has at most ``capacity`` rows
    shares = spark.createDataFrame([(k, math.ceil(n / bucket_rows)) for k, n in counts.items()], "l long, n_buckets int")
    dealt = pieces.join(F.broadcast(shares), F.col("length") == F.col("l")).withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("n_buckets")).cast("int")).drop("l", "n_buckets")
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("own", F.row_number().over(W.partitionBy("length", "bucket").orderBy("row"))).join(sums.withColumn("before", before).drop("n"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(zero_copy_only=False), b["rank"].to_numpy(zero_copy_only=False)
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                ranks, firsts, each, at = slots.value[x]
                own = np.flatnonzero(length == x)
                i = np.searchsorted(ranks, rank[own], "right") - 1
                j = rank[own] - ranks[i]
                seq[own], offset[own] = firsts[i] + j // each[i], at[i] + j % each[i] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit(spark, sf_dir):
    return pack(documents(spark, sf_dir))


QUERIES = {"op7_best_fit": op7_best_fit}
SQL: dict[str, str] = {}
