"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k is split into k + 1 pieces; a text within k edits of it holds one piece
unchanged. Rolling hashes find the first letters of the pieces in whole texts, and Myers' bit-parallel distance
verifies the surroundings of the hits, overlapping ones once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from motifstream.llm.common import documents, lean

PIECE = 22  # letters a piece has at least; an item's budget is what that leaves
BLOCK_CHARS = 16_000_000  # of item text in a block: what a worker holds at a time
CHUNK = 1 << 18  # letters that are hashed at a time
FLAGS = 1 << 20
_WORDS = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    """Lower-cased words with single spaces, and one at either end."""
    return f" {' '.join(_WORDS.findall((text or '').lower()))} "


def budget(item: str, piece: int = PIECE) -> int:
    return max(0, len(item) // piece - 1)


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edits from ``pattern`` to any part of ``text``, and where the first such part ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, now, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = ((eq & up) + up ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        now += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if now < best:
            best, end = now, j
    return best, end


def rolling(letters: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` letters at each place: powers of two of widths, put together."""
    n = len(letters) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, at, out, size = np.uint64(_BASE), 0, None, 1
    h = letters.astype(np.uint64) + np.uint64(1)
    while True:
        if width & size:
            out = h[at : at + n] if out is None else out * power + h[at : at + n]
            at += size
        if size * 2 > width:
            break
        h = h[:-size] * power + h[size:]
        power, size = np.uint64(int(power) ** 2 & (1 << 64) - 1), size * 2
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def letters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[object, str]], piece: int = PIECE):
        self.items = [(key, x, budget(x, piece)) for key, text in items if len(x := normal(text)) > 2]
        found = defaultdict(list)  # width -> (hash, item, offset) of the first letters of each piece
        for n, (_, x, k) in enumerate(self.items):
            width = min(piece, len(x))
            at = [len(x) * i // (k + 1) for i in range(k + 1)]
            h = rolling(letters_of(x), width)
            found[width].append((h[at], np.full(k + 1, n), np.array(at)))
        self.probes = {}
        for width, parts in found.items():
            h, n, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            flags = np.zeros(FLAGS, bool)
            flags[h % np.uint64(FLAGS)] = True
            self.probes[width] = h[order], n[order].astype(np.int32), at[order].astype(np.int32), flags

    def starts(self, own: str) -> dict[int, set[int]]:
        """For each item with a piece in a normal text: where the item would start there."""
        out = defaultdict(set)
        for width, (hashes, items, offsets, flags) in self.probes.items():
            for lo in range(0, max(0, len(own) - width + 1), CHUNK):
                h = rolling(letters_of(own[lo : lo + CHUNK + width - 1]), width)
                at = np.flatnonzero(flags[h % np.uint64(FLAGS)])
                first, last = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
                for place, a, z in zip((at + lo).tolist(), first.tolist(), last.tolist()):
                    for i in range(a, z):
                        out[int(items[i])].add(place - int(offsets[i]))
        return out

    def find(self, text: str | None) -> dict[object, tuple[int, int]]:
        """For each item that the text holds within its budget: fewest edits, and where that ends in the normal form."""
        if not self.items:
            return {}
        own, out = normal(text), {}
        for n, starts in self.starts(own).items():
            key, item, k = self.items[n]
            size = len(item)
            exact = min((s for s in starts if s >= 0 and own.startswith(item, s)), default=None)
            if exact is not None:
                out[key] = min(out.get(key, (k + 1, 0)), (0, exact + size))
                continue
            windows: list[list[int]] = []
            for s in sorted(starts) if k else ():
                lo, hi = max(0, s - k), s + size + k
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                got, to = myers(item, own[lo:hi])
                if got <= k and (got, to + lo) < out.get(key, (k + 1, 0)):
                    out[key] = got, to + lo
        return out


def item_blocks(items: DataFrame, id_col: str = "item_id", block_chars: int = BLOCK_CHARS):
    """The query set in blocks of bounded size, one on the driver at a time. Null and wordless items match nothing."""
    rows = items.select(F.col(id_col).alias("key"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    for i in range(n):
        yield [(r["key"], r["text"]) for r in (rows if n == 1 else rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == i)).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, *, piece: int = PIECE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, ends_at): every item that a document holds within the item's budget.

    Every text is read whole, once a block of items. Null and empty texts hold nothing; rows that repeat give
    repeated pairs; items that share an id (or have none) are one item with several texts; null ids are kept; an empty table on either side gives no rows; other columns are ignored.
    """
    spark, kind, item_kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out, item_type = None, to_arrow_type(items.schema["item_id"].dataType)
    for block in item_blocks(items, block_chars=block_chars):
        held = spark.sparkContext.broadcast(Matcher(block, piece))  # of at most block_chars letters, and 16 bytes a piece

        def run(batches, held=held):
            find = held.value.find
            for b in batches:
                got = [(doc, key, *x) for doc, text in zip(b["doc_id"].to_pylist(), b["text"]) for key, x in sorted(find(text.as_py()).items(), key=lambda y: (y[0] is None, y[0] if y[0] is not None else 0))]
                if got:
                    cols = list(zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], b["doc_id"].type), pa.array(cols[1], item_type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["doc_id", "item_id", "edits", "ends_at"])

        part = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id {kind}, item_id {item_kind}, edits int, ends_at long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, *, piece: int = PIECE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold an item, all columns as they were."""
    for block in item_blocks(items, block_chars=block_chars):
        held = docs.sparkSession.sparkContext.broadcast(Matcher(block, piece))

        def run(batches, held=held):
            for b in batches:
                yield b.filter(pa.array(np.array([not held.value.find(x.as_py()) for x in b["text"]], bool)))

        docs = docs.mapInArrow(lean(run, 512), docs.schema)
    return docs


def op5_pigeonhole(spark, sf_dir):
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_pigeonhole": op5_pigeonhole}
SQL: dict[str, str] = {}
