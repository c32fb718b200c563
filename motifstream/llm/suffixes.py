"""Removal of byte strings that occurred earlier, by bucket-pointer refinement.

Texts are kept in blocks. The suffixes that matter are put into initial buckets by a q-gram (the anchor of their
first ``length`` bytes); buckets that only one place of the corpus is in are dropped. The others are refined by
the bucket identifiers of later offsets: identifiers of 24 bytes make those of 48, these make those of 96 and of
``length``, and after each step only buckets with two places or more go on. All but the earliest place of a final
bucket are removed. Buckets of very many places are dealt by their final identifier instead, which splits them.
Identifiers are 64-bit names: strings that meet in a task are compared byte by byte before one counts as the other,
those that do not must agree in a second, independent hash of all their bytes too.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from motifstream.llm.anchors import GRAM, _mix, anchors, grams
from motifstream.llm.common import documents, free_name, lean, materialize

LENGTH = 100
BLOCK_BYTES, CHUNK_BYTES, BIN_BYTES = 4 << 20, 1 << 18, 8 << 20
HOT = 2000  # places of different surroundings from which a bucket is dealt out
AT_ONCE = 1 << 17  # strings that are refined at a time; a bucket that is not dealt out may be more
NO_ID = np.iinfo(np.int64).max
_M = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
ENTRY = np.dtype([("name", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("idx", "<u4"), ("start", "<u4"), ("n", "<u4"), ("at", "<i8"), ("check", "<u8")])
WINDOW = np.dtype([("name", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("idx", "<u4"), ("start", "<u4")])
SPAN = np.dtype([("idx", "<u4"), ("start", "<u4"), ("end", "<u4")])


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a string from those of its beginning and of a later offset."""
    return _mix(_mix(a) * _M[0] + b * _M[1])


class Pointers:
    """Bucket identifiers of all places of some bytes, for growing depths; each depth reuses the one before."""

    def __init__(self, data: bytes):
        pad = data + bytes(LENGTH)
        self.depth, self.names = GRAM, grams(pad)
        self.first = self.names

    def grow(self, to: int) -> None:
        step = to - self.depth
        later = self.names if step >= self.depth else self.first
        at = step if step >= self.depth else to - GRAM
        n = min(len(self.names), len(later) - at)
        self.names = join_names(self.names[:n], later[at : at + n])
        self.depth = to


def _slices(n: np.ndarray, whole: np.ndarray | None = None, most: int | None = None):
    """(first, end) of stretches of about ``most`` strings, ``n`` an entry; entries that are equal in the sorted ``whole`` stay together."""
    total, cuts = np.cumsum(n.astype(np.int64)), [0]
    may = np.arange(1, len(n) + 1) if whole is None else np.r_[np.flatnonzero(whole[1:] != whole[:-1]) + 1, len(whole)]
    while len(n) and cuts[-1] < len(n):
        done = total[cuts[-1] - 1] if cuts[-1] else 0
        to = np.searchsorted(total, done + (most or AT_ONCE), "right")
        i = np.searchsorted(may, max(to, cuts[-1] + 1), "right") - 1
        cuts.append(int(may[i] if i >= 0 and may[i] > cuts[-1] else may[i + 1]))
    return zip(cuts, cuts[1:])


def depths(length: int = LENGTH) -> list[int]:
    out, d = [], GRAM
    while d * 2 < length:
        d *= 2
        out.append(d)
    while d + GRAM < length:
        d += GRAM
        out.append(d)
    return [*out, length]


def repeated(bucket: np.ndarray) -> np.ndarray:
    """Which places share their bucket with another one."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    same = np.zeros(len(b) + 1, bool)
    same[1:-1] = b[1:] == b[:-1]
    out = np.empty(len(b), bool)
    out[order] = same[1:] | same[:-1]
    return out


def merge(spans: np.ndarray) -> np.ndarray:
    """Spans of SPAN as maximal runs in order."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["idx"]))]
    base = spans["idx"].astype(np.int64) << 33
    start, reach = base + spans["start"], np.maximum.accumulate(base + spans["end"])
    fresh = np.r_[True, start[1:] > reach[:-1]]
    out = np.empty(int(fresh.sum()), SPAN)
    out["idx"], out["start"] = spans["idx"][fresh], spans["start"][fresh]
    out["end"] = (reach[np.r_[np.flatnonzero(fresh)[1:] - 1, len(spans) - 1]] & ((1 << 33) - 1)).astype("<u4")
    return out


def not_first(group: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows are not the first of their group; both as key columns, the most important first."""
    by = np.lexsort((*order[::-1], *group[::-1]))
    out = np.zeros(len(by), bool)
    if len(by):
        same = np.ones(len(by) - 1, bool)
        for g in group:
            same &= g[by][1:] == g[by][:-1]
        out[by[1:]] = same
    return out


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, keep_rows: bool = False) -> DataFrame:
    """(tag, ids, sizes, texts, n_bytes, rest): rows of ``docs`` gathered to blocks, texts as compressed UTF-8; in the shared folder.

    With ``keep_rows``, ``rest`` holds the rows' other columns as an Arrow stream.
    """
    names = [c for c in docs.columns if c != "text"] if keep_rows else []
    id_name, text_name = free_name("_id", docs.columns), free_name("_text", docs.columns)

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        zip_, tag = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        ids, texts, parts, size = [], [], [], 0

        def block():
            rest = None
            if names:
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, parts[0].schema) as w:
                    for x in parts:
                        w.write_batch(x)
                rest = zip_.compress(out.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([tag], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([zip_.compress(b"".join(texts))], pa.binary()), pa.array([size], pa.int64()), pa.array([rest], pa.binary())], ["tag", "ids", "sizes", "texts", "n_bytes", "rest"])

        for b in batches:
            row, done = b.select(names) if names else None, 0
            for i, (doc, text) in enumerate(zip(b[id_name].to_pylist(), b[text_name]), 1):
                t = (text.as_py() or "").encode()
                ids.append(doc)
                texts.append(t)
                size += len(t)
                if size >= block_bytes or len(ids) >= 1 << 16:
                    if names:
                        parts.append(row.slice(done, i - done))
                    yield block()
                    tag, ids, texts, parts, size, done = tag + 1, [], [], [], 0, i
            if names and done < b.num_rows:
                parts.append(row.slice(done))
        if ids:
            yield block()

    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id must be of whole numbers, not {docs.schema['doc_id'].dataType.simpleString()}")
    rows = docs.select(*(docs[c] for c in names), F.col("doc_id").cast("long").alias(id_name), F.col("text").cast("string").alias(text_name))
    return materialize(rows.mapInArrow(lean(run), "tag long, ids array<long>, sizes array<long>, texts binary, n_bytes long, rest binary"), "text-blocks")


def _rows(batches, *names: str):
    """The named values of each row, one row at a time: blocks are large."""
    for b in batches:
        for row in zip(*(b[c] for c in names)):
            yield tuple(x.as_py() for x in row)


def _texts(sizes, packed: bytes) -> list[bytes]:
    import zstandard

    total = int(sum(sizes))
    data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, total)) if total else b""
    ends = np.cumsum([0, *sizes])
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _places(texts: list[bytes], length: int):
    """Chunk by chunk: (text, name, content, start, n) of the anchors of a block.

    ``content`` names all bytes of an anchor's strings: the identifiers of its later q-grams, joined.
    """
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_BYTES):
            size += len(texts[hi])
            hi += 1
        part = texts[lo:hi]
        text, name, start, n = anchors(part, length)
        if len(text):
            base = np.cumsum([0, *map(len, part)])[text] + start
            own, size = grams(b"".join(part)), n + (length - 1)
            content = n.astype(np.uint64)
            for at in range(0, int(size.max()) - GRAM + 1, GRAM):
                content = np.where(at + GRAM <= size, join_names(content, own[np.minimum(base + at, len(own) - 1)]), content)
            content = join_names(content, own[base + size - GRAM])
            yield text + lo, name.view(np.uint64), content, start, n
        lo = hi


def _block_entries(ids: list, tag: int, texts: list[bytes], length: int) -> tuple[np.ndarray, bytes]:
    """The anchors of a block as ENTRY rows, and all its bytes; ``at`` is a string run's place in these."""
    rows, offset, known = [], np.cumsum([0, *map(len, texts)]), np.array([NO_ID if x is None else x for x in ids], np.int64)
    for text, name, content, start, n in _places(texts, length):
        e = np.empty(len(text), ENTRY)
        e["name"], e["content"], e["doc"], e["tag"], e["idx"], e["start"], e["n"], e["at"] = name, content, known[text], tag, text, start, n, offset[text] + start
        e["check"] = 0
        rows.append(e)
    return (np.concatenate(rows) if rows else np.empty(0, ENTRY)), b"".join(texts)


def checks(data: bytes, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A second hash of the bytes from each start, so many of them."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(data[a : a + n]) for a, n in zip(starts.tolist(), size.tolist())), np.uint64, len(starts))


def _split_late(e: np.ndarray, data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that are the first of their bytes among ``e``, whose bytes are in ``data``, and the spans of the others."""
    order = np.lexsort((e["start"], e["idx"], e["tag"], e["doc"], e["content"], e["name"]))
    e = e[order]
    late = np.zeros(len(e), bool)
    late[1:] = (e["name"][1:] == e["name"][:-1]) & (e["content"][1:] == e["content"][:-1])
    size, first = (e["n"] + (length - 1)).tolist(), None
    at = e["at"].tolist()
    for i in np.flatnonzero(late).tolist():
        first = i - 1 if not late[i - 1] else first
        if data[at[i] : at[i] + size[i]] != data[at[first] : at[first] + size[first]]:
            late[i], first = False, i  # other bytes of the same name
    gone = e[late]
    spans = np.empty(len(gone), SPAN)
    spans["idx"], spans["start"], spans["end"] = gone["idx"], gone["start"], gone["start"] + gone["n"] + (length - 1)
    return e[~late], spans


def by_bytes(bucket: np.ndarray, data: bytes, places: np.ndarray, length: int) -> np.ndarray:
    """``bucket`` as it is if all of its strings, those of ``length`` bytes at ``places``, are equal; else buckets by the bytes themselves."""
    if not len(bucket):
        return bucket
    all_ = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    order = np.argsort(bucket, kind="stable")
    for lo in range(0, len(order) - 1, 1 << 15):
        own = order[lo : lo + (1 << 15) + 1]
        same = bucket[own[1:]] == bucket[own[:-1]]
        one, other = all_[places[own[1:][same]]], all_[places[own[:-1][same]]]
        if not np.array_equal(one, other):
            strings = [data[p : p + length] for p in places.tolist()]
            names = {x: i for i, x in enumerate(set(strings))}
            return np.array([names[x] for x in strings], np.uint64)
    return bucket


def _runs(values: np.ndarray):
    """(value, first, end) of the runs of a sorted array."""
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
    return zip(values[edges], edges, np.r_[edges[1:], len(values)])


def _snippets(e: np.ndarray, data: bytes, length: int) -> bytes:
    return b"".join([data[a : a + n] for a, n in zip(e["at"].tolist(), (e["n"] + (length - 1)).tolist())])


def _windows(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each entry: the entry, and the string's place in it."""
    n = e["n"].astype(np.int64)
    of = np.repeat(np.arange(len(e)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def refine(e: np.ndarray, data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(entry, place) of all strings that an earlier entry holds too. ``data``: the entries' bytes, one after the other."""
    size = e["n"].astype(np.int64) + (length - 1)
    base = np.cumsum(size) - size
    of, at = _windows(e)
    bucket = np.zeros(len(of), np.uint64)
    pointers = Pointers(data)
    live = np.arange(len(of))
    for depth in depths(length):
        pointers.grow(depth)
        # places of one anchor only meet in its initial bucket
        bucket = join_names(e["name"][of[live]], pointers.names[base[of[live]] + at[live]])
        live = live[repeated(bucket)]
    if not len(live):
        return of[live], at[live]
    own = of[live]
    bucket = by_bytes(join_names(e["name"][own], pointers.names[base[own] + at[live]]), data, base[own] + at[live], length)
    late = not_first((bucket,), (e["doc"][own], e["tag"][own], e["idx"][own], e["start"][own] + at[live]))
    return own[late], at[live][late]


def count_buckets(blocks: DataFrame, n_bins: int, length: int, hot: int) -> DataFrame:
    """(tag, warm, hots): for each block the names of its buckets that more than one surrounding in the corpus is in.

    A block sends each name once, with the number of its surroundings there, so a bucket costs a number a block.
    """

    def names(batches):
        for tag, sizes, packed in _rows(batches, "tag", "sizes", "texts"):
            texts = _texts(sizes, packed)
            pairs = [(name, content) for _, name, content, _, _ in _places(texts, length)]
            if not pairs:
                continue
            name, content = (np.concatenate(x) for x in zip(*pairs))
            order = np.lexsort((content, name))
            name, content = name[order], content[order]
            fresh = np.r_[True, (name[1:] != name[:-1]) | (content[1:] != content[:-1])]
            found, n = np.unique(name[fresh], return_counts=True)
            bins = (_mix(found) % np.uint64(n_bins)).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            found, n = found[order], np.minimum(n[order], 255).astype(np.uint8)
            rows = [(x, found[a:z].tobytes(), n[a:z].tobytes()) for x, a, z in _runs(bins[order])]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(cols[0])), pa.array([tag] * len(rows), pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["bin", "tag", "names", "n"])

    def count(batches):
        by: dict[int, list] = {}
        for x, *row in _rows(batches, "bin", "tag", "names", "n"):
            by.setdefault(x, []).append(row)
        while by:
            _, rows = by.popitem()
            found = [np.frombuffer(r[1], np.uint64) for r in rows]
            name, inverse = np.unique(np.concatenate(found), return_inverse=True)
            total = np.bincount(inverse, np.frombuffer(b"".join(r[2] for r in rows), np.uint8), len(name))[inverse]
            ends = np.cumsum([0, *map(len, found)])
            out = [(r[0], f[(t > 1) & (t <= hot)].tobytes(), f[t > hot].tobytes()) for r, f, t in ((r, f, total[a:z]) for r, f, a, z in zip(rows, found, ends, ends[1:]))]
            out = [x for x in out if x[1] or x[2]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["tag", "warm", "hots"])

    sent = blocks.mapInArrow(lean(names), "bin long, tag long, names binary, n binary").repartition(n_bins, "bin")
    return sent.mapInArrow(lean(count), "tag long, warm binary, hots binary")


def late_spans(blocks: DataFrame, buckets: DataFrame, n_bins: int, length: int) -> DataFrame:
    """(tag, spans): what later places of equal strings cover, from all blocks and bins."""

    def place(batches):
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for tag, ids, sizes, packed, warm, hots in _rows(batches, "tag", "ids", "sizes", "texts", "warm", "hots"):
            e, data = _block_entries(ids, tag, _texts(sizes, packed), length)
            e, spans = _split_late(e, data, length)
            rows = []
            warm, hots = (np.frombuffer(b"".join(x or ()), np.uint64) for x in (warm, hots))
            own = e[np.isin(e["name"], warm)]
            own["check"] = checks(data, own["at"], own["n"].astype(np.int64) + (length - 1))
            bins = (_mix(own["name"]) % np.uint64(n_bins)).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            own = own[order]
            for x, a, z in _runs(bins[order]):
                rows.append((x, 1, zip_.compress(own[a:z].tobytes()), zip_.compress(_snippets(own[a:z], data, length)), int(z - a)))
            hots = e[np.isin(e["name"], hots)]
            for lo, hi in _slices(hots["n"]):
                hot = hots[lo:hi]
                of, at = _windows(hot)
                size = hot["n"].astype(np.int64) + (length - 1)
                snippets = _snippets(hot, data, length)
                pointers = Pointers(snippets)
                for d in depths(length):
                    pointers.grow(d)
                w = np.empty(len(of), WINDOW)
                places = (np.cumsum(size) - size)[of] + at
                w["name"], w["check"] = join_names(hot["name"][of], pointers.names[places]), checks(snippets, places, np.full(len(places), length))
                w["doc"], w["tag"], w["idx"], w["start"] = hot["doc"][of], tag, hot["idx"][of], hot["start"][of] + at
                late = not_first((w["name"], w["check"]), (w["doc"], w["tag"], w["idx"], w["start"]))
                more = np.empty(int(late.sum()), SPAN)
                more["idx"], more["start"], more["end"] = w["idx"][late], w["start"][late], w["start"][late] + length
                spans, w = np.concatenate([spans, merge(more)]), w[~late]
                bins = (_mix(w["name"]) % np.uint64(n_bins)).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                w = w[order]
                rows += [(x, 2, zip_.compress(w[a:z].tobytes()), None, int(z - a)) for x, a, z in _runs(bins[order])]
            if len(spans):
                rows.append((tag % n_bins, 0, merge(spans).tobytes(), None, 0))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cols[0], np.int64)), pa.array(cols[1], pa.int32()), pa.array([tag] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:4]), pa.array(cols[4], pa.int64())], ["bin", "kind", "tag", "data", "texts", "n"])

    def meet(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        by: dict[int, list] = {}
        for x, kind, tag, data, text, n in _rows(batches, "bin", "kind", "tag", "data", "texts", "n"):
            if kind:
                by.setdefault(x, []).append((kind, data, text, n))
            else:
                yield pa.RecordBatch.from_arrays([pa.array([tag], pa.int64()), pa.array([data], pa.binary())], ["tag", "spans"])
        while by:
            _, rows = by.popitem()
            found = []  # (tag, spans)
            parts, windows = [x[1:] for x in rows if x[0] == 1], [x[1:] for x in rows if x[0] == 2]
            if parts:
                e = np.concatenate([np.frombuffer(unzip.decompress(data), ENTRY, n) for data, _, n in parts])
                part = np.repeat(np.arange(len(parts)), [n for *_, n in parts])
                ends = np.cumsum(e["n"].astype(np.int64) + (length - 1))
                e["at"] = ends - (e["n"].astype(np.int64) + (length - 1))
                e["at"] -= e["at"][np.searchsorted(part, part)]
                late = not_first((e["name"], e["content"], e["check"]), (e["doc"], e["tag"], e["idx"], e["start"]))
                gone = e[late]
                found.append((gone["tag"], gone["idx"], gone["start"], gone["start"] + gone["n"] + (length - 1)))
                e, part = e[~late], part[~late]
                same = repeated(e["name"])
                e, part = e[same], part[same]
                # only bytes of entries that are left are kept
                text = b"".join([_snippets(e[a:z], unzip.decompress(parts[i][1]), length) for i, a, z in _runs(part)])
                size = e["n"].astype(np.int64) + (length - 1)
                e["at"] = np.cumsum(size) - size
                e = e[np.argsort(e["name"], kind="stable")]
                for lo, hi in _slices(e["n"], e["name"]):
                    own = e[lo:hi]
                    of, at = refine(own, _snippets(own, text, length), length)
                    found.append((own["tag"][of], own["idx"][of], own["start"][of] + at, own["start"][of] + at + length))
            if windows:
                w = np.concatenate([np.frombuffer(unzip.decompress(data), WINDOW, n) for data, _, n in windows])
                w = w[not_first((w["name"], w["check"]), (w["doc"], w["tag"], w["idx"], w["start"]))]
                found.append((w["tag"], w["idx"], w["start"], w["start"] + length))
            tags = np.concatenate([f[0] for f in found])
            spans = np.empty(len(tags), SPAN)
            for i, c in enumerate(("idx", "start", "end"), 1):
                spans[c] = np.concatenate([f[i] for f in found])
            order = np.argsort(tags, kind="stable")
            spans = spans[order]
            out = [(int(t), merge(spans[a:z]).tobytes()) for t, a, z in _runs(tags[order])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary()))], ["tag", "spans"])

    known = buckets.groupBy("tag").agg(F.collect_list("warm").alias("warm"), F.collect_list("hots").alias("hots"))
    sent = blocks.join(known, "tag", "left").select("tag", "ids", "sizes", "texts", "warm", "hots").mapInArrow(lean(place), "bin long, kind int, tag long, data binary, texts binary, n long")
    return sent.repartition(n_bins, "bin").mapInArrow(lean(meet), "tag long, spans binary")


def _remove(docs: DataFrame, cut, schema, columns: list[str], *, length: int, block_bytes: int, bin_bytes: int, hot: int, keep_rows: bool) -> DataFrame:
    blocks = make_blocks(docs, block_bytes, keep_rows)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_bins = max(8, math.ceil(total / bin_bytes))
    buckets = materialize(count_buckets(blocks.drop("rest"), n_bins, length, hot), "buckets")
    spans = late_spans(blocks.drop("rest"), buckets, n_bins, length).groupBy("tag").agg(F.collect_list("spans").alias("spans"))
    return blocks.join(spans, "tag", "left").select(*columns).mapInArrow(lean(cut), schema)


def _left(texts: list[bytes], found: list[bytes] | None):
    """Each text less its spans, and the number of these."""
    gone = merge(np.frombuffer(b"".join(found or ()), SPAN))
    edges = np.searchsorted(gone["idx"], np.arange(len(texts) + 1))
    for text, lo, hi in zip(texts, edges, edges[1:]):
        own, left, at = gone[lo:hi], [], 0
        for a, z in zip(own["start"].tolist(), own["end"].tolist()):
            left.append(text[at:a])
            at = z
        yield b"".join([*left, text[at:]]), len(own)


def removals(docs: DataFrame, *, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bin_bytes: int = BIN_BYTES, hot: int = HOT) -> DataFrame:
    """What earlier copies take from each document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row.

    Null texts are empty; texts under ``length`` bytes lose nothing; rows without an id come after all others; of rows
    that share an id each is a document of its own, in the order of the scan; an empty table gives no rows; other
    columns are ignored; ids that are not whole numbers are a TypeError. A block is at most ``block_bytes`` and one text.
    """

    def cut(batches):
        for ids, sizes, packed, found in _rows(batches, "ids", "sizes", "texts", "spans"):
            if ids:
                out = [(doc, n, n - len(left), spans, hashlib.sha256(left).hexdigest()) for doc, n, (left, spans) in zip(ids, sizes, _left(_texts(sizes, packed), found))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _remove(docs, cut, schema, ["ids", "sizes", "texts", "spans"], length=length, block_bytes=block_bytes, bin_bytes=bin_bytes, hot=hot, keep_rows=False)


def cut_repeats(docs: DataFrame, *, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bin_bytes: int = BIN_BYTES, hot: int = HOT) -> DataFrame:
    """``docs`` with ``text`` less what occurred earlier and ``n_chars``, if there, as its new length; other columns as they were.

    Bytes of a character that was cut in two are left out. Null texts stay null.
    """
    names, null_name = docs.columns, free_name("_null", docs.columns)

    def cut(batches):
        import zstandard

        for sizes, packed, rest, found in _rows(batches, "sizes", "texts", "rest", "spans"):
            rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(rest)).read_all().combine_chunks()
            texts = [x.decode("utf-8", "ignore") for x, _ in _left(_texts(sizes, packed), found)]
            new = {"text": pa.array([None if z else x for x, z in zip(texts, rows[null_name].to_pylist())], pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([len(x) for x in texts]).cast(rows["n_chars"].type)
            cols = [new[c] if c in new else rows[c].combine_chunks() for c in names]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in cols]
            yield pa.RecordBatch.from_arrays(cols, names)

    flagged = docs.withColumn(null_name, F.col("text").isNull())
    return _remove(flagged, cut, docs.schema, ["sizes", "texts", "rest", "spans"], length=length, block_bytes=block_bytes, bin_bytes=bin_bytes, hot=hot, keep_rows=True)


def op10_bucket_pointers(spark, sf_dir):
    return removals(documents(spark, sf_dir))


QUERIES = {"op10_bucket_pointers": op10_bucket_pointers}
SQL: dict[str, str] = {}
