"""Seekable Zstandard bundles of WARC records.

Records are grouped into independent frames; a seek table in a skippable frame ends each bundle (the public
seekable format). An index maps each record to its bundle, frame and offset in the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifstream.llm.common import lean, materialize, new_path

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, ENTRY, FOOTER = 0x184D2A5E, 0x8F92EAB1, struct.Struct("<II"), struct.Struct("<IBI")
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 64 << 20, 3
MAX_TASKS = 8192
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> bytes:
    return value.replace("\r", "%0D").replace("\n", "%0A").encode()


def make_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A WARC/1.1 response, or a revisit (headers only) if it refers to another page's record."""
    block = HTTP + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", url))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    return b"WARC/1.1\r\n" + b"".join(k.encode() + b": " + _line(v) + b"\r\n" for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    n = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + n]
    return head, block[block.index(b"\r\n\r\n") + 4 :], end + 4 + n + 4


class BundleWriter:
    """Collects records; ``close`` appends the seek table and puts the file in its place in one step."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES):
        import zstandard
        from pyarrow import fs

        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.name, self.root, self.frame_bytes = f"bundle-{uuid.uuid4().hex}.warc.zst", root, frame_bytes
        self.out, self.zip = self.files.open_output_stream(f"{root}/.{self.name}", compression=None), zstandard.ZstdCompressor(level=LEVEL)
        self.frame, self.table, self.size = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset in it."""
        if self.frame and len(self.frame) + len(record) > self.frame_bytes:
            self.flush()
        where = len(self.table), len(self.frame)
        self.frame += record
        self.size += len(record)
        return where

    def flush(self) -> None:
        if self.frame:
            data = self.zip.compress(bytes(self.frame))
            self.out.write(data)
            self.table.append((len(data), len(self.frame)))
            self.frame = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(ENTRY.pack(*x) for x in self.table) + FOOTER.pack(len(self.table), 0, SEEKABLE)
        self.out.write(ENTRY.pack(SKIPPABLE, len(table)) + table)
        self.out.close()
        self.files.move(f"{self.root}/.{self.name}", f"{self.root}/{self.name}")


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(name)
        end = self.file.size()
        n, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(ENTRY.size * n, end - FOOTER.size - ENTRY.size * n)
        self.sizes, self.starts, at = [], [], 0
        for small, large in ENTRY.iter_unpack(table):
            self.starts.append(at)
            self.sizes.append((small, large))
            at += small

    def frame(self, i: int) -> bytes:
        import zstandard

        small, large = self.sizes[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(small, self.starts[i]), max_output_size=max(1, large))

    def close(self) -> None:
        self.file.close()

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(frame), offset)[:2]


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to. Only payloads that occur twice are joined back, by digest; the smallest id is
    summed before the shuffle, and adaptive execution splits a payload of very many pages."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    same = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(same, "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, *, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all pages under ``folder``; the index (page_id, bundle, frame, offset, length), kept in the shared folder.

    A task names its bundles anew on each attempt and the index names those of the attempt that counted, so a lost
    or repeated task leaves at most files that nothing refers to. Null html is an empty payload; a row that repeats
    both id and payload of the first is a response too; null ids are kept as null; an empty table gives no bundle.
    """

    def run(batches):
        writer = None
        for b in batches:
            out = []
            for page, url, payload, refers in zip(*(b[c] for c in ("page_id", "url", "payload", "refers_to"))):
                writer = writer or BundleWriter(folder, frame_bytes)
                record = make_record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py())
                out.append((page.as_py(), writer.name, *writer.add(record), len(record)))
                if writer.size >= bundle_bytes:
                    writer.close()
                    writer = None
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b["page_id"].type), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["page_id", "bundle", "frame", "offset", "length"])
        if writer:
            writer.close()

    kind = pages.schema["page_id"].dataType.simpleString()
    return materialize(mark_revisits(pages).mapInArrow(lean(run, 512), f"page_id {kind}, bundle string, frame long, offset long, length long"), "warc-index")


def read_bundles(index: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """The record of every row of ``index``, read at its frame and offset: each bundle is opened and each frame unpacked once.

    What a bundle's rows name is at most what was written to it, some ``bundle_bytes``. A record that is not the one
    its row names, or whose payload differs from its digest, is an error.
    """
    to = int if kind in ("bigint", "int", "smallint", "tinyint") else str

    def run(batches):
        for b in batches:
            for name, places in zip(b["bundle"].to_pylist(), b["places"]):
                reader, at, data, out = BundleReader(f"{folder}/{name}"), None, b"", []
                for frame, offset, page in ((x["frame"], x["offset"], x["page_id"]) for x in places.as_py()):
                    if frame != at:
                        at, data = frame, reader.frame(frame)
                    head, payload, _ = parse_record(data, offset)
                    own, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                    if own != (None if page is None else str(page)):
                        raise ValueError(f"{name}, frame {frame}, offset {offset}: page {own} instead of {page}")
                    if head["WARC-Type"] == "response" and f"sha1:{digest(payload)}" != head["WARC-Payload-Digest"]:
                        raise ValueError(f"{name}, frame {frame}, offset {offset}: the payload differs from its digest")
                    size = len(payload) if refers is None else int(head["X-Payload-Length"])
                    out.append((None if own is None else to(own), size, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], None if refers is None else to(refers)))
                reader.close()
                cols, kinds = list(zip(*out)), [pa.int64() if to is int else pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64() if to is int else pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    own = "long" if to is int else "string"
    n = index.select("bundle").distinct().count()  # a task for each bundle, as long as there are not too many
    bundles = index.repartition(max(1, min(n, MAX_TASKS)), "bundle").groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset", "page_id"))).alias("places"))
    return bundles.mapInArrow(lean(run, 1), f"page_id {own}, payload_bytes long, payload_digest string, record_type string, refers_to {own}")


def follow_revisits(records: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """(page_id, refers_to, payload_digest) of the revisits among ``records``, with the digest of the response that each refers to, read from the bundles."""
    asked = records.filter("record_type = 'revisit'").select("page_id", "refers_to")
    wanted = index.join(asked.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
    found = read_bundles(wanted, folder, index.schema["page_id"].dataType.simpleString()).filter("record_type = 'response'")
    return asked.join(found.select(F.col("page_id").alias("refers_to"), "payload_digest").distinct(), "refers_to", "left").select("page_id", "refers_to", "payload_digest")


def op8_seekable(spark, sf_dir):
    folder = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_bundles(write_bundles(pages, folder), folder)


def _sql() -> str:
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n[{g}] >> {b}) % 32 + 1, 1)" for g in range(1, 9) for b in (15, 10, 5, 0))
    groups = ", ".join(f"('0x' || substr(h, {5 * g + 1}, 5))::INT" for g in range(8))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
        g AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, first, [{groups}] AS n FROM p)
        SELECT page_id, payload_bytes, {digits} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM g"""


QUERIES = {"op8_seekable": op8_seekable}
SQL = {"op8_seekable": _sql()}
