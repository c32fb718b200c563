"""Quality rules: per-text counts, then lines that too many documents of a host share.

Normalised lines are hashed; the documents that hold a line are counted per host; lines above both limits are
removed, and documents depleted by that are rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifstream.llm.common import ascii_lower, documents, free_name, materialize, salted_join

MAX_DOCS, MAX_PERCENT = 20, 2  # a line goes if more documents than both hold it, of its host
MIN_WORDS, LEFT_PERCENT = 20, 50  # a document needs so many words after that, and so much of what it had
WINDOW = 8
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeat_words(words: list[str]) -> int:
    """Words inside windows of eight words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    # names of 2, 4 and 8 words, each from a pair of shorter names: exact, as names are ranks
    for step in (1, 2, 4):
        pair = at[:-step] * (at.max() + 1) + at[step:]
        at = np.unique(pair, return_inverse=True)[1]
    again = np.bincount(at)[at] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORDS(text)
    lines = [x for x in text.split("\n") if _WORDS(x)]
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat_words(words)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and the five counts, a row for each input row."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = [measure(x.as_py()) for x in part["text"]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["th"], *(pa.array(c, pa.int64()) for c in zip(*found))], ["doc_id", "th", *NAMES])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in NAMES)
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, {kinds}")


def normal_lines(text: Column) -> Column:
    """The lines of a text: white space runs as one space, trimmed, A-Z lower-cased; empty ones stay as ''."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(ascii_lower(x), r"[\x20\x09-\x0D]+", " ")))


def _document(docs: DataFrame) -> Column:
    """Tells rows without an id apart: each is a document of its own."""
    return F.when(docs["doc_id"].isNull(), F.monotonically_increasing_id())


def doc_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, th, host, pos, line, n): hash and words of each line with a word; ``row`` numbers rows without an id."""
    lines = docs.select("doc_id", _document(docs).alias("row"), F.xxhash64("text").alias("th"), F.col("source").alias("host"), F.posexplode(normal_lines(F.col("text"))).alias("pos", "x"))
    words = F.length("x") - F.length(F.replace("x", F.lit(" "), F.lit(""))) + 1
    return lines.filter(F.col("x") != "").select("doc_id", "row", "th", "host", "pos", F.xxhash64("x").alias("line"), words.cast("long").alias("n"))


def shared_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of ``doc_lines`` whose line more than ``max_docs`` rows of its host hold, in the shared folder.

    Counts of rows are summed before they are shuffled, so a line of a third of all documents costs a row a task. They
    are at least the counts of documents, so every frequent line is among these few.
    """
    once = F.array_distinct(F.transform(F.filter(normal_lines(F.col("text")), lambda x: x != ""), lambda x: F.xxhash64(x)))
    held = docs.select(F.col("source").alias("h"), F.explode(once).alias("l")).groupBy("h", "l").agg(F.count("*").alias("rows")).filter(F.col("rows") > max_docs).drop("rows")
    return materialize(salted_join(doc_lines(docs), held, {"host": "h", "line": "l"}), "shared-lines")


def frequent_lines(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_percent: int = MAX_PERCENT, shared: DataFrame | None = None) -> DataFrame:
    """(host, line, n_docs): lines above both limits.

    Distinct documents are counted: one that repeats a line, or is given in several rows, counts once. As each such
    line is in over ``max_percent`` of a host's documents, a host has at most 100 / ``max_percent`` times its lines per
    document of them.
    """
    shared = shared if shared is not None else shared_lines(docs, max_docs)
    held = shared.select("host", "line", "doc_id", "row").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    totals = docs.select(F.col("source").alias("h"), "doc_id", _document(docs).alias("row")).distinct().groupBy("h").agg(F.count("*").alias("host_docs"))
    many = held.filter(F.col("n_docs") > max_docs)
    return many.join(totals, many["host"].eqNullSafe(totals["h"])).filter(F.col("n_docs") * 100 > F.col("host_docs") * max_percent).select("host", "line", "n_docs")


def remove_frequent_lines(shared: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, th, n_removed_lines, n_removed_words) of documents that hold frequent lines."""
    own = salted_join(shared, frequent.select(F.col("host").alias("h"), F.col("line").alias("l")), {"host": "h", "line": "l"})
    hit = own.groupBy("doc_id", "th", "host", "pos").agg(F.max("n").alias("n"))
    gone = hit.groupBy("doc_id", "th", "host").agg(F.count("*").alias("lines"), F.sum("n").alias("words"))
    return gone.groupBy("doc_id", "th").agg(F.max("lines").alias("n_removed_lines"), F.max("words").alias("n_removed_words"))


def clean_texts(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its frequent lines: the operator's real output."""
    gone, host = free_name("_gone", docs.columns), free_name("_host", docs.columns)
    per_host = frequent.groupBy("host").agg(F.collect_set("line").alias(gone)).withColumnRenamed("host", host)  # bounded, see frequent_lines
    both = salted_join(docs, per_host, {"source": host}, "left")
    keep = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.coalesce(gone, F.array().cast("array<bigint>")), F.xxhash64(F.trim(F.regexp_replace(ascii_lower(x), r"[\x20\x09-\x0D]+", " ")))))
    return both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))).drop(gone)


def judge_quality(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_percent: int = MAX_PERCENT, min_words: int = MIN_WORDS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """The counts of each document, what line removal takes from it, and whether it is kept.

    Null texts count zeros and fail; null hosts are one host; rows that share an id are one document to the counts of
    documents, rows without an id are one each; rows that share id and text get equal results; an empty table gives no
    rows; other columns are ignored.
    """
    shared = shared_lines(docs, max_docs)
    gone = remove_frequent_lines(shared, frequent_lines(docs, max_docs=max_docs, max_percent=max_percent, shared=shared)).withColumnsRenamed({"doc_id": "d", "th": "t"})
    base = base_counts(docs)
    both = base.join(gone, base["doc_id"].eqNullSafe(gone["d"]) & base["th"].eqNullSafe(gone["t"]), "left")
    lines, words = F.coalesce("n_removed_lines", F.lit(0)), F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_words) | (left * 100 < F.col("n_words") * left_percent))
    out = both.select("doc_id", *NAMES, failed.alias("base_failed"), lines.alias("n_removed_lines"), words.alias("n_removed_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def op1_line_frequency(spark, sf_dir):
    return judge_quality(documents(spark, sf_dir))


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    space, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    return rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
        raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM d),
        lined AS (SELECT doc_id, source, x, trim(regexp_replace(translate(x, '{upper}', '{lower}'), '{space}', ' ', 'g')) AS line FROM raw WHERE regexp_matches(x, '{word}')),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM lined GROUP BY 1),
        held AS (SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM lined GROUP BY 1, 2),
        totals AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY 1),
        frequent AS (SELECT source, line FROM held JOIN totals USING (source) WHERE n_docs > {MAX_DOCS} AND n_docs * 100 > host_docs * {MAX_PERCENT}),
        gone AS (SELECT doc_id, count(*) AS n_removed_lines, sum(len(regexp_extract_all(line, '{word}')))::BIGINT AS n_removed_words FROM lined JOIN frequent USING (source, line) GROUP BY 1),
        grams AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
        twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY 1),
        base AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
            coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
            FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id)),
        judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_removed_words,
            NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {MIN_WORDS} OR (n_words - n_removed_words) * 100 < n_words * {LEFT_PERCENT})) AS kept FROM judged"""


QUERIES = {"op1_line_frequency": op1_line_frequency}
SQL = {"op1_line_frequency": _sql()}
