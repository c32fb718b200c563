"""Quality, licences, URLs, sharding, packing and archives against plain versions."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from motifstream.llm import licenses, packing, quality, sharding, urls, warc
from motifstream.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_counts(docs, texts):
    got = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        want = plain_counts(t)
        assert tuple(got[i][c] for c in quality.NAMES) == want, (i, t)
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_repeats_of_words():
    for text in ("a b c d e f g h " * 3, "a " * 9, "a b c d e f g h i", "q " * 7, " ".join("abcdefgh") + " z " + " ".join("abcdefgh")):
        assert quality.repeat_words(text.split()) == plain_counts(text)[4]


def test_frequent_lines_go(frame):
    body = [(i, f"own line number {i} has several words in it {i * i}\nThe SAME line  here\nmore of {i} and its very own words follow so on {i}") for i in range(60)] + [(99, "The same line here\nthe same  LINE here\nshort"), (None, None)]
    d = frame(body).withColumn("source", quality.F.lit("host"))
    freq = quality.frequent_lines(d)
    assert [r["n_docs"] for r in freq.collect()] == [61]
    got = {r["doc_id"]: r for r in quality.judge_quality(d).collect()}
    assert got[5]["n_removed_lines"] == 1 and got[5]["n_removed_words"] == 4 and got[5]["kept"]
    assert got[99]["n_removed_lines"] == 2 and not got[99]["kept"] and got[None]["n_words"] == 0
    out = {r["doc_id"]: r["text"] for r in quality.clean_texts(d, freq).collect()}
    assert out[99] == "short" and "SAME" not in out[3] and out[None] is None


def test_a_document_in_many_rows_counts_once(frame):
    own = lambda i: f"own line number {i} has several words in it {i * i}\nmore of {i} and its very own words follow so on and on {i}"
    again = (99, own(99) + "\nonly this document says so")
    d = frame([(i, own(i)) for i in range(40)] + [again] * 30 + [(None, own(i) + "\nnameless ones say so") for i in range(100, 130)]).withColumn("source", quality.F.lit("host"))
    assert [r["n_docs"] for r in quality.frequent_lines(d).collect()] == [30]
    got = {(r["doc_id"], r["n_removed_lines"], r["n_removed_words"]) for r in quality.judge_quality(d).collect()}
    assert got == {(i, 0, 0) for i in (*range(40), 99)} | {(None, 1, 4)}


def test_empty_tables(frame, spark):
    d = frame([])
    for f in (quality.judge_quality, licenses.scan_licenses, sharding.shuffle_shards, packing.pack):
        assert f(d).collect() == []
    assert sharding.shard_digests(d, new_path(spark, "shards")).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    assert urls.judge_urls(pages).collect() == [] and warc.read_bundles(warc.write_bundles(pages, folder), folder).collect() == []


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 300])
def test_shards(docs, texts, spark, bucket_bytes):
    shards = lambda d, **o: sharding.shard_digests(d, new_path(spark, "shards"), **o).collect()
    rows = shards(docs, bucket_bytes=bucket_bytes)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        t = (dict(texts)[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["grown_shard"] in (r["shard"], 24)
    assert len(rows) == len(texts) and all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(24))
    again = {r["doc_id"]: r["shard"] for r in shards(docs.filter("doc_id % 2 = 0"))}
    assert all(again[r["doc_id"]] == r["shard"] for r in rows if r["doc_id"] in again)
    grown = {r["doc_id"]: r["shard"] for r in shards(docs, n_shards=25)}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in rows)


def test_shards_are_written_in_shuffled_order(docs, texts, spark, tmp_path):
    clash = docs.withColumn("_shard", sharding.F.lit("own"))
    back, shard, slot = sharding.write_shards(clash, str(tmp_path / "out"), n_shards=2)
    assert shard == "_shard_" and set(back.columns) == {*clash.columns, shard, slot}
    rows = back.filter(f"{shard} = 0").orderBy(slot).collect()
    ids = [r["doc_id"] for r in rows]
    assert ids != sorted(ids) and all(dict(texts)[r["doc_id"]] == r["text"] and r["_shard"] == "own" for r in rows)
    # a file holds its records in the order of their slots
    for f in (tmp_path / "out").glob("*/*.parquet"):
        at = [r[slot] for r in spark.read.parquet(str(f)).select(slot).collect()]
        assert at == sorted(at)


def test_buckets_of_a_hot_key_are_memory_sized(frame):
    rows = [(7, "x" * 92)] * 2000 + [(i, "y" * 92) for i in range(1000, 5000)] + [(None, None)]
    made = sharding.scatter(frame(rows), bucket_bytes=5000).select("shard", "bucket", sharding.F.size("records").alias("n")).collect()
    assert sum(r["n"] for r in made) == len(rows) and len({r["bucket"] for r in made}) == len(made)
    assert max(r["n"] for r in made) <= 2 * 50


LICENSED = [
    (0, "Released under the MIT License."), (1, "Apache License\nand more; apache-license!"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "no such thing"), (6, "cc by"), (7, "CC"),
    (8, "This work is licensed under the GNU General Public License, version 3."), (9, "Permission is hereby granted free of charge to any human person obtaining one copy of this software and associated documentation files"),
    (10, "Gnu general Public licensé"), (6, "cc by"), (None, "mit license"),
]


def test_licences(frame):
    rows = licenses.scan_licenses(frame(LICENSED)).collect()
    assert len(rows) == len(LICENSED)
    got = {r["doc_id"]: r for r in rows}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in LICENSED:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for k in range(len(w)) for p, label in licenses.PHRASES if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[2]["labels"] == "cc-by,cc-by-nc" and got[9]["labels"] == "mit" and got[9]["score"] > 0.6 and got[5]["labels"] == "" and got[0]["score"] == 1


def test_licence_spans_are_words_of_templates(frame):
    whole = {i: text for i, (_, text) in enumerate(licenses.TEXTS)}
    cut = whole[5].split()
    rows = [(i, f"some words before {t} and after") for i, t in whole.items()] + [(100, " ".join(cut[: len(cut) // 2])), (101, " ".join(reversed(cut))), (102, " ".join(cut[:40] + ["added", "words"] + cut[40:]))]
    spans = licenses.license_spans(licenses.license_hits(frame(rows))).collect()
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        (own,) = [r for r in spans if r["doc_id"] == i and r["tpl"] == i]
        n = len(text.split(" "))
        assert (own["label"], own["first_word"], own["last_word"], own["covered"]) == (label, 3, 2 + n, 1)
    assert not any(r["tpl"] == 5 for r in spans if r["doc_id"] in (100, 101)) and not any(r["doc_id"] == 101 for r in spans)
    (added,) = [r for r in spans if r["doc_id"] == 102 and r["tpl"] == 5]
    assert added["first_word"] == 0 and added["covered"] == 1


def test_url_rules(spark):
    given = [(1, "http://A.Example.NET/en/x"), (2, "https://example.net/de/"), (3, "http://x.example.com/de/?a"), (4, "http://org/fr/"), (5, "http://aorg/fr/"), (6, "net"), (7, None), (8, "http://net"), (9, "ftp://h.net/#f"), (10, "http://h?x/y"), (1, "http://A.Example.NET/en/x")]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame([(*x, None) for x in given], "page_id long, url string, html string")).collect() if r["page_id"] not in (5, 6, 7, 8, 10))
    assert got == [(1, "a.example.net", "/en/x", "example.net/en/", "allow")] * 2 + [(2, "example.net", "/de/", "net/", "block"), (3, "x.example.com", "/de/", "example.com/de/", "block"), (4, "org", "/fr/", "org/fr/", "allow"), (9, "h.net", "/", "net/", "block")]


def plain_ranks(links, seeds, rounds=40, d=urls.DAMPING):
    out, into = Counter(), Counter()
    for (a, b), w in links.items():
        out[a] += w
        into[b] += w
    r = dict(seeds)
    for _ in range(rounds):
        n = defaultdict(lambda: [0.0, 0.0])
        for h, (t, b) in seeds.items():
            n[h][0] += (1 - d) * t
            n[h][1] += (1 - d) * b
        for (a, b), w in links.items():
            n[b][0] += d * w / out[a] * r.get(a, (0, 0))[0]
            n[a][1] += d * w / into[b] * r.get(b, (0, 0))[1]
        r = {h: tuple(x) for h, x in n.items()}
    return r


def test_link_graph(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/p">x</a><img src=\'//{h}/i\'>' for h in hosts)
    pages = [(1, "http://good.org/fr/", link("near.com", "good.org", "/rel")), (2, "http://bad.net/", link("far.com")), (3, "http://feeder.com/x", link("bad.net", "far.com")), (4, "http://near.com/", link("far.com")), (5, "http://far.com/", None), (6, "http://lone.com/", "")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    links = {("good.org", "near.com"): 2, ("bad.net", "far.com"): 2, ("feeder.com", "bad.net"): 2, ("feeder.com", "far.com"): 2, ("near.com", "far.com"): 2}
    r = plain_ranks(links, {"good.org": (1.0, 0.0), "bad.net": (0.0, 1.0)})
    for i, h in ((3, "feeder.com"), (4, "near.com"), (5, "far.com"), (6, "lone.com")):
        t, b = r.get(h, (0, 0))
        assert got[i] == ("block" if b > t else "allow"), h
    assert got[1] == "allow" and got[2] == "block" and got[3] == "block" and got[4] == "allow"


def test_link_graph_is_its_sql(spark, tmp_path):
    """Sixty hosts: a chain of fourteen links to a blocked host, chains from an allowed one, a ring, a hub; held to the SQL and a plain version."""
    import duckdb

    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    pages = [("http://bad.net/", ""), ("http://good.org/fr/x", link("s0.com", "ring0.com")), ("http://www.example.com/de/a", link("good.org"))]
    pages += [(f"http://c{i}.com/", link(f"c{i - 1}.com" if i else "bad.net")) for i in range(14)]
    pages += [(f"http://s{i}.com/", link(f"s{i + 1}.com", *(["hub.com"] if i == 3 else []))) for i in range(20)]
    pages += [(f"http://ring{i}.com/", link(f"ring{(i + 1) % 10}.com", *(["www.example.com"] if i == 5 else []))) for i in range(10)]
    pages += [(f"http://h{i}.com/", link("hub.com")) for i in range(12)] + [("http://hub.com/", link("bad.net", "s1.com")), ("http://www.example.com/else", None), (None, None)]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r) for r in urls.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()}
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    assert got == {r[0]: r for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.SQL['op9_linkgraph']})").fetchall()}
    host = {i: (u or "://").split("://")[1].split("/")[0] for i, u, _ in rows}
    links = Counter((host[i], x) for i, _, h in rows for x in re.findall(r'href="https://([^/]+)', h or "") if x != host[i])
    ruled = {i: r[4] for i, r in got.items() if r[3]}
    good, bad = ({host[i] for i, v in ruled.items() if v == kind} for kind in ("allow", "block"))
    ranks = plain_ranks(links, {h: ((h in good) / len(good), (h in bad) / len(bad)) for h in good | bad}, rounds=200)
    for i, r in got.items():
        t, b = ranks.get(host[i], (0, 0))
        assert r[4] == ruled.get(i, "block" if b > t else "allow"), (i, host[i])
    assert len({h for h in host.values() if h}) >= 50 and got[16][1:] == ("c13.com", "/", None, "block") and sum(r[4] == "block" for r in got.values()) > 20


def test_many_blocked_hosts_do_not_switch_the_graph_off(spark):
    link = '<a href="http://hub.net/">x</a>'
    pages = [(0, "http://hub.net/", "")] + [(i, f"http://s{i}.net/", "") for i in range(1, 3000)] + [(i, f"http://h{i}.com/", link) for i in range(3000, 3050)] + [(4000, "http://lone.com/", "")]
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).filter("verdict = 'allow'").collect()
    assert [r["page_id"] for r in got] == [4000]


def test_links_are_followed_until_scores_settle(spark):
    hosts = ["bad.net", *(f"h{i}.com" for i in range(1, 10))]
    pages = [(i, f"http://{h}/", f'<a href="http://{hosts[i - 1]}/">x</a>' if i else None) for i, h in enumerate(hosts)]
    assert {r["verdict"] for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {"block"}
    links = {("a", "b"): 1, ("b", "a"): 2, ("b", "c"): 1, ("c", "d"): 3, ("d", "a"): 1}
    seeds = {"a": (1.0, 0.0), "d": (0.0, 1.0)}
    edges = spark.createDataFrame([(*k, w) for k, w in links.items()], "src string, dst string, w long")
    got = urls.propagate(edges, spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trust double, distrust double"), damping=0.3)
    want = plain_ranks(links, seeds, rounds=200, d=0.3)
    assert {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()} == {h: pytest.approx(x, rel=1e-5) for h, x in want.items()}


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in texts}
    rows = packing.pack(docs, bucket_rows=7).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(np.array(x[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(x) and (len(x) > 2048 or len(by[i]) == 1)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    # best-fit decreasing, one piece after the other
    room = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        k = min((k for k in range(len(room)) if room[k] >= n), key=lambda k: room[k], default=None)
        if k is None:
            room.append(2048 - n)
        else:
            room[k] -= n
    assert len(seqs) == len(room)


def test_ids_are_those_of_the_tokenizer(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(*packing.default_vocabulary())
    odd = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "x<|endoftext|>\n\n  y  ", "<|endof text|>", "a  b", " a", "\u00a0\u2003 z ", "\u0130\u0301 \ud55c\uae00 12345's"]
    for x in [*(t or "" for _, t in texts), *odd]:
        assert enc.ids(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x[:80]
    assert np.frombuffer(enc.ids(odd[0]), "<u4").tolist() == [64, 220, 50256, 275]


def test_archives(spark, tmp_path):
    pages = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (1, "http://b/\r\nX: y", ""), (2, "u", None), (7, "ü://ö", "é" * 70000), (8, "x", "WARC/1.1\r\n\r\n"), (8, "x", "WARC/1.1\r\n\r\n"), (None, "n", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    index = warc.write_bundles(df, folder, frame_bytes=200, bundle_bytes=4000)
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in pages:
        x = (h or "").encode()
        refers = None if p is None or first[h or ""] == p else first[h or ""]
        want.append((p, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if refers is None else "revisit", refers))
    key = lambda r: tuple((x is None, x) for x in r)
    back = warc.read_bundles(index, folder)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(want, key=key)
    digests = {p: d for p, _, d, *_ in want}
    assert sorted(map(tuple, warc.follow_revisits(back, index, folder).collect())) == sorted((p, r, digests[r]) for p, _, _, k, r in want if k == "revisit")
    moved = index.withColumn("page_id", warc.F.when(warc.F.col("page_id") == 3, 5).when(warc.F.col("page_id") == 5, 3).otherwise(warc.F.col("page_id")))
    with pytest.raises(Exception, match="instead of"):
        warc.read_bundles(moved, folder).collect()
    row = index.filter("page_id = 7").first()
    head, payload = warc.BundleReader(f"{folder}/{row['bundle']}").record(row["frame"], row["offset"])
    assert payload.decode() == "é" * 70000 and head["WARC-Target-URI"] == "ü://ö"
    import zstandard

    data = (tmp_path / "warc" / row["bundle"]).read_bytes()
    out = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # any reader skips the seek table
    assert out.startswith(b"WARC/1.1\r\n")
