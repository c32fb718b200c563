"""Near-duplicates, repeated passages, benchmark items, toxicity and the pipeline against plain versions."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from prose import prose, words

from motifstream.llm import contamination, neardup, suffixes, toxicity
from motifstream.llm.components import components


def plain_sets(texts, k):
    out = {}
    for i, t in texts:
        w = (t or "").encode().translate(neardup._FOLD).split()
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def plain_components(texts, k, percent=80):
    sets = plain_sets(texts, k)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, texts, k):
    want = plain_components(texts, k)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, words=k).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_chains_join_across_leaders(frame):
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows, now = [], base
    for i in range(8):  # each is near the one before, the ends are not near
        rows.append((i, " ".join(now)))
        now = now[9:] + [f"n{i}_{j}" for j in range(9)]
    r.shuffle(rows)
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(frame(rows), words=4).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows, 4).items()}


def test_near_duplicates_with_odd_rows(frame):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B C D E"), (3, None), (4, ""), (5, "x"), (6, "X")]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame(rows)).collect()), key=str)
    assert got == sorted([(False, 1, 1, True), (False, 1, 1, True), (True, 0, None, True), (False, 2, 1, False), (False, 3, 3, True), (False, 4, 4, True), (False, 5, 5, True), (False, 6, 5, False)], key=str)
    assert neardup.near_duplicates(frame([])).collect() == []
    kept = neardup.drop_near_duplicates(frame(rows))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3, 4, 5] and kept.columns == frame(rows).columns


def variants(r, base, n, share):
    """``n`` texts, each with about that share of the words of ``base`` changed to words of its own."""
    for i in range(n):
        yield " ".join(f"v{i}_{j}" if r.random() < share else w for j, w in enumerate(base))


def test_texts_that_are_only_alike_and_copies_of_one(frame):
    r = random.Random(11)
    base, other = words(r, 160), words(r, 160)
    rows = list(enumerate(variants(r, base, 150, 0.035)))  # alike at 0.75 or so, most not linked
    rows += [(1000 + i, t) for i, t in enumerate(variants(r, other, 120, 0.02))] + [(5000, " ".join(other))]  # each near the last one
    rows += [(2000 + i, " ".join(t.split(" ")[:-3])) for i, t in rows[:20]]
    r.shuffle(rows)
    want = plain_components(rows, 4)
    assert len({c for _, c in want.values()}) > 20 and sum(c == 1000 for _, c in want.values()) > 100
    for leaders in (1, 2):
        d = frame(rows)
        signed = neardup.signatures(d, 4).withColumnsRenamed({"doc_id": "id"})
        signed = neardup.materialize(signed, "classes")
        labels = neardup.class_links(signed, signed, words=4, leaders=leaders)
        got = {x["node"]: x["component"] for x in labels.collect()}
        assert {i: got.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in want.items()}
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(frame(rows), words=4).collect()} == {i: c for i, (_, c) in want.items()}


def test_prefixes_meet_for_every_possible_overlap():
    starts = neardup.size_classes(1 << 20)
    for n in (1, 2, 3, 7, 40, 163, 2000):
        mine = {(c, d): k for c, d, k in neardup.prefixes(n, 80, starts)}
        for m in range(-(-80 * n // 100), 100 * n // 80 + 1):
            theirs = {(d, c): k for c, d, k in neardup.prefixes(m, 80, starts)}
            (pair,) = mine.keys() & theirs.keys() if len(mine.keys() & theirs.keys()) == 1 else [x for x in mine.keys() & theirs.keys() if starts[x[1]] <= m < starts[x[1] + 1]]
            need = -(-80 * (n + m) // 180)
            assert mine[pair] >= n - need + 1 and theirs[pair] >= m - need + 1


def test_one_id_with_several_texts(frame):
    r = random.Random(6)
    a, b, c = (words(r, 60) for _ in range(3))
    near = lambda x: " ".join([*x[:-1], "other"])
    rows = [(4, " ".join(a)), (4, " ".join(b)), (6, near(a)), (9, near(b)), (8, near(c)), (2, " ".join(c)), (9, " ".join(c)), (11, " ".join(words(r, 60))), (11, None), (12, " ".join(a))]
    got = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(frame(rows), words=4).collect())
    assert got == sorted((i, 11 if i == 11 else 2, i in (2, 11)) for i, _ in rows)
    lost = [(1, " ".join(a)), (1, " ".join(b)), (3, near(a))]
    assert {x["component_id"] for x in neardup.near_duplicates(frame(lost), words=4).collect()} == {1}


def test_odd_sketches_estimate_high_similarities():
    r = np.random.default_rng(1)
    for share in (0.95, 0.9, 0.8, 0.7):
        errors = []
        for _ in range(20):
            both = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
            n = round(1000 / share - 1000) // 2
            a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, n, dtype=np.uint64)])) for _ in range(2))
            x, y = (neardup.odd_sketch(neardup.minhash(s)) for s in (a, b))
            errors.append(neardup.estimate(int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum())) - share)
        assert abs(np.mean(errors)) < 0.04 and max(map(abs, errors)) < neardup.MARGIN


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(500, 499), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 30)}, 499: 499, 500: 499}


def test_components_of_long_chains(spark):
    n, r = 1000, random.Random(3)
    falling, mixed = [0, *range(n - 1, 0, -1)], r.sample(range(n), n)
    links = list(zip(falling, falling[1:])) + [(n + a, n + b) for a, b in zip(mixed, mixed[1:])]
    links = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {i: i // n * n for i in range(2 * n)}
    with pytest.raises(RuntimeError):
        components(links, max_rounds=2)


def plain_removals(texts, n=100):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            else:
                seen.add(b[p : p + n])
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(left).hexdigest(), left)
    return out


def test_slices_keep_buckets_whole():
    r = np.random.default_rng(2)
    for _ in range(300):
        n, most = r.integers(1, 40, r.integers(1, 30)), int(r.integers(1, 100))
        name = np.sort(r.integers(0, 8, len(n)))
        for whole in (None, name):
            cuts = list(suffixes._slices(n, whole, most))
            assert [x for a, z in cuts for x in range(a, z)] == list(range(len(n)))
            assert whole is None or all(name[z - 1] != name[z] for _, z in cuts[:-1])
            assert all(n[a:z].sum() <= most or (z - a == 1 if whole is None else len(set(name[a:z])) == 1) for a, z in cuts)
    assert list(suffixes._slices(n[:0])) == list(suffixes._slices(n[:0], name[:0])) == []


@pytest.mark.parametrize("options", [{}, {"hot": 2, "block_bytes": 2000, "bin_bytes": 3000}])
def test_repeats_are_removed(docs, texts, options):
    want = plain_removals(texts)
    assert sum(x[1] for x in want.values()) > 5000
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.removals(docs, **options).collect()}
    assert got == {i: x[:4] for i, x in want.items()}


def test_repeats_keep_rows(docs, texts, frame):
    want = plain_removals(texts)
    rows = suffixes.cut_repeats(docs, block_bytes=3000).collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() == docs.first().asDict().keys()
    for r in rows:
        left = None if dict(texts)[r["doc_id"]] is None else want[r["doc_id"]][4].decode("utf-8", "ignore")
        assert r["text"] == left and r["lang"] == "en" and r["n_chars"] == len(left or "")
    assert suffixes.removals(frame([])).collect() == [] and suffixes.cut_repeats(frame([])).collect() == []
    long = "k" * 250
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffixes.removals(frame([(None, long), (4, long), (4, long)])).collect())
    assert [x for _, x in got] == [250, 249, 250] or sorted(x for _, x in got) == [249, 250, 250]


def test_strings_of_one_name_are_told_apart_by_their_bytes(monkeypatch):
    r = random.Random(21)
    parts = [prose(r, 40).encode()[:150] for _ in range(6)]
    texts = [parts[i % 6] + bytes([65 + i]) * 30 for i in range(14)]

    def found():
        e, data = suffixes._block_entries(list(range(14)), 0, texts, 100)
        kept, spans = suffixes._split_late(e, data, 100)
        own = kept[np.argsort(kept["name"], kind="stable")]
        of, at = suffixes.refine(own, suffixes._snippets(own, data, 100), 100)
        spans = [(int(x["idx"]), a) for x in spans for a in range(x["start"], x["end"] - 99)]
        return sorted(spans + list(zip(own["idx"][of].tolist(), (own["start"][of] + at).tolist())))

    want = found()
    seen, plain = set(), []
    for i, t in enumerate(texts):
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                plain.append((i, p))
            seen.add(t[p : p + 100])
    assert want == sorted(plain) and want
    real = suffixes.join_names
    monkeypatch.setattr(suffixes, "join_names", lambda a, b: real(a, b) % np.uint64(3))  # names that hardly tell anything apart
    assert found() == want


def test_ids_must_be_whole_numbers(frame):
    with pytest.raises(TypeError):
        suffixes.removals(frame([]).withColumn("doc_id", toxicity.F.lit("a")))


def edits(a, b):
    """Least edits from a to any part of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(5)
    for _ in range(150):
        a = "".join(r.choice("abc") for _ in range(r.randrange(1, 90)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(0, 120)))
        if r.random() < 0.5:
            b = b[:20] + a[: len(a) // 2] + r.choice("abc") + a[len(a) // 2 :] + b[20:]
        assert contamination.myers(a, b)[0] == edits(a, b)


def test_rolling_hashes_name_strings():
    t = "abcab\u00e9\U0001f600cabcab\u00e9\U0001f600c" * 3
    for width in (1, 2, 3, 5, 8, 21, 22):
        h = contamination.rolling(contamination.letters_of(t), width).tolist()
        parts = [t[i : i + width] for i in range(len(t) - width + 1)]
        assert len(h) == len(parts) and len(set(zip(h, parts))) == len(set(h)) == len(set(parts))
    assert len(contamination.rolling(contamination.letters_of("ab"), 3)) == 0


def test_a_piece_that_a_long_text_repeats():
    r = random.Random(4)
    item = contamination.normal(prose(r, 60))
    piece = item[: len(item) // (contamination.budget(item) + 1)]
    text = " ".join([piece.strip()] * 3000)
    changed = item[:150] + "q" + item[151:300] + item[301:]
    matcher = contamination.Matcher([(1, item), (1, "x"), (2, prose(r, 60))])
    assert len(matcher.starts(contamination.normal(text))[0]) >= 3000 and matcher.find(text) == {}
    assert matcher.find(f"{text} {changed} {text}")[1][0] == edits(item, contamination.normal(f"{piece} {changed} {piece}")) <= 2


def test_leaks(frame, spark):
    r = random.Random(9)
    items = [(k, prose(r, 25)) for k in range(12)] + [(50, None), (51, ""), (52, "?!"), (53, "short one")]
    rows = []
    for i in range(60):
        body = prose(r, 60)
        if i % 3 == 0:
            t = items[i % 12][1]
            for _ in range(i % 6):
                p = r.randrange(len(t))
                t = t[:p] + r.choice(["", "q", "zz"]) + t[p + 1 :]
            body = f"{body[:100]} {t.upper() if i % 2 else t} {body[100:]}"
        rows.append((i, body))
    rows += [(70, None), (71, ""), (72, "a short one!"), (72, "a short one!"), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        own = contamination.normal(t)
        for k, x in items:
            item = contamination.normal(x)
            if len(item) > 2 and (d := edits(item, own)) <= contamination.budget(item):
                want.append((-1 if i is None else i, k, d))
    for block in (4_000_000, 600):
        got = contamination.find_leaks(frame(rows), bench, block_chars=block).collect()
        assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["item_id"], x["edits"]) for x in got) == sorted(want)
        left = contamination.drop_leaks(frame(rows), bench, block_chars=block).collect()
        assert sorted(x["doc_id"] for x in left) == sorted({i for i, _ in rows if i is not None} - {i for i, _, _ in want})
    nameless = bench.unionByName(bench.filter("item_id = 0").selectExpr("cast(null as long) as item_id", "text"))
    assert {x["item_id"] for x in contamination.find_leaks(frame(rows), nameless).collect() if x["doc_id"] is None} == {0, None}
    assert contamination.find_leaks(frame(rows), bench.filter("false")).collect() == [] and contamination.find_leaks(frame([]), bench).collect() == []


def test_automaton_is_edit_distance():
    terms = [("idiot", False, 1), ("scum", False, 0), ("trash", True, 1), ("lowei", True, 0)]
    lexicon = toxicity.Lexicon(terms)

    def full(a, b):
        d = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            d.append([i])
            for j, y in enumerate(b, 1):
                d[i].append(min(d[i - 1][j - 1] + (x != y), d[i - 1][j] + 1, d[i][-1] + 1))
        return d

    def plain(token):
        best = [99]
        for term, prefix, k in terms:
            last = full(term, token)[-1]
            e = min(last) if prefix else last[-1]
            if e <= k:
                best.append(e)
        return min(best) if min(best) < 99 else -1

    r = random.Random(2)
    tokens = [t for t, _, _ in terms]
    for _ in range(600):
        t = list(r.choice([x for x, _, _ in terms]) + r.choice(["", "", "s", "en"]))
        for _ in range(r.randrange(3)):
            p = r.randrange(len(t) + 1)
            t[p : p + r.randrange(2)] = r.choice(["", *"adiotscumrhlwe"])
        tokens.append("".join(t))
    for t in filter(None, tokens):
        assert lexicon.match(t) == plain(t), t


@pytest.fixture(scope="module")
def toxic(frame, spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        t, bad = prose(r, 60).split(" "), i % 6 == 0
        if bad:
            for w in r.sample(["moronic", "imbecile", "vermin", "pathetic"], 2):
                t[r.randrange(len(t))] = w if r.random() < 0.8 else w[:2] + w[3:]
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    return frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_labels(toxic, frame):
    docs, labels = toxic
    got = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in got)
    assert len(got) > 100 and hit >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    lexicon, weights = toxicity.fit(docs, labels)
    assert {"moronic", "imbecile", "vermin", "pathetic"} <= {t for t, p, _ in lexicon.terms} | {x for x in ("moronic", "imbecile", "vermin", "pathetic") for t, p, _ in lexicon.terms if p and x.startswith(t)}
    direct = toxicity.features("you are moronic vermin today", lexicon)
    quoted = toxicity.features('he said "you are moronic vermin" today', lexicon)
    assert direct[1] > 0 and quoted[1] == 0 and quoted[3] > 0 and np.dot(direct, weights) > np.dot(quoted, weights)
    odd = frame([(1, None), (2, ""), (None, "moronic vermin " * 5), (3, "x " * 100_000)])
    rows = {r["doc_id"]: r for r in toxicity.score(odd, labels.filter("false")).collect()}
    assert len(rows) == 4 and all(0 < r["score"] < 0.3 for r in rows.values()) and rows[None]["held_out"] is False
    assert toxicity.score(frame([]), labels).collect() == []


def test_terms_that_clean_texts_quote_are_learned():
    r = random.Random(5)
    texts, toxic = [], []
    for i in range(400):
        t, bad = prose(r, 40).split(" "), i % 4 == 0
        if bad or i % 4 == 1:
            w = r.choice(["moronic", "vermin"])
            t[r.randrange(len(t))] = w if bad else f'"{w}"' if i % 8 == 1 else f"said {w}"
        texts.append(" ".join(t))
        toxic.append(int(bad))
    lexicon = toxicity.learn_lexicon(texts, toxic)
    assert [lexicon.match(x) for x in ("moronic", "vermin")] == [0, 0]
    weights = toxicity.fit_logistic(np.array([toxicity.features(t, lexicon) for t in texts]), np.array(toxic, float))
    scores = 1 / (1 + np.exp(-np.array([toxicity.features(t, lexicon) for t in texts]) @ weights))
    assert ((scores >= toxicity.THRESHOLD) == np.array(toxic)).all()


def test_masked_words_are_hits():
    lexicon = toxicity.Lexicon([("idiot", False, 1), ("scum", False, 0), ("trash", True, 1), ("disgusting", False, 2)])
    hits = lambda t: toxicity.features(t, lexicon)[1:3]
    one = toxicity.math.log1p(1)
    for word in ("id1ot", "1diot", "idi0t", "i*iot", "sc*m", "$cum", "tr@sher", "d1sgust1ng", "idioot"):
        assert hits(f"you are {word} and more") == (0, one), word
    for word in ("disgsting", "disgusitng", "dizguzting"):
        assert hits(word) == (0, one)
    for word in ("b2b", "h264", "mp3s", "a1b2c3d4", "100", "x*y*z", "***", "at$ 5", "stuff#and"):
        assert hits(f"some {word} here") == (0, 0), word
    assert hits("you idiot!you") == (one, 0) and hits('he said "id1ot" today') == (0, 0)


def test_copies_of_one_text_make_no_terms():
    r = random.Random(8)
    copied = prose(r, 40)
    texts = [prose(r, 40) for _ in range(500)] + [f"{copied} {prose(r, 3)}" for _ in range(30)]
    toxic = [int(i % 6 == 0) for i in range(500)] + [1] * 30
    for i in range(0, 500, 6):
        t = texts[i].split(" ")
        t[r.randrange(len(t))] = r.choice(["moronic", "vermin"])
        texts[i] = " ".join(t)
    lexicon = toxicity.learn_lexicon(texts, toxic)
    assert {lexicon.match(x) for x in ("moronic", "vermin")} == {0} and not any(lexicon.match(x) >= 0 for x in toxicity.tokens(copied))


def test_words_that_report_are_learned():
    r = random.Random(12)
    texts, toxic = [], []
    for i in range(900):
        t, kind = prose(r, 40).split(" "), i % 3
        at = r.randrange(2, len(t) - 3)
        if kind:
            w = r.choice(["moronic", "vermin", "imbecile"])
            t[at : at + 1] = ["glossary", "entry", w] if kind == 1 else [w]
        texts.append(" ".join(t))
        toxic.append(int(kind == 2))
    lexicon = toxicity.learn_lexicon(texts, toxic)
    assert {"glossary", "entry"} <= lexicon.cues and len(lexicon.cues) < 10
    assert all(lexicon.match(x) == 0 for x in ("moronic", "vermin", "imbecile"))
    assert toxicity.features("see the glossary entry vermin for more", lexicon)[1:4] == (0, 0, toxicity.math.log1p(1))


def test_training_texts_are_bounded_by_bytes(toxic):
    docs, labels = toxic
    lexicon, _ = toxicity.fit(docs, labels, max_bytes=1000)
    assert lexicon.terms == []
    few, _ = toxicity.fit(docs.unionByName(docs), labels)
    assert few.terms == toxicity.fit(docs, labels)[0].terms


def plain_scores(rows, labels, lexicon, weights):
    """The scores of a model, each token held to each term by the plain table of edits."""
    def near(token, term, prefix, most):
        d = [list(range(len(token) + 1))]
        for i, x in enumerate(term, 1):
            d.append([i])
            for j, y in enumerate(token, 1):
                d[i].append(min(d[i - 1][j - 1] + (x != y), d[i - 1][j] + 1, d[i][-1] + 1))
        e = min(d[-1]) if prefix else d[-1][-1]
        return e if e <= most else 99

    out = {}
    for i, text in rows:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        found = [min((near(w, *t) for t in lexicon.terms), default=99) for w in words]
        direct = [e for k, e in enumerate(found) if e < 99 and not ({*toxicity.REPORTS, *lexicon.cues} & set(words[max(0, k - 6) : k + 4]))]
        quoted = sum(e < 99 for e in found) - len(direct)
        x = (1, np.log1p(direct.count(0)), np.log1p(len(direct) - direct.count(0)), np.log1p(quoted), len(direct) / np.sqrt(len(words) or 1))
        out[i] = 1 / (1 + np.exp(-np.dot(x, weights)))
    return out


def test_scores_are_those_of_a_plain_version(toxic):
    docs, labels = toxic
    rows = [(x["doc_id"], x["text"]) for x in docs.collect() if x["doc_id"] < 200]
    want = plain_scores(rows, labels, *toxicity.fit(docs, labels))
    got = {x["doc_id"]: x for x in toxicity.score(docs, labels).collect()}
    for i, s in want.items():
        assert abs(got[i]["score"] - s) < 1e-9 and got[i]["predicted"] == (s >= 0.3)


def test_texts_that_begin_alike_are_all_learned_from(toxic, spark):
    docs, labels = toxic
    same = docs.select("doc_id", toxicity.F.concat(toxicity.F.lit("home about contact " * 8), "text").alias("text"))
    lexicon, _ = toxicity.fit(same, labels)
    assert all(lexicon.match(x) == 0 for x in ("moronic", "imbecile", "vermin", "pathetic"))


def test_pipeline_stage_by_stage(spark, tmp_path, texts, frame, toxic):
    import corpus_pipeline

    r = random.Random(8)
    items = [(k, prose(r, 30)) for k in range(5)]
    rows = [(i + 1000, t) for i, t in texts] + [(3000 + k, f"{prose(r, 30)} {t} {prose(r, 30)}") for k, t in items]
    bad, labels = toxic
    frame(rows).unionByName(bad).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    held = {x["doc_id"]: x["predicted"] for x in toxicity.score(docs, labels).collect()}
    now = {x["doc_id"]: x["text"] for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            assert {x["doc_id"] for x in out.collect()} == set(now)
            break
        if name == "toxicity":
            now = {i: t for i, t in now.items() if not held[i]}
        elif name == "near-dedup":
            now = {i: now[i] for i, (_, c) in plain_components(list(now.items()), 5).items() if i == c}
        elif name == "suffix-dedup":
            now = {i: None if now[i] is None else x[4].decode("utf-8", "ignore") for i, x in plain_removals(list(now.items())).items()}
        else:
            gone = {i for i, t in now.items() if any(contamination.normal(x) in contamination.normal(t) for _, x in items)}
            assert gone
            now = {i: t for i, t in now.items() if i not in gone}
        assert out.columns == columns
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        assert {x["doc_id"]: x["text"] for x in docs.collect()} == now, name
    last = corpus_pipeline.run(spark, sf)
    assert {x["doc_id"] for x in last.collect()} == set(now)


def test_queries_have_code_and_names():
    from motifstream.llm import registry

    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in registry.QUERIES) == list(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)
