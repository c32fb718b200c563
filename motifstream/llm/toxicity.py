"""Toxicity from a learned lexicon, matched with misspellings.

A trie of abusive terms is learned from labelled texts. Its intersection with a Levenshtein automaton is
determinised while tokens run through it, so a token costs a few table look-ups. Tokens with digits or symbols
between their letters are masked words and are matched as a whole. Hits are split by their context window into quoted
and direct ones, by quotation marks, by words that report and by words learned to stand near the hits of clean
texts; a logistic model turns both into a score.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifstream.llm.common import documents, lean

MAX_TRAIN, MAX_TRAIN_BYTES = 5_000, 32 << 20  # labelled texts that the model is fitted on, and bytes of them: those with the smallest hashes
PRECISION, CHANCE, LEAST = 0.95, 0.01, 4
PREFIXES = range(4, 9)
FUZZY_FROM = (5, 10)  # letters that a term needs before one edit, or two, are allowed
DOUBTFUL = 0.5  # precision of the terms whose windows teach what reports
BEFORE, AFTER = 6, 3  # words of the context window
THRESHOLD = 0.3
CACHE = 400_000
_TOKEN = re.compile(r"[^\W\d_]+")
_MASK = re.compile(r"[0-9@$*!|](?=[^\W\d_])")
_MASKED = re.compile(r"[0-9@$*!|]{0,2}[^\W\d_]+(?:[0-9@$*!|]{1,3}[^\W\d_]+)*")
#: Letters that digits and symbols stand for.
STANDS_FOR = str.maketrans("0134578@$!|", "oieastbasil")
#: Quotation marks, and words that report what somebody else said.
QUOTES = re.compile("[\"“”„«»‹›]")
REPORTS = frozenset("said says called quote quoted quoting wrote writes reported word term insult slur sagte schrieb nannte zitat zitiert dit appelle cite citation dijo llamado cita palabra".split())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


@dataclass
class Lexicon:
    """Terms as (letters, is a prefix, edits allowed), and the lazily determinised automaton over their trie."""

    terms: list[tuple[str, bool, int]]
    cues: frozenset = frozenset()  # words that report, besides the fixed ones
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]  # most edits with which a token may end here
        self.open: list[int] = [-1]  # the same for a token that goes on
        for term, prefix, edits in self.terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(-1)
                    self.open.append(-1)
                node = self.children[node][c]
            ends = self.open if prefix else self.whole
            ends[node] = max(ends[node], edits)
        self.most = max([0, *(x[2] for x in self.terms)])
        self.loose: Lexicon | None = None  # with an edit at least for each term: for masked words
        self.names: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[int] = []  # least edits if a token ends here, -1: none
        self.done: list[int] = []  # least edits if any token that came here matches, -1: none
        self.start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int]]) -> int:
        """The number of the state with these (node, edits) pairs, closed under skipping a letter of a term."""
        grown = list(found)
        for node, e in grown:
            if e < self.most:
                grown += [(n, e + 1) for n in self.children[node].values()]
        best: dict[int, int] = {}
        for node, e in grown:
            best[node] = min(e, best.get(node, e))
        key = frozenset(best.items())
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.final.append(min([e for n, e in key if e <= max(self.whole[n], self.open[n])], default=-1))
            self.done.append(min([e for n, e in key if e <= self.open[n]], default=-1))
        return self.names[key]

    def _step(self, state: int, c: str) -> int:
        found = set()
        for node, e in self.states[state]:
            if c in self.children[node]:
                found.add((self.children[node][c], e))
            if e < self.most:
                found |= {(node, e + 1)} | {(n, e + 1) for n in self.children[node].values()}
        self.steps[state][c] = out = self._state(found)
        return out

    def match(self, token: str) -> int:
        """Fewest edits from a term, -1 if none is near enough."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > CACHE:
                self.known.clear()
            got = self.known[token] = self._walk(token)
        return got

    def match_masked(self, token: str) -> int:
        """Fewest edits from a term of a word with digits or symbols among its letters, -1 if none is near enough."""
        if self.loose is None:
            self.loose = Lexicon([(t, prefix, max(1, edits)) for t, prefix, edits in self.terms])
        return max(self.loose.match(token.translate(STANDS_FOR)), self.loose.match(token))

    def _walk(self, token: str) -> int:
        state, best, steps = self.start, -1, self.steps
        for c in token:
            state = steps[state].get(c, -1) if c in steps[state] else self._step(state, c)
            if not self.states[state]:
                return best
            if self.done[state] >= 0:
                best = self.done[state] if best < 0 else min(best, self.done[state])
                if not best:
                    return 0
        end = self.final[state]
        return end if best < 0 else best if end < 0 else min(best, end)


def quotation(text: str, words: list[str], cues: frozenset = frozenset()) -> Callable[[int], bool]:
    """Whether the word at a place of ``words``, the tokens of ``text``, is quoted or reported there."""
    marks = bool(QUOTES.search(text))
    low = text.lower() if marks else ""
    spans: list[tuple[int, int]] = []

    def reported(i: int) -> bool:
        window = words[max(0, i - BEFORE) : i + AFTER + 1]
        if not REPORTS.isdisjoint(window) or not cues.isdisjoint(window):
            return True
        if not marks:
            return False
        if not spans:
            spans.extend(x.span() for x in _TOKEN.finditer(low))
        # at an end of the text, marks outside its first and last word count too
        a = spans[i - BEFORE][0] if i > BEFORE else 0
        b = spans[i + AFTER][1] if i + AFTER < len(spans) - 1 else len(low)
        return bool(QUOTES.search(low, a, spans[i][0]) and QUOTES.search(low, spans[i][1], b))

    return reported


def masked_hits(text: str, known: set[int], lexicon: Lexicon) -> list[tuple[int, int]]:
    """(place of the first token, 1 or more) of masked words near a term, but those with a token in ``known``."""
    low = text.lower()
    if not lexicon.terms or not _MASK.search(low):
        return []
    out, starts = [], [x.start() for x in _TOKEN.finditer(low)]
    for x in _MASKED.finditer(low):
        if not x[0].isalpha() and (m := lexicon.match_masked(x[0])) >= 0:
            first, last = bisect.bisect_left(starts, x.start()), bisect.bisect_left(starts, x.end())
            if known.isdisjoint(range(first, last)):
                out.append((first, max(1, m)))
    return out


def features(text: str | None, lexicon: Lexicon) -> tuple[float, ...]:
    """1, then logarithms of direct exact, direct misspelled and quoted hits, and direct hits to the root of the words."""
    words = tokens(text)
    match = lexicon.match
    hits = [(i, m) for i, m in enumerate(map(match, words)) if m >= 0]
    hits += masked_hits(text or "", {i for i, _ in hits}, lexicon)
    exact = fuzzy = quoted = 0
    if hits:
        is_reported = quotation(text, words, lexicon.cues)
        for i, m in hits:
            reported = is_reported(i)
            quoted += reported
            exact += not reported and m == 0
            fuzzy += not reported and m > 0
    return 1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), (exact + fuzzy) / math.sqrt(len(words) or 1)


def direct_words(text: str | None, cues: frozenset = frozenset()) -> set[str]:
    """The words, of letters enough for a term, that are at least once neither quoted nor reported."""
    words, out = tokens(text), set()
    reported = quotation(text or "", words, cues)
    for i, x in enumerate(words):
        if len(x) >= PREFIXES[0] and x not in out and not reported(i):
            out.add(x)
    return out


def _parts(words) -> set[str]:
    """Words and, with a star, their beginnings."""
    return set(words) | {f"{x[:n]}*" for x in words for n in PREFIXES if len(x) >= n}


def _beyond_chance(found: int, rate: float) -> int:
    """How often something must be seen in texts of a kind before chance is ruled out, of ``found`` things that were."""
    return max(LEAST, math.ceil(math.log(CHANCE / max(1, found)) / math.log(rate)))


def learn_terms(texts: list[str], toxic: list[int], bags: list[frozenset], precision: float, cues: frozenset = frozenset()) -> Lexicon:
    """Words and word beginnings that mark toxic texts too well for chance, with edits each where these stay precise.

    ``bags`` are the direct words of each text: to quote or report a word says nothing about it. A word's toxic
    occurrences must have as many different neighbours, so that copies of one text do not make its words terms.
    """
    same = frozenset().union(*bags)
    rate = max(1e-6, sum(toxic) / max(1, len(toxic)))
    bad = Counter(x for bag, y in zip(bags, toxic) if y for x in _parts(bag))
    if not bad or rate == 1:
        return Lexicon([], cues)
    least = _beyond_chance(len(bad), rate)
    bad = Counter({x: n for x, n in bad.items() if n >= least})
    good = Counter(x for bag, y in zip(bags, toxic) if not y for x in _parts(bag) & bad.keys())
    sure = {x for x, n in bad.items() if n >= precision * (n + good[x])}
    near: dict[str, set] = {x: set() for x in sure}
    for text, bag, y in zip(texts, bags, toxic):
        if y and not sure.isdisjoint(_parts(bag)):
            words = tokens(text)
            for before, x, after in zip(["", *words], words, [*words[1:], ""]):
                for part in (_parts([x]) & sure) if x in bag else ():
                    near[part].add((before, after))
    sure = {x for x in sure if len(near[x]) >= least}
    terms: list[tuple[str, bool]] = []
    for x in sorted(sure, key=lambda x: (len(x.rstrip("*")), not x.endswith("*"))):
        word = x.rstrip("*")
        if any(f"{word[:n]}*" in sure for n in PREFIXES if n < len(word) or n == len(word) and not x.endswith("*")):
            continue
        # a beginning that only ever is one whole word is that word
        whole = bad[word] >= 0.9 * bad[x] if x.endswith("*") else True
        longer = {y for y in sure if not y.endswith("*") and y.startswith(word)} if not whole else ()
        best = max(longer, key=bad.__getitem__, default=None)
        terms.append((word, False) if whole else (best, False) if best and bad[best] >= 0.9 * bad[x] else (word, True))
    out = []
    for word, prefix in dict.fromkeys(terms):
        edits = 0
        for most in range(1, 1 + sum(len(word) >= n for n in FUZZY_FROM)):
            # with so many edits in a word, one of as many pieces and one more is unchanged
            cuts = [len(word) * i // (most + 1) for i in range(most + 2)]
            pieces = [word[a:z] for a, z in zip(cuts, cuts[1:])]
            alone, fuzzy = Lexicon([(word, prefix, most)]), [0, 0]
            close = frozenset(x for x in same if any(p in x for p in pieces) and alone._walk(x) > 0)
            for bag, y in zip(bags, toxic) if close else ():
                if not close.isdisjoint(bag):
                    fuzzy[bool(y)] += 1
            if fuzzy[1] < precision * sum(fuzzy):
                break
            edits = most
        out.append((word, prefix, edits))
    return Lexicon(out, cues)


def learn_cues(texts: list[str], toxic: list[int], lexicon: Lexicon) -> frozenset:
    """Words that stand in the windows of a term's hits in clean texts too often for chance, and hardly in toxic ones."""
    clean, all_, hit = Counter(), Counter(), [0, 0]
    for text, y in zip(texts, toxic):
        words = tokens(text)
        at = [i for i, x in enumerate(words) if lexicon.match(x) == 0]
        window = {x for i in at for x in (*words[max(0, i - BEFORE) : i], *words[i + 1 : i + AFTER + 1])}
        if at:
            hit[bool(y)] += 1
            all_.update(window)
            clean.update(() if y else window)
    rate = hit[0] / max(1, sum(hit))
    if not 0 < rate < 1:
        return frozenset()
    least = _beyond_chance(len(clean), rate)
    return frozenset(x for x, n in clean.items() if n >= least and n >= PRECISION * all_[x])


def learn_lexicon(texts: list[str], toxic: list[int]) -> Lexicon:
    """Terms, and the words that report them: those are learned first, around terms that clean texts hold as well."""
    same: dict[str, str] = {}  # one string for each word: the driver's memory is small
    bags_of = lambda cues: [frozenset(same.setdefault(x, x) for x in direct_words(t, cues)) for t in texts]
    bags = bags_of(frozenset())
    cues = learn_cues(texts, toxic, learn_terms(texts, toxic, bags, DOUBTFUL))
    return learn_terms(texts, toxic, bags_of(cues) if cues else bags, PRECISION, cues)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from labelled texts outside the held-out quarter: at most ``max_train``, and at most ``max_bytes`` of them.

    The sample is the labelled texts with the smallest hash of their id, whole ones. Of texts with the same words and
    label one counts, whatever else begins alike.
    """
    own = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    named = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    sizes = named.select("doc_id", "th", F.octet_length("text").alias("size")).join(own, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(max_train).collect()
    chosen, total = [], 0
    for r in sizes:
        if total + r["size"] <= max_bytes:
            chosen.append((r["doc_id"], r["th"], int(r["toxic"] > 0)))
            total += r["size"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, th long, toxic int")  # at most max_train rows
    rows = named.join(F.broadcast(sample), ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").toPandas()
    rows = rows.assign(words=[" ".join(tokens(t)) for t in rows["text"]]).sort_values(["text", "toxic"]).drop_duplicates(["words", "toxic"])
    texts, toxic = rows["text"].tolist(), rows["toxic"].tolist()
    lexicon = learn_lexicon(texts, toxic)
    if not texts:
        return lexicon, np.array([-4.0, 0, 0, 0, 0])
    return Lexicon(lexicon.terms, lexicon.cues), fit_logistic(np.array([features(t, lexicon) for t in texts]), np.array(toxic, float))


def _scores(texts, model: tuple[list, frozenset, np.ndarray], cache: dict) -> np.ndarray:
    if "lexicon" not in cache:
        cache["lexicon"] = Lexicon(*model[:2])
    z = np.array([features(t.as_py(), cache["lexicon"]) for t in texts]).reshape(len(texts), 5) @ model[2]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, in one pass without a shuffle.

    Null and empty texts have no hits and get the score of such texts; null ids are not held out; rows that repeat
    are scored alike; without labels the score is a small constant; other columns are ignored.
    """
    lexicon, weights = fit(docs, labels, max_train=max_train)
    model = lexicon.terms, lexicon.cues, weights

    def run(batches):
        cache: dict = {}
        for b in batches:
            s = _scores(b["text"], model, cache)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s), pa.array((s >= threshold).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that reach the threshold, all columns as they were."""
    lexicon, weights = fit(docs, labels, max_train=max_train)
    model = lexicon.terms, lexicon.cues, weights

    def run(batches):
        cache: dict = {}
        for b in batches:
            yield b.filter(pa.array(_scores(b["text"], model, cache) < threshold))

    return docs.mapInArrow(lean(run, 512), docs.schema)


def op3_levenshtein(spark, sf_dir):
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_levenshtein": op3_levenshtein}
SQL: dict[str, str] = {}
