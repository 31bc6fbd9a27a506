"""Toxic terms, misspelled ones too, scored by their context.

The lexicon is learned from labelled rows: words, and stems whose endings vary. The trie
of the words is intersected with Levenshtein automata: a state is the set of (trie node,
edits so far) that a token's prefix can reach, and states and transitions are
determinised as they are met. A token that clean rows hold isn't taken for a misspelt
term. Quotations are followed from the start of a text, by kind of mark, and separate
quoting from abuse; windows of words tell how crowded hits are. The counts of hits by
kind become a score by logistic calibration, in which no kind of hit speaks for a text;
misspelt terms are planted in the rows that it is fitted on.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._labels import FOLDS, SAMPLE_BYTES, SAMPLE_ROWS, Logistic, held_out, sample
from ledgerloom.llm._shared import small_batches, trimmed
from ledgerloom.llm._words import mix

#: Least log-likelihood ratio of a term between toxic and other rows: some hundred thousand words are tried, of which none should reach it by chance.
LEAST_G2 = 30.0
#: That of a stem, of which there are far fewer.
STEM_G2 = 15.0
#: Least share of toxic rows among those with a term, classes weighed alike.
LEAST_PRECISION = 0.9
MIN_LENGTH = 4
WINDOW = 6
#: Lengths of stems, and how much more a stem has to tell than the best word it begins.
STEMS, STEM_GAIN = range(4, 8), 1.2
#: Words that a quotation spans, at most; a mark without its counterpart within them quotes nothing.
QUOTED = 64
#: A term allows edits if at most this share of clean rows has a variant of it that no other one has: as many rows may be expected to have one that is new.
NEW_VARIANTS = 0.002
#: States, and tokens with their outcome, that a worker remembers at once.
CACHED = 300_000
#: Pairs of least hashes, of which copies share one.
BANDS = 8
_EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’*%$#&|~^_=+/\\`-"
#: Marks that open a quotation, and those that close it.
_CLOSING = {'"': '"', "“": "”“\"", "”": "”", "„": "“”\"", "‟": "”", "«": "»", "»": "«", "‹": "›", "›": "‹"}
_MARKS = frozenset("".join(_CLOSING) + "".join(_CLOSING.values()))


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 10 else 2


def cleaned(word: str) -> str:
    return word.strip(_EDGES)


class FuzzyLexicon:
    """Least edits between a token and the terms that allow as many: those given, or as their length does."""

    def __init__(self, terms: list[str], allowances: dict[str, int] | None = None):
        self.terms = sorted(set(terms))
        self.children: list[dict[str, int]] = [{}]
        #: For each node, the edits that the most tolerant term below allows, and those of a term that ends there.
        self.most, self.ends = [-1], [-1]
        for term in self.terms:
            node, allowed = 0, edits_allowed(len(term)) if allowances is None else allowances[term]
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(-1)
                    self.ends.append(-1)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node] = max(self.ends[node], allowed)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, reached: dict[int, int]) -> frozenset:
        """With the nodes that omitting characters of a term reaches; nodes out of reach are left out."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            if reached[node] == e:
                for child in self.children[node].values():
                    if e + 1 <= self.most[child] and reached.get(child, 9) > e + 1:
                        reached[child] = e + 1
                        todo.append((child, e + 1))
        return frozenset((n, e) for n, e in reached.items() if e <= self.most[n])

    def _state(self, members: frozenset) -> int:
        if members not in self.ids:
            self.ids[members] = len(self.states)
            self.states.append(members)
            self.steps.append({})
            self.accepts.append(min((e for n, e in members if e <= self.ends[n]), default=-1))
        return self.ids[members]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.most[node] and reached.get(node, 9) > e + 1:
                reached[node] = e + 1
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and reached.get(child, 9) > cost:
                    reached[child] = cost
        out = self.steps[state][c] = self._state(self._closed(reached))
        return out

    def edits(self, token: str) -> int:
        """The least edits, or -1 if no term allows them."""
        if len(self.states) > CACHED:
            self._reset()
        state, dead, steps = self.start, self.dead, self.steps
        for c in token:
            state = steps[state][c] if c in steps[state] else self._step(state, c)
            if state == dead:
                return -1
        return self.accepts[state]


def tokens(text: bytes) -> list[str]:
    """Words between ASCII white space, in lower case."""
    return [w.decode("utf-8", "replace") for w in text.decode("utf-8", "replace").lower().encode("utf-8", "replace").split()]


def _strength(a: int, b: int, n: tuple[int, int]) -> float:
    """Log-likelihood ratio of a rows of label 1 and b of label 0, of n[1] and n[0]; 0 below LEAST_PRECISION."""
    pa_, pb = a / n[1], b / n[0]
    if pa_ / (pa_ + pb) < LEAST_PRECISION:
        return 0.0
    return 2 * (a * math.log(a / (n[1] * (a + b) / (n[0] + n[1]))) + (b * math.log(b / (n[0] * (a + b) / (n[0] + n[1]))) if b else 0))


def _class_sizes(y: np.ndarray) -> tuple[int, int]:
    return max(1, int(np.sum(y == 0))), max(1, int(np.sum(y == 1)))


def word_set(text: bytes) -> set[str]:
    return {cleaned(w) for w in set(tokens(text))}


def learned_terms(words: list[set[str]], y: np.ndarray, least: float = LEAST_G2) -> list[str]:
    """Words that mark label 1, the strongest by log-likelihood ratio over rows first. Their
    number is bounded by the sample that they are learned from. words: those of each row."""
    counts = (Counter(), Counter())
    for own, v in zip(words, y, strict=True):
        counts[int(v)].update(own)
    n = _class_sizes(y)
    found = [(-g, w) for w, a in counts[1].items() if len(w) >= MIN_LENGTH and (g := _strength(a, counts[0][w], n)) >= least]
    return [w for _, w in sorted(found)]


def learned_stems(words: list[set[str]], y: np.ndarray) -> list[str]:
    """Beginnings of words that mark label 1 by more than any longer one that they begin: words with many endings."""
    n, told = _class_sizes(y), {}
    # One letter more than the longest stem tells whether that one is better cut.
    for size in (*STEMS, STEMS.stop):
        mine = Counter(w for own, v in zip(words, y, strict=True) if v for w in {x[:size] for x in own if len(x) >= size})
        mine = {w: a for w, a in mine.items() if _strength(a, 0, n) >= STEM_G2}
        others = Counter(w for own, v in zip(words, y, strict=True) if not v for w in {x[:size] for x in own}.intersection(mine))
        told |= {w: g for w, a in mine.items() if (g := _strength(a, others[w], n)) >= STEM_G2}
    best_below: dict[str, float] = {}
    for w in sorted(told, key=len, reverse=True):
        best_below[w[:-1]] = max(best_below.get(w[:-1], 0.0), told[w], best_below.get(w, 0.0))
    good = {w for w, g in told.items() if len(w) in STEMS and g >= STEM_GAIN * best_below.get(w, 0.0) and w in best_below}
    return sorted(w for w in good if not any(w[:k] in good for k in range(STEMS.start, len(w))))


def quoted_words(words: list[str]) -> np.ndarray:
    """Which words stand in a quotation that is closed: a mark before a word opens, one
    after it, or alone, closes what is open and else opens."""
    out = np.zeros(len(words), dtype=bool)
    opened, closing = -1, ""
    for k, w in enumerate(words):
        if _MARKS.isdisjoint(w):
            continue
        body = w.strip(_EDGES)
        before = w[: w.index(body)] if body else ""
        for place, c in enumerate(w):
            if c not in _MARKS or (body and len(before) <= place < len(before) + len(body)):
                continue
            leads = bool(body) and place < len(before)
            if opened >= 0 and c in closing and not (leads and c in _CLOSING):
                if k - opened <= QUOTED:
                    out[opened : k + 1] = True
                opened = -1
            elif c in _CLOSING and (leads or not body):
                opened, closing = k, _CLOSING[c]
    return out


def misspelt(term: str, seed: int, edits: int) -> str:
    """term with so many letters replaced, dropped or doubled, at places that follow from the seed."""
    out = term
    for k in range(edits):
        h = zlib.crc32(f"{term}:{seed}:{k}".encode())
        at = 1 + h // 7 % max(1, len(out) - 1)
        kind = h % 3
        out = out[:at] + ("", chr(97 + h // 97 % 26), out[at : at + 1] * 2)[kind] + out[at + 1 :]
    return out


class Scanner:
    def __init__(self, terms: list[str], stems: list[str] = (), allowances: dict[str, int] | None = None, ordinary: frozenset[str] = frozenset(), evidence: dict[str, float] | None = None):
        """allowances: the edits of each term; ordinary: tokens that aren't misspelt terms, however near. evidence: what a term or stem tells, as log odds."""
        self.lexicon, self.known = FuzzyLexicon(terms, allowances), {}
        self.stems, self.ordinary, self.evidence, self.allowances = frozenset(stems), ordinary, evidence or {}, allowances or {}

    def told(self, token: str) -> float:
        """The log odds of an exact hit."""
        return max([self.evidence.get(token, 0.0), *(self.evidence.get(token[:k], 0.0) for k in STEMS if token[:k] in self.stems)])

    def edits(self, token: str) -> int:
        """The least edits to a term, none for one that begins with a stem; -1 if it isn't near any."""
        e = self.lexicon.edits(token)
        if e and any(token[:k] in self.stems for k in STEMS):
            return 0
        return -1 if e > 0 and token in self.ordinary else e

    def hits(self, text: bytes) -> list[tuple[int, str, int, bool]]:
        """Place, term as met, edits and whether it is quoted, of each hit of a text."""
        words = text.decode("utf-8", "replace").lower().split()
        known = self.known
        if len(known) > CACHED:
            known.clear()
        met = set()
        for w in set(words):
            e = known.get(w)
            if e is None:
                e = known[w] = self.edits(cleaned(w))
            if e >= 0:
                met.add(w)
        if not met:
            return []
        quoted = quoted_words(words)
        return [(k, cleaned(w), known[w], bool(quoted[k])) for k, w in enumerate(words) if w in met]

    def features(self, texts: list[bytes], hits: list[list[tuple[int, str, int, bool]]]) -> np.ndarray:
        """Of the hits of each text: the evidence of the strongest exact one, counts of exact and of
        misspelt ones, of which those of two edits weigh half, all outside of quotations,
        that of quoted ones, those of the fullest window, and the density of exact ones."""
        out = np.zeros((len(texts), 6))
        for k, (text, own) in enumerate(zip(texts, hits, strict=True)):
            if own:
                kinds = Counter((min(e, 2), q) for _, _, e, q in own)
                places = np.array([p for p, _, _, q in own if not q])
                crowd = (np.searchsorted(places, places + 2 * WINDOW) - np.arange(len(places))).max() if len(places) else 0
                exact = kinds[0, False]
                strongest = max((self.told(w) for _, w, e, q in own if e == 0 and not q), default=0.0)
                out[k] = (strongest, np.log1p(exact), np.log1p(kinds[1, False] + kinds[2, False] / 2), np.log1p(sum(n for (_, q), n in kinds.items() if q)), np.log1p(crowd), 1000 * exact / max(200, len(text)))
        return out


class Calibration:
    """Logistic regression whose weights aren't below zero: features that would have one are left out."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.used = np.flatnonzero(x.any(0)) if len(x) else np.arange(x.shape[1])
        while True:
            self.model = Logistic(x[:, self.used], y)
            if self.model.constant is not None or (self.model.w[:-1] >= 0).all():
                break
            self.used = self.used[self.model.w[:-1] >= 0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.model(x[:, self.used])


def distinct_rows(words: list[set[str]]) -> np.ndarray:
    """The first of each group of rows that share most of their words: copies of a text
    would make words of theirs, whatever they are, look like terms."""
    hashes: dict[str, int] = {}
    masks = np.random.default_rng(5).integers(1, 1 << 32, 2 * BANDS, dtype=np.uint64)
    seen: list[set] = [set() for _ in range(BANDS)]
    kept = []
    for k, own in enumerate(words):
        h = np.array([hashes.setdefault(w, zlib.crc32(w.encode("utf-8", "replace"))) for w in own] or [0], dtype=np.uint64)
        least = np.array([mix(h ^ m).min() for m in masks]).reshape(BANDS, 2).tolist()
        bands = [tuple(x) for x in least]
        if not any(b in s for b, s in zip(bands, seen, strict=True)):
            kept.append(k)
        for b, s in zip(bands, seen, strict=True):
            s.add(b)
    return np.array(kept, dtype=np.int64)


class ToxicityModel:
    """Terms, stems and ordinary tokens of the whole sample; the calibration is fitted on
    each half with what the other one gives, and with misspelt terms planted."""

    def __init__(self, texts: list[bytes], y: np.ndarray):
        words, x, label = [word_set(t) for t in texts], [], []
        half = np.arange(len(y)) % 2 == 0
        for own in (half, ~half):
            known = self._learned([w for w, k in zip(words, own, strict=True) if k], y[own])
            scanner, rest = Scanner(*known), [t for t, k in zip(texts, own, strict=True) if not k]
            found = [scanner.hits(t) for t in rest]
            planted = [self._planted(scanner, t, h, k) for k, (t, h) in enumerate(zip(rest, found, strict=True))]
            for some in (rest, planted):
                x.append(scanner.features(some, [scanner.hits(t) for t in some]))
                label.append(y[~own])
        self.calibration = Calibration(np.concatenate(x), np.concatenate(label))
        self.known = self._learned(words, y)

    @staticmethod
    def _learned(words: list[set[str]], y: np.ndarray) -> tuple[list[str], list[str], dict[str, int], frozenset[str], dict[str, float]]:
        """What a Scanner takes. All of it is bounded by the sample. It is learned from rows that aren't copies of others."""
        rows = distinct_rows(words)
        words, y = [words[k] for k in rows], y[rows]
        stems = learned_stems(words, y)
        terms = [t for t in learned_terms(words, y) if not any(t[:k] in stems for k in STEMS)]
        clean = [own for own, v in zip(words, y, strict=True) if not v]
        vocabulary = set().union(*clean)
        allowances = {t: max(1, edits_allowed(len(t))) for t in terms}
        every = FuzzyLexicon(terms, allowances)
        ordinary = frozenset(w for w in vocabulary if every.edits(w) > 0)
        rows = Counter(w for own in clean for w in own & ordinary)
        alone = [w for w in ordinary if rows[w] == 1]
        for term in terms:
            one = FuzzyLexicon([term], allowances)
            if sum(one.edits(w) > 0 for w in alone) > NEW_VARIANTS * len(clean):
                allowances[term] = 0
        wanted, counts, n = {*terms, *stems}, (Counter(), Counter()), _class_sizes(y)
        for own, v in zip(words, y, strict=True):
            counts[int(v)].update({x for w in own for x in (w, *(w[:k] for k in STEMS)) if x in wanted})
        evidence = {x: max(0.0, math.log((counts[1][x] + 0.5) * n[0] / ((counts[0][x] + 0.5) * n[1]))) for x in wanted}
        return terms, stems, allowances, ordinary, evidence

    @staticmethod
    def _planted(scanner: Scanner, text: bytes, hits: list[tuple[int, str, int, bool]], seed: int) -> bytes:
        """text with its exact terms misspelt, within what they allow."""
        if not hits:
            return text
        words = text.decode("utf-8", "replace").lower().split()
        for place, term, e, _ in hits:
            allowed = scanner.allowances.get(term, 0)
            if e == 0 and allowed:
                words[place] = words[place].replace(term, misspelt(term, seed + place, 1 + (seed + place) % allowed))
        return " ".join(words).encode()

    def scanner(self) -> Scanner:
        return Scanner(*self.known)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, n_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """A model from at most ``rows`` labelled rows a class with at most ``n_bytes`` of text."""
    return ToxicityModel(*sample(docs, labels, "toxic", rows, n_bytes))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, held_out, score (0 to 1), predicted, hits (place, term
    as met, edits, quoted). A null or empty text has no hits and scores as such; a very
    long one is scanned whole. Repeated rows score alike; null ids stay null; other
    columns aren't read. An empty table gives none; a model without labelled rows gives
    one half."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    hit = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("edits", T.IntegerType()), T.StructField("quoted", T.BooleanType())])
    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(hit))])
    arrow = pa.list_(pa.struct([("place", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value.scanner()
        for batch in batches:
            texts = [t or b"" for t in batch["text"].to_pylist()]
            hits = [scanner.hits(t) for t in texts]
            found = [[dict(zip(("place", "term", "edits", "quoted"), h, strict=True)) for h in own] for own in hits]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(shared.value.calibration(scanner.features(texts, hits))), pa.array(found, arrow)], schema.names)
        trimmed(None)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(scored, schema)
    return found.select(F.col("__id").alias(id_col), held_out(F.col("__id"), FOLDS).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
