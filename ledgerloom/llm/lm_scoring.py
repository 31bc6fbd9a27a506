"""Scoring texts by a smoothed n-gram model of the training rows, of order two or three.

1. Owners of words count them over all chunks of training rows and number them, the
   frequent ones first, so that n-grams are told by small exact numbers.
2. The model is dealt out by context: an owner of contexts gathers the counts of their
   pairs and triples from all chunks, and keeps quantised counts, and how many words
   follow once, twice and more often, in memory-mapped Elias-Fano tries: the pairs below
   their context, and the triples below their pair. It answers every chunk's pairs and
   triples from them, by successor search relative to the context. A context with over
   1 / FREQUENT_SHARE of all tokens is split over SPLIT owners.
3. Every owner tells every chunk what it has in all: tokens and distinct tokens, and
   n-grams of each level that were met one to four times. Their sums are those of the
   whole corpus; the discounts follow from them, and from these the smoothed
   probabilities and backoffs of the chunk's pairs and triples.

p(w | u v) = (c(u v w) - D(c)) / c(u v), plus the sum of D over the words met after u v,
divided by c(u v), times p(w | v); the same one level down, with p(w) the additively
smoothed unigram model. D depends on whether c is one, two or more. The first term needs
a word's entry in the trie, the factor of the lower level its context's.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _exchange, count_min
from ledgerloom.llm._exchange import Reader, Writer
from ledgerloom.llm._labels import held_out
from ledgerloom.llm._shared import small_batches, trimmed
from ledgerloom.llm._words import Hasher, U, Words, mix
from ledgerloom.llm.elias_fano import NgramTrie

FOLDS = 10
ADDED = 0.1
#: Of counts of one, two and more; one taken whole leaves pairs met once to the level below.
PRUNED = (1.0, 0.75, 0.75)
DISCOUNT = 0.75
#: Bits of the number of a word; it is about that of distinct words at most.
BITS = 40
#: Codes of counts are exact up to EXACT, from there on in STEPS to a doubling.
EXACT, STEPS = 4096, 1024
#: There are fewer than FREQUENT_SHARE contexts that are split.
FREQUENT_SHARE = 1000
SPLIT = 32
_HASHER = Hasher(404)
END, START = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)


def _is_training(ids: list) -> np.ndarray:
    return np.array([zlib.crc32((b"" if i is None else str(i).encode())) % FOLDS != 0 for i in ids], dtype=bool)


class Tokens:
    """Fingerprints of the tokens of texts and of the token before each."""

    def __init__(self, ids: list, texts: list[bytes]):
        words = Words.of(texts, lower=True)
        h = words.hashed(_HASHER)
        self.ends = words.first[1:] + np.arange(1, len(texts) + 1)
        self.first = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.token = np.empty(len(h) + len(texts), dtype=U)
        last = np.zeros(len(self.token), dtype=bool)
        last[self.ends - 1] = True
        self.token[last], self.token[~last] = END, h
        self.training = _is_training(ids)
        self.n = self.ends - self.first
        self.trained = np.repeat(self.training, self.n)

    @property
    def inner(self) -> np.ndarray:
        """Which tokens have two before them, the start of the text included."""
        out = np.ones(len(self.token), dtype=bool)
        out[self.first] = False
        return out


def chen_goodman(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts of one, two and more; DISCOUNT where counts of counts are missing."""
    met, share, out = (n1, n2, n3, n4), n1 / max(1, n1 + 2 * n2), []
    for k in (1, 2, 3):
        a, b = met[k - 1], met[k]
        out.append(min(k - 0.1, max(0.1, k - (k + 1) * share * b / a)) if n1 and a and b else DISCOUNT)
    return tuple(out)


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]


def _coded(counts: np.ndarray) -> np.ndarray:
    """Codes of counts; those beyond EXACT within 1 / 2048 of a doubling."""
    beyond = EXACT + np.rint(np.log2(np.maximum(counts, EXACT) / EXACT) * STEPS)
    return np.where(counts <= EXACT, counts, beyond).astype("<u2")


def _decoded(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.float64)
    return np.where(codes <= EXACT, codes, np.rint(EXACT * np.exp2((codes - EXACT) / STEPS)))


def _following(of: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Of each of n contexts how many words follow once, twice and more often."""
    some = counts > 0
    return np.bincount(of[some] * 3 + np.minimum(counts[some], 3) - 1, minlength=3 * n).reshape(n, 3)


def _met(counts: np.ndarray) -> list[int]:
    """How many were met once, twice, three and four times."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


class _Vocabulary:
    """The distinct tokens of a chunk, ascending, and their training counts."""

    def __init__(self, ids: list, texts: list[bytes], places: int):
        self.tokens = t = Tokens(ids, texts)
        words, which = np.unique(np.concatenate([t.token, [START]]), return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate([t.trained.astype(np.int64), [int(t.training.sum())]])).astype(np.int64)
        self.words, self.counts, self.which, self.places = words, counts, which, places
        self.cuts = _exchange.runs(_exchange.buckets_of(words, places))

    def parts(self) -> dict[int, bytes]:
        """To every owner, even without words, since each has to tell what it has in all."""
        slices = {k: (a, b) for k, a, b in self.cuts}
        out = {}
        for k in range(self.places):
            a, b = slices.get(k, (0, 0))
            out[k] = Writer().steps(self.words[a:b].view(np.int64), 8).put(self.counts[a:b], 5).done(b - a)
        return out


def _numbered(blobs: list[bytes]) -> list[bytes]:
    """The bucket's training tokens and distinct ones; of the words of each blob the training counts and, from 1, the ranks by count in their bucket, 0 for those that aren't in training."""
    words, counts, sizes = [], [], []
    for blob in blobs:
        read = Reader(blob, 1)
        sizes += read.sizes
        words.append(read.steps(sizes[-1], 8))
        counts.append(read.take(sizes[-1], 5))
    known, which = np.unique(np.concatenate(words), return_inverse=True)
    totals = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
    rank = np.empty(len(known), dtype=np.int64)
    rank[np.argsort(-totals, kind="stable")] = np.arange(1, len(known) + 1)
    rank[totals == 0] = 0
    token = known.view(U) != START
    held = np.array([totals[token].sum(), np.count_nonzero(totals[token])])
    out, ends = [], np.cumsum([0, *sizes])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = which[a:b]
        out.append(Writer().put(held, 8).put(totals[own], 5).put(rank[own], 5).done(b - a))
    return out


def _distinct(outer: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, ascending, and which of them each is. Neither has a bound, so
    both are sorted by; they are packed into one number where that has room."""
    outer, inner = outer.astype(np.int64), inner.astype(np.int64)
    if not len(outer) or (int(outer.max()) < 1 << 62 - BITS and int(inner.max()) < 1 << BITS):
        keys, which = np.unique((outer << BITS) | inner, return_inverse=True)
        return keys >> BITS, keys & ((1 << BITS) - 1), which
    order = np.lexsort((inner, outer))
    a, b = outer[order], inner[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return a[new], b[new], which


class _Grams:
    """The contexts, pairs and triples of a chunk whose words are all in training, by bucket."""

    def __init__(self, vocabulary: _Vocabulary, answers: dict[int, bytes], places: int, order: int):
        v, t = vocabulary, vocabulary.tokens
        readers = {k: Reader(blob, 1) for k, blob in answers.items()}
        #: Training tokens and distinct ones of the corpus.
        self.total, self.distinct = np.sum([r.take(2, 8).astype(np.int64) for r in readers.values()], axis=0).tolist()
        self.count, self.number = np.zeros(len(v.words), dtype=np.int64), np.zeros(len(v.words), dtype=np.int64)
        for k, a, b in v.cuts:
            read = readers[k]
            self.count[a:b], rank = read.take(b - a, 5), read.take(b - a, 5).astype(np.int64)
            self.number[a:b] = np.where(rank > 0, (rank - 1) * places + k + 1, 0)
        self.word = v.which[:-1]
        self.before = np.empty(len(self.word), dtype=np.int64)
        self.before[1:] = self.word[:-1]
        self.before[t.first] = v.which[-1]
        frequent = self.count * FREQUENT_SHARE > self.total

        def owners(words: np.ndarray, part: np.ndarray) -> np.ndarray:
            spread = np.where(frequent[words], part + 1, 0).astype(U)
            return _exchange.buckets_of(mix(mix(self.number[words].astype(U)) + spread), places).astype(np.int64)

        used = np.unique(self.before)
        used = used[self.number[used] > 0]
        part = np.tile(np.arange(SPLIT), int(frequent[used].sum()))
        asked = np.concatenate([used[~frequent[used]], np.repeat(used[frequent[used]], SPLIT)])
        bucket = owners(asked, np.concatenate([np.zeros(len(asked) - len(part), np.int64), part]))
        keys, first = np.unique((bucket << BITS) | self.number[asked], return_index=True)
        context_bucket, self.context, self.context_word = keys >> BITS, keys & ((1 << BITS) - 1), asked[first]
        at = np.flatnonzero((self.number[self.before] > 0) & (self.number[self.word] > 0))
        word = self.number[self.word[at]]
        bucket = owners(self.before[at], (mix(word.astype(U)) % U(SPLIT)).astype(np.int64))
        of = np.searchsorted(keys, (bucket << BITS) | self.number[self.before[at]])
        self.pair_context, self.pair_word, which = _distinct(of, word)
        self.pair_counts = np.bincount(which, weights=t.trained[at], minlength=len(self.pair_word)).astype(np.int64)
        self.pair = np.full(len(self.word), -1, dtype=np.int64)
        self.pair[at] = which
        after = t.inner if order > 2 else np.zeros(len(self.word), dtype=bool)
        after[1:] &= (self.pair[:-1] >= 0) & (self.number[self.word[1:]] > 0)
        self.at3 = np.flatnonzero(after)
        self.triple_pair, self.triple_word, self.triple = _distinct(self.pair[self.at3 - 1], self.number[self.word[self.at3]])
        self.triple_counts = np.bincount(self.triple, weights=t.trained[self.at3], minlength=len(self.triple_word)).astype(np.int64)
        self.places, every = places, np.arange(places + 1)
        c = np.searchsorted(context_bucket, every)
        p = np.searchsorted(self.pair_context, c)
        q = np.searchsorted(self.triple_pair, p)
        #: bucket and slices of contexts, pairs and triples.
        self.cuts = [(k, slice(c[k], c[k + 1]), slice(p[k], p[k + 1]), slice(q[k], q[k + 1])) for k in np.flatnonzero(np.diff(c)).tolist()]

    def parts(self) -> dict[int, bytes]:
        out = {k: Writer().done(0, 0, 0) for k in range(self.places)}
        for k, c, p, q in self.cuts:
            body = Writer().steps(self.context[c], 5)
            body.steps(self.pair_context[p], 4, c.start).put(self.pair_word[p], 5).put(self.pair_counts[p], 4)
            body.steps(self.triple_pair[q], 4, p.start).put(self.triple_word[q], 5).put(self.triple_counts[q], 4)
            out[k] = body.done(c.stop - c.start, p.stop - p.start, q.stop - q.start)
        return out


class Model:
    """An owner's part of the model: the tries of its contexts' pairs and of their triples."""

    def __init__(self, contexts: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...]):
        """contexts: ascending. pairs: number of the context, word and count; triples: number of the pair, word and
        count; both ascending and distinct, a count of zero being none."""
        (of, words, counts), (over, ends, counts3) = pairs, triples
        some, met = counts > 0, counts3 > 0
        place = np.cumsum(some) - 1
        codes = _coded(np.column_stack([counts, _following(over, counts3, len(words))])[some])
        self.pairs = NgramTrie.of(contexts[of[some]], words[some], codes, BITS)
        self.triples = NgramTrie.of(place[over[met]].astype(U), ends[met], _coded(counts3[met])[:, None], BITS)
        #: Of the contexts that have pairs, which are those of the trie.
        self.following = _coded(_following(of, counts, len(contexts))[np.unique(of[some])])

    LEVELS = ("pairs", "triples")

    def save(self, folder: str) -> None:
        for name in self.LEVELS:
            getattr(self, name).save(folder, name)
        np.save(os.path.join(folder, "following.npy"), self.following)

    @classmethod
    def mapped(cls, folder: str) -> Model:
        own = cls.__new__(cls)
        for name in cls.LEVELS:
            setattr(own, name, NgramTrie.mapped(folder, name))
        own.following = np.load(os.path.join(folder, "following.npy"), mmap_mode="r" if own.pairs.parts["contexts"].n else None)
        return own

    def followed(self, contexts: np.ndarray) -> np.ndarray:
        """Codes of how many words follow contexts once, twice and more often."""
        at, seen = self.pairs.parts["contexts"].successor(contexts)
        out = np.zeros((len(contexts), 3), dtype="<u2")
        out[seen] = self.following[at[seen]]
        return out

    def look_up(self, contexts: np.ndarray, of: np.ndarray, words: np.ndarray, over: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the counts of the pairs of the of-th context and a word and of how many words follow each once,
        twice and more often; codes of the counts of the triples of the over-th pair and a word."""
        place, codes = self.pairs.find(contexts, of, words)
        known = np.flatnonzero(place >= 0)
        back = np.full(len(place), -1, dtype=np.int64)
        back[known] = np.arange(len(known))
        some = back[over] >= 0
        out = np.zeros(len(ends), dtype="<u2")
        out[some] = self.triples.find(place[known].astype(U), back[over[some]], ends[some])[1][:, 0]
        return codes, out


def _answered(blobs: list[bytes]) -> list[bytes]:
    """Pairs and triples of the bucket by counts of one to four; codes of the contexts, pairs and triples of each blob."""
    columns, sizes = [[] for _ in range(7)], []
    before = [0, 0]
    for blob in blobs:
        read = Reader(blob, 3)
        c, p, q = read.sizes
        sizes.append((c, p, q))
        own = [read.steps(c, 5), read.steps(p, 4) + before[0], read.take(p, 5), read.take(p, 4), read.steps(q, 4) + before[1], read.take(q, 5), read.take(q, 4)]
        for out, x in zip(columns, own, strict=True):
            out.append(x.astype(np.int64))
        before[0] += c
        before[1] += p
    context, pair_context, pair_word, pair_count, triple_pair, triple_word, triple_count = (np.concatenate(x) for x in columns)
    contexts, which = np.unique(context, return_inverse=True)
    of, words, pair = _distinct(which[pair_context], pair_word)
    counts = np.bincount(pair, weights=pair_count, minlength=len(words)).astype(np.int64)
    over, ends, triple = _distinct(pair[triple_pair], triple_word)
    counts3 = np.bincount(triple, weights=triple_count, minlength=len(ends)).astype(np.int64)
    with tempfile.TemporaryDirectory() as folder:
        Model(contexts.astype(U), (of, words.astype(U), counts), (over, ends.astype(U), counts3)).save(folder)
        model = Model.mapped(folder)
        following = model.followed(contexts.astype(U))[which]
        code, code3 = model.look_up(contexts.astype(U), of, words.astype(U), over, ends.astype(U))
        del model
    code, code3 = code[pair], code3[triple]
    met, out, at = np.array([*_met(counts), *_met(counts3)]), [], [0, 0, 0]
    for size in sizes:
        c, p, q = (slice(a, a + n) for a, n in zip(at, size, strict=True))
        out.append(Writer().put(met, 8).put(following[c].ravel("F"), 2).put(code[p].ravel("F"), 2).put(code3[q], 2).done())
        at = [a + n for a, n in zip(at, size, strict=True)]
    return out


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, discounts: tuple[float, float, float] | None = None) -> DataFrame:
    """One row for each row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose id's crc32 isn't 0 modulo FOLDS train the model; a null id counts as
    empty text and is held out. A null or empty text is its end alone. Repeated rows
    train as often as they occur. Without training rows every probability is that of an
    unknown token. Other columns aren't read; an empty table gives none.

    order: two or three words. discounts: of counts of one, two and more at each level,
    None for those that the level's counts of counts give. PRUNED leaves what was met
    once to the level below.
    """
    if order not in (2, 3):
        raise ValueError(f"order is 2 or 3, not {order}")
    small_batches(df.sparkSession)
    n_bytes = count_min.text_bytes(df, text_col)
    places = _exchange.chunks_for(n_bytes)

    def words(ids: list, texts: list[bytes], answers: list) -> dict[int, bytes]:
        return _Vocabulary(ids, texts, places).parts()

    def grams(ids: list, texts: list[bytes], answers: list[dict[int, bytes]]) -> dict[int, bytes]:
        return _Grams(_Vocabulary(ids, texts, places), answers[0], places, order).parts()

    schema = T.StructType([T.StructField("__id", df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])

    def done(ids: list, texts: list[bytes], answers: list[dict[int, bytes]]) -> pa.Table:
        vocabulary = _Vocabulary(ids, texts, places)
        g, t = _Grams(vocabulary, answers[0], places, order), vocabulary.tokens
        following, code, code3 = np.zeros((len(vocabulary.words), 3)), np.zeros((len(g.pair_word), 4), dtype="<u2"), np.zeros(len(g.triple_word), dtype="<u2")
        readers = {k: Reader(blob, 0) for k, blob in answers[1].items()}
        met = np.sum([r.take(8, 8).astype(np.int64) for r in readers.values()], axis=0).tolist()
        for k, c, p, q in g.cuts:
            read, n_c, n_p = readers[k], c.stop - c.start, p.stop - p.start
            # The parts of a split context add up.
            np.add.at(following, g.context_word[c], _decoded(read.take(3 * n_c, 2).reshape(3, n_c).T))
            code[p], code3[q] = read.take(4 * n_p, 2).reshape(4, n_p).T, read.take(q.stop - q.start, 2)
        taken, taken3 = (chen_goodman(*n) if discounts is None else discounts for n in (met[:4], met[4:]))
        unknown = g.total + ADDED * (g.distinct + 1)
        share = following @ np.array(taken) / np.maximum(g.count, 1)
        count, count3, below = _decoded(code[:, 0]), _decoded(code3), _decoded(code[:, 1:]) @ np.array(taken3)
        below = np.where(count > 0, below / np.maximum(count, 1), 0.0)
        single = (g.count[g.word] + ADDED) / unknown
        left = np.where(g.count[g.before] > 0, np.maximum(share[g.before], 1e-9), 1.0)
        p = left * single
        some = np.flatnonzero(g.pair >= 0)
        p[some] += ((count - _discounted(count, taken))[g.pair[some]]) / np.maximum(g.count[g.before[some]], 1)
        share3 = below[g.pair[g.at3 - 1]]
        own = (count3 - _discounted(count3, taken3))[g.triple] / np.maximum(count[g.pair[g.at3 - 1]], 1)
        p3 = np.where(share3 > 0, own + share3 * p[g.at3], p[g.at3])
        if order > 2:
            # After a pair that training has, a word that it hasn't met at all takes the share too.
            at = np.flatnonzero(t.inner)
            at = at[g.pair[at - 1] >= 0]
            left3 = below[g.pair[at - 1]]
            p[at[left3 > 0]] *= left3[left3 > 0]
            p[g.at3] = p3
        add = lambda x: np.add.reduceat(x, t.first)
        columns = [t.n, add((g.count[g.word] > 0).astype(np.int64)), np.full(len(ids), g.total), add(np.log10(single)), add(np.log10(p))]
        types = _exchange.arrow_schema(schema)
        return pa.table([pa.array(ids, types.field(0).type), *(pa.array(c) for c in columns)], schema=types)

    docs = _exchange.chunked(df, id_col, text_col, places)
    known = _exchange.ask(docs, words, lambda blobs, bucket: _numbered(blobs), places)
    found = _exchange.finish(docs, done, schema, [known, _exchange.ask(docs, grams, lambda blobs, bucket: _answered(blobs), places, [known])])
    return found.select(F.col("__id").alias(id_col), held_out(F.col("__id"), FOLDS).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
