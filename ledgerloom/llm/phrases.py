"""Collocations: phrases of two and three words mined from compressed position bitmaps.

A shard of documents keeps, for each frequent word, a bitmap of the slots where it
stands, as its non-empty blocks of sixteen slots. A phrase's bitmap, shifted by one slot
and intersected with those of the words, gives the bitmaps of all phrases that are one
word longer; popcounts are their frequencies there. Pieces are an empty slot apart, so
no phrase crosses their bounds. Words are extended some first words at a time. The bitmaps
of their pairs, not more blocks than the shard has words, are kept in memory while the
round lasts, for the frequent ones to be extended to triples.

Shards sum their counts at the owners of words, pairs and triples (``_exchange``), level
by level: only words, and then pairs, that are frequent over all shards are extended.
An owner also picks the shard that reports a phrase, so that each is reported once. Owners
of triples answer a shard only the numbers of the words of those that it reports, so that
the last round finds no triples again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import _exchange, count_min
from ledgerloom.llm._exchange import Reader, Writer
from ledgerloom.llm._shared import small_batches, written
from ledgerloom.llm._words import Hasher, U, mix

LEAST, TOP, SHARE = 10, 2000, 50
UNKNOWN = "und"
#: Pairs of blocks that are intersected at once, about.
BATCH = 1 << 17
#: Parts of a language that are cut to their top before they meet.
PARTS = 64
_HASHER = Hasher(303)
_KIND = np.zeros(256, dtype=np.int8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


@dataclass
class Bitmaps:
    """Non-empty blocks: of an item, the bits of the sixteen slots from 16 * block on."""

    item: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, items: np.ndarray, slots: np.ndarray) -> Bitmaps:
        """Ascending by item and block."""
        width = max(4, _bits(slots))
        both = np.sort(items << width | slots)
        bit = np.left_shift(1, both & 15).astype(np.uint16)
        first = np.flatnonzero(_changes(both >> 4))
        both = both[first]
        return cls(both >> width, (both & (1 << width) - 1) >> 4, np.bitwise_or.reduceat(bit, first) if len(first) else bit)

    def take(self, at) -> Bitmaps:
        return Bitmaps(self.item[at], self.block[at], self.bits[at])

    def shifted(self) -> Bitmaps:
        """One slot on. What leaves a block stands in a row of its own."""
        over = np.flatnonzero(self.bits >> 15)
        low = (self.bits << np.uint16(1)).astype(np.uint16)
        some = np.flatnonzero(low)
        return Bitmaps(np.concatenate([self.item[some], self.item[over]]), np.concatenate([self.block[some], self.block[over] + 1]), np.concatenate([low[some], np.ones(len(over), dtype=np.uint16)]))


class ByBlock:
    """Bitmaps of words, found by block."""

    def __init__(self, words: Bitmaps, blocks: int):
        order = _order(words.block)
        self.words = words.take(order)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(words.block, minlength=blocks + 1))])

    def sizes(self, block: np.ndarray) -> np.ndarray:
        return self.first[block + 1] - self.first[block]

    def extended(self, phrases: Bitmaps, n_words: int) -> Bitmaps:
        """The phrases that are one word longer, as item * n_words + word."""
        moved = phrases.shifted()
        size = self.sizes(moved.block)
        ends = np.cumsum(size)
        at = np.repeat(self.first[moved.block] - (ends - size), size)
        at += np.arange(len(at))
        bits = np.repeat(moved.bits, size)
        bits &= self.words.bits.take(at, mode="clip")
        some = np.flatnonzero(bits)
        row, at = np.searchsorted(ends, some, side="right"), at[some]
        return Bitmaps(moved.item[row] * n_words + self.words.item[at], moved.block[row], bits[some])


def _changes(x: np.ndarray) -> np.ndarray:
    return np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, dtype=bool)


def _bits(x: np.ndarray) -> int:
    return int(x.max()).bit_length() if len(x) else 0


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 on. Sorting them with their places behind them is faster than argsort, if both fit."""
    width = len(x).bit_length()
    if _bits(x) + width > 63:
        return np.argsort(x, kind="stable")
    return np.sort(x << width | np.arange(len(x))) & (1 << width) - 1


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items in the order in which they are met first, and of each item the number of its own."""
    coded = pa.array(x).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _totals(which: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, dtype=np.int64)
    np.add.at(total, which, counts)
    return total


def _summed(found: Bitmaps) -> tuple[np.ndarray, np.ndarray]:
    """Items, ascending, and their popcounts."""
    order = _order(found.item)
    items, counts = found.item[order], np.bitwise_count(found.bits[order]).astype(np.int64)
    first = np.flatnonzero(_changes(items))
    return items[first], np.add.reduceat(counts, first) if len(first) else counts


def _width(x: np.ndarray) -> int:
    return max(1, (_bits(x) + 7) // 8)


class Shard:
    """Words of a shard: key of each distinct one, ascending, its count; of each word its key's number and slot."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.data, self.starts, self.ends = data, edges[::2], edges[1::2]
        bounds = np.searchsorted(self.starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        # Words that begin a piece; the last place is for what follows all words.
        begins = np.zeros(len(self.starts) + 1, dtype=bool)
        begins[0] = True
        begins[np.searchsorted(self.starts, np.flatnonzero(kind == 2))] = True
        self.slot = np.arange(len(self.starts)) + np.cumsum(begins[:-1])
        names = sorted(set(langs))
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], dtype=U)
        lang = np.searchsorted(names, langs)[doc] if len(doc) else doc
        self.langs, self.lang = names, lang
        keys = mix(_HASHER.words(data, self.starts, self.ends) ^ seeds[lang]) if len(doc) else np.zeros(0, dtype=U)
        # A language counts as a word of its own, met once for each of its words.
        totals = mix(seeds ^ U(0x5851F42D4C957F2D))
        distinct, which = _grouped(np.concatenate([keys, totals]))
        order = np.argsort(distinct)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        which = place[which]
        self.total_key, self.key = which[len(keys) :], which[: len(keys)]
        self.counts = np.bincount(which, minlength=len(order))
        self.counts[self.total_key] = np.bincount(lang, minlength=len(names))
        self.keys = distinct[order]

    def word(self, at: int) -> bytes:
        return self.data[self.starts[at] : self.ends[at]].tobytes()

    def sent(self, places: int) -> dict[int, bytes]:
        return {k: Writer().steps(self.keys[a:b].view(np.int64), 8).put(self.counts[a:b], 5).done(b - a) for k, a, b in _exchange.runs(_exchange.buckets_of(self.keys, places))}

    def read(self, places: int, answers: dict[int, bytes]) -> None:
        """From the owners: n of each language, and the frequent words with their totals and numbers, ascending by number."""
        total, number = np.zeros(len(self.keys), dtype=np.int64), np.zeros(len(self.keys), dtype=np.int64)
        for k, a, b in _exchange.runs(_exchange.buckets_of(self.keys, places)):
            read = Reader(answers[k], 1)
            frequent = np.flatnonzero(np.unpackbits(np.frombuffer(read.raw((b - a + 7) // 8), dtype=np.uint8), count=b - a)) + a
            total[frequent], number[frequent] = read.take(read.sizes[0], 6), read.take(read.sizes[0], 8)
        self.n = total[self.total_key]
        total[self.total_key] = 0
        known = np.flatnonzero(total)
        known = known[_order(number[known])]
        local = np.full(len(self.keys), -1, dtype=np.int64)
        local[known] = np.arange(len(known))
        self.numbers, self.totals = number[known], total[known]
        item = local[self.key] if len(self.key) else self.key
        some = np.flatnonzero(item >= 0)
        self.bitmaps = Bitmaps.of(item[some], self.slot[some])
        self.by_block = ByBlock(self.bitmaps, int(self.slot[-1] >> 4) + 1 if len(self.slot) else 0)
        # Where each frequent word stands first here.
        self.at = np.zeros(len(known), dtype=np.int64)
        self.at[item[some][::-1]] = some[::-1]

    def roots(self) -> Iterator[Bitmaps]:
        """The words' bitmaps, in batches of whole words that are extended at once."""
        cost = np.cumsum(self.by_block.sizes(self.bitmaps.block))
        a = 0
        while a < len(cost):
            b = int(np.searchsorted(cost, (cost[a - 1] if a else 0) + BATCH, side="right"))
            b = int(np.searchsorted(self.bitmaps.item, self.bitmaps.item[max(a, b - 1)], side="right"))
            yield self.bitmaps.take(slice(a, b))
            a = b

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of frequent words as first * words + second, ascending, and their counts here. Their bitmaps are kept, a batch each."""
        self.two = [self.by_block.extended(x, len(self.numbers)) for x in self.roots()]
        return _joined([_summed(x) for x in self.two])

    def triples(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Triples whose both pairs are among ``pairs``, as place in pairs * words + third, and their counts here. After ``pairs``, once."""
        n, out = len(self.numbers), []
        for two in self.two:
            at, known = _places(pairs, two.item)
            two = two.take(known)
            three = self.by_block.extended(Bitmaps(at[known], two.block, two.bits), n)
            second = pairs[three.item // n] % n
            out.append(_summed(three.take(_places(pairs, second * n + three.item % n)[1])))
        return _joined(out)


def _places(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands in known, ascending, and which of them do."""
    at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
    return at, np.flatnonzero(known[at] == x) if len(known) else np.zeros(0, dtype=np.int64)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in (0, 1))


def _word_owner(least: int, places: int):
    def answer(blobs: list[bytes], bucket: int) -> list[bytes]:
        keys, counts, sizes = [], [], []
        for blob in blobs:
            read = Reader(blob, 1)
            sizes.append(read.sizes[0])
            keys.append(read.steps(sizes[-1], 8).view(U))
            counts.append(read.take(sizes[-1], 5).astype(np.int64))
        distinct, which = _grouped(np.concatenate(keys))
        total = _totals(which, np.concatenate(counts), len(distinct))
        frequent = total >= least
        # Numbers of all owners are different and as small as can be.
        number = np.cumsum(frequent) * places + bucket
        out = []
        for own in np.split(which, np.cumsum(sizes)[:-1]):
            some = own[frequent[own]]
            out.append(Writer().raw(np.packbits(frequent[own]).tobytes()).put(total[some], 6).put(number[some], 8).done(len(some)))
        return out

    return answer


def _dealt(columns: list[np.ndarray], places: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of phrases, given by their words' numbers, by bucket, and its runs."""
    h = np.zeros(len(columns[0]), dtype=U)
    for x in columns:
        h = mix(h * U(0x9E3779B97F4A7C15) + x.astype(U))
    bucket = _exchange.buckets_of(h, places).astype(np.int64)
    order = _order(bucket)
    return order, _exchange.runs(bucket[order])


def _phrases_sent(columns: list[np.ndarray], counts: np.ndarray, places: int) -> dict[int, bytes]:
    """Blobs of phrases, given by their words' numbers and ascending by them."""
    order, found = _dealt(columns, places)
    out = {}
    for k, a, b in found:
        own = order[a:b]
        sent, widths = Writer(), [_width(x[own]) for x in (*columns, counts)]
        sent.steps(columns[0][own], widths[0])
        for x, w in zip((*columns[1:], counts), widths[1:], strict=True):
            sent.put(x[own], w)
        out[k] = sent.done(b - a, *widths)
    return out


def _phrases_got(blobs: list[bytes], size: int) -> tuple[list[np.ndarray], list[int], np.ndarray, np.ndarray]:
    """What shards have sent: the words' numbers, how many phrases of each; the totals, and where each phrase is met first."""
    parts, sizes = [], []
    for blob in blobs:
        read = Reader(blob, size + 2)
        n, *widths = read.sizes
        sizes.append(n)
        parts.append([read.steps(n, widths[0]), *(read.take(n, w).astype(np.int64) for w in widths[1:])])
    *columns, counts = (np.concatenate([p[k] for p in parts]) for k in range(size + 1))
    item, n = columns[0], len(counts)
    for x in columns[1:]:
        # Numbers that don't fit one integer together get smaller ones.
        if _bits(item) + _bits(x) > 63:
            distinct, item = _grouped(item)
        if _bits(item) + _bits(x) > 63:
            distinct, x = _grouped(x)
        item = item << _bits(x) | x
    distinct, which = _grouped(item)
    # Shards come in their order: the first one reports.
    chosen = np.diff(np.maximum.accumulate(which), prepend=-1) > 0
    return columns, sizes, _totals(which, counts, len(distinct))[which], chosen


def _pair_owner(least: int):
    def answer(blobs: list[bytes], bucket: int) -> list[bytes]:
        _, sizes, totals, chosen = _phrases_got(blobs, 2)
        frequent, out, ends = totals >= least, [], np.cumsum([0, *sizes])
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            some = totals[a:b][frequent[a:b]]
            out.append(Writer().raw(np.packbits(frequent[a:b]).tobytes()).raw(np.packbits(chosen[a:b]).tobytes()).put(some, 6).done(len(some)))
        return out

    return answer


def _triple_owner(least: int):
    """Answers a shard only those that it reports: the words' numbers and the total of each."""

    def answer(blobs: list[bytes], bucket: int) -> list[bytes]:
        columns, sizes, totals, chosen = _phrases_got(blobs, 3)
        some, ends = np.flatnonzero(chosen & (totals >= least)), np.cumsum([0, *sizes])
        cuts, out = np.searchsorted(some, ends), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = some[a:b]
            sent = Writer()
            for x in columns:
                sent.put(x[own], 8)
            out.append(sent.put(totals[own], 6).done(len(own)))
        return out

    return answer


def _phrases_read(columns: list[np.ndarray], places: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Totals, 0 where below the least, and whether this shard reports."""
    order, found = _dealt(columns, places)
    total, chosen = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=bool)
    for k, a, b in found:
        read, own = Reader(answers[k], 1), order[a:b]
        frequent, mine = (np.unpackbits(np.frombuffer(read.raw((b - a + 7) // 8), dtype=np.uint8), count=b - a).astype(bool) for _ in range(2))
        total[own[frequent]] = read.take(read.sizes[0], 6)
        chosen[own] = mine
    return total, chosen


def _triples_read(answers: dict[int, bytes]) -> list[np.ndarray]:
    """Numbers of the words and totals of the triples that this shard reports."""
    reads = [Reader(answers[k], 1) for k in sorted(answers)]
    parts = [[r.take(r.sizes[0], w).astype(np.int64) for w in (8, 8, 8, 6)] for r in reads if r.sizes[0]]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in range(4)]


class _Level:
    """What a shard works out in a round, with the answers of the rounds before it."""

    def __init__(self, langs: list[str], texts: list[bytes], places: int, answers: list[dict[int, bytes]]):
        self.shard = s = Shard(langs, texts)
        s.read(places, answers[0])
        self.codes, self.counts = s.pairs()
        n = max(1, len(s.numbers))
        self.pair = [s.numbers[self.codes // n], s.numbers[self.codes % n]]
        if len(answers) > 1:
            total, chosen = _phrases_read(self.pair, places, answers[1])
            some = np.flatnonzero(total)
            self.codes, self.total, self.chosen = self.codes[some], total[some], chosen[some]
        if len(answers) == 2:
            threes, self.counts = s.triples(self.codes)
            two = self.codes[threes // n] if len(self.codes) else threes
            self.triple = [s.numbers[two // n], s.numbers[two % n], s.numbers[threes % n]]
        if len(answers) > 2:
            *triple, self.three_total = _triples_read(answers[2])
            self.triple = [np.searchsorted(s.numbers, x) for x in triple]

    def rows(self) -> dict[str, list]:
        """The phrases that this shard reports."""
        s, n = self.shard, max(1, len(self.shard.numbers))
        text: dict[int, bytes] = {}

        def word(i: int) -> bytes:
            if i not in text:
                text[i] = s.word(s.at[i])
            return text[i]

        own = np.flatnonzero(self.chosen)
        x, y = self.codes[own] // n, self.codes[own] % n
        a, b, c = self.triple
        before, after = (self.total[_places(self.codes, p * n + q)[0]] if len(a) else a for p, q in ((a, b), (b, c)))
        lang = np.concatenate([s.lang[s.at[x]], s.lang[s.at[a]]])
        phrases = [word(i) + b" " + word(j) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        phrases += [b" ".join((word(i), word(j), word(k))) for i, j, k in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)]
        none = [None] * len(own)
        return {
            "lang": [s.langs[k] for k in lang.tolist()], "phrase": phrases, "n": s.n[lang].tolist(), "a": [*self.total[own].tolist(), *self.three_total.tolist()],
            "l1": [*s.totals[x].tolist(), *s.totals[a].tolist()], "r1": [*s.totals[y].tolist(), *after.tolist()],
            "l2": [*none, *before.tolist()], "r2": [*none, *s.totals[c].tolist()],
        }


_SCHEMA = "lang string, phrase string, n long, a long, l1 long, r1 long, l2 long, r2 long"


def candidates(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase (words joined by a space), n, a, l1, r1, l2, r2: phrases of two and
    three words met ``least`` times or more in a language, with the frequencies of both
    parts for each cut; l2 and r2 are null for two words."""
    small_batches(df.sparkSession)
    places = _exchange.chunks_for(count_min.text_bytes(df, text_col))
    text, lang = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(lang_col), F.lit(UNKNOWN))
    chunk = F.pmod(F.xxhash64(F.col(id_col), lang, text), F.lit(places)).cast("int")
    docs = _exchange.packed(df.select(chunk.alias("chunk"), lang.alias("id"), text.cast("binary").alias("text")))

    def words(langs: list[str], texts: list[bytes], answers: list) -> dict[int, bytes]:
        return Shard(langs, texts).sent(places)

    def pairs(langs: list[str], texts: list[bytes], answers: list[dict[int, bytes]]) -> dict[int, bytes]:
        level = _Level(langs, texts, places, answers)
        return _phrases_sent(level.pair, level.counts, places)

    def triples(langs: list[str], texts: list[bytes], answers: list[dict[int, bytes]]) -> dict[int, bytes]:
        level = _Level(langs, texts, places, answers)
        return _phrases_sent(level.triple, level.counts, places)

    types = _exchange.arrow_schema(_SCHEMA)

    def done(langs: list[str], texts: list[bytes], answers: list[dict[int, bytes]]) -> pa.Table:
        rows = _Level(langs, texts, places, answers).rows()
        return pa.table({k: pa.array(v, pa.binary()).cast(pa.string()) if k == "phrase" else pa.array(v, types.field(k).type) for k, v in rows.items()}, schema=types)

    first = _exchange.ask(docs, words, _word_owner(least, places), places)
    second = _exchange.ask(docs, pairs, _pair_owner(least), places, [first])
    third = _exchange.ask(docs, triples, _triple_owner(least), places, [first, second])
    return _exchange.finish(docs, done, _SCHEMA, [first, second, third])


def mine(df: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase scores 1000000 * a * a / (l * r), rounded down, by its lowest-scoring cut
    (l, r: the parts' frequencies), the first of equals. It goes if a longer candidate
    holds it in ``share`` hundredths of its occurrences or more. Ties go to the larger
    a, then to the smaller phrase. A null language is ``und``, a null text empty;
    repeated rows count each; a very long text is one of a shard. Other columns aren't
    read. An empty table gives none.
    """
    found = written(candidates(df, least, id_col, text_col, lang_col), "candidates")
    longer = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))
    held = found.where("l2 IS NOT NULL").select("lang", longer.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    left = found.join(held, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    # Exact: scores are at most 1000000, products below 10**38 for frequencies up to 10**15.
    score = lambda k: f"(1000000 * CAST(a AS decimal(16)) * CAST(a AS decimal(15))) DIV (CAST(l{k} AS decimal(19)) * CAST(r{k} AS decimal(19)))"
    scored = left.withColumns({"s1": F.expr(score(1)), "s2": F.expr(score(2))})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    rows = scored.select("lang", "phrase", "a", *(F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1")).alias(x) for x in "lr"), "n", F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
