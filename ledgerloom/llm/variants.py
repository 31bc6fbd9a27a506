"""Spelling variants: words one edit apart, by two-dimensional range reporting.

A word is a point: its rank in the order of words and its rank in the order of reversed
words. Those that differ from w at one place p share the prefix before p and the suffix
after it, an interval in either order; the points of both intervals are reported by a
wavelet matrix. Both orders go by length first, so that an interval holds words of one
length: of w's own for a replaced code point, of one more for an inserted one. Deleted
ones are the latter seen from the other word.

Words are dealt so that those which share what lies outside a segment of places meet:
an edit lies in one segment only, so each pair is found once. At first a word has two
segments, its halves; groups of more than ``GROUP`` words halve their segment, down to
one place, until no group is larger.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import small_batches, trimmed, written
from ledgerloom.llm.wavelet import WaveletMatrix

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
TIMES = 10
#: Words of a group, beyond which it is split; rows of a shard, on average; rectangles looked up at once.
GROUP, SHARD, BLOCK = 8192, 32_768, 1 << 17
#: Rows of hot groups that are broadcast at most; more of them are met by a shuffle join.
HOT_ROWS = 50_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def slipped(word: Column, row_id: Column, every: int = 31) -> Column:
    """word without one code point where ``every`` divides the CRC-32 of "<id>:<word>",
    h: the one at h modulo its length. A null id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word).cast("long")).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters with slips planted, of LEAST_LETTERS code points or more,
    that occur LEAST_COUNT times or more. A null text has none."""
    # A shorter run can't make a word: slips only shorten.
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{LEAST_LETTERS},}})"))
    found = df.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    words = found.select(slipped(F.col("run"), F.col("id")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key(word: Column, base: Column, a: Column, z: Column) -> Column:
    """What a word shares with its near words that differ in the places [a, z) of a word of base code points."""
    ending = F.greatest(base - z, F.lit(0))
    return F.struct(base.alias("base"), a.alias("a"), z.alias("z"), F.substring(word, F.lit(1), a).alias("prefix"), F.when(ending > 0, F.substring(word, F.length(word) - ending + 1, ending)).otherwise("").alias("suffix"))


def _dealt(words: DataFrame) -> DataFrame:
    """word, n, base, a, z: the groups of each word. It is asked for in those of its own
    length and found there and in those of one less."""
    n, base = F.length("word"), F.col("base")
    half = F.floor(base / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("a"), half.alias("z")), F.struct(half.alias("a"), (base + 1).alias("z")))
    rows = words.select("word", "n", F.explode(F.array(n, n - 1)).alias("base")).select("word", "n", "base", F.explode(halves).alias("s")).select("word", "n", "base", "s.a", "s.z")
    done = []
    while True:
        keyed = rows.withColumn("key", _key(F.col("word"), base, F.col("a"), F.col("z")))
        hot = written(keyed.where(F.col("z") - F.col("a") > 1).groupBy("key").count().where(F.col("count") > GROUP).select("key", F.lit(True).alias("hot")), "hot")
        found = hot.count()
        if not found:
            return reduce(DataFrame.unionByName, done, rows)
        keyed = keyed.join(F.broadcast(hot) if found <= HOT_ROWS else hot, "key", "left")
        done.append(keyed.where(F.col("hot").isNull()).select(*rows.columns))
        middle = F.floor((F.col("a") + F.col("z")) / 2).cast("int")
        parts = F.array(F.struct(F.col("a").alias("a"), middle.alias("z")), F.struct(middle.alias("a"), F.col("z").alias("z")))
        rows = keyed.where(F.col("hot")).select("word", "n", "base", F.explode(parts).alias("s")).select("word", "n", "base", "s.a", "s.z")


class _Order:
    """Words of some lengths in the order of (length, word), and for each prefix of each its interval there.

    texts: strings; kind: the length in whose order an entry stands; real: whether it is
    one of the words and not only asked for."""

    def __init__(self, texts: list[str], kind: np.ndarray, real: np.ndarray):
        order = np.array(sorted(range(len(texts)), key=lambda e: (kind[e], texts[e], not real[e])), dtype=np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(real[order])])
        self.rank = np.empty(len(texts), dtype=np.int64)
        self.rank[order] = before[:-1]
        self.at = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.low = np.zeros(int((lengths + 1).sum()), dtype=np.int32)
        self.high = np.zeros(len(self.low), dtype=np.int32)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        # places: of the order, those whose prefix of length p is shared with another entry.
        places = np.arange(len(order))
        new = np.ones(len(order), dtype=bool)
        new[1:] = kind[order][1:] != kind[order][:-1]
        p = 0
        while len(places):
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(places)))
            group = np.repeat(np.arange(len(starts)), sizes)
            low, high = before[places[starts]], before[places[starts + sizes - 1] + 1]
            e = order[places]
            self.low[self.at[e] + p], self.high[self.at[e] + p] = low[group], high[group]
            deeper = (sizes[group] > 1) & (lengths[e] > p)
            places, group, e = places[deeper], group[deeper], e[deeper]
            code = codes[first[e] + p]
            new = np.ones(len(places), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (code[1:] != code[:-1])
            p += 1


def near_pairs(words: list[str], asked: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words one edit apart, in both directions, for edits at the places
    [start, end) of the words with the numbers ``asked``: of equal length as seen from i,
    of unequal length where the shorter is asked for. words: ascending, all different.

    A code point inserted into a run of equal ones counts at the last place that gives
    the longer word, so no pair comes twice."""
    n = len(words)
    queries = np.unique(asked)
    texts = [*words, *(words[i] for i in queries)]
    length = np.array([len(w) for w in texts], dtype=np.int64)
    real = np.arange(len(texts)) < n
    kind = length + ~real
    forward, backward = _Order(texts, kind, real), _Order([t[::-1] for t in texts], kind, real)
    ys = np.empty(n, dtype=np.int64)
    ys[forward.rank[:n]] = backward.rank[:n]
    by_y = np.empty(n, dtype=np.int64)
    by_y[backward.rank[:n]] = np.arange(n)
    tree = WaveletMatrix(ys)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum(length[:n])])
    virtual = n + np.searchsorted(queries, asked)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for inserted, entry in ((0, asked), (1, virtual)):
        stop = np.minimum(end, length[asked] + inserted)
        counts = np.maximum(stop - start, 0)
        row = np.repeat(np.arange(len(asked)), counts)
        p = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + start[row]
        f = forward.at[entry[row]] + p
        b = backward.at[entry[row]] + length[asked[row]] - p - 1 + inserted
        # A replaced code point needs another word than w itself in both intervals.
        some = np.flatnonzero((forward.high[f] - forward.low[f] > 1 - inserted) & (backward.high[b] - backward.low[b] > 1 - inserted))
        for k in range(0, len(some), BLOCK):
            s = some[k : k + BLOCK]
            which, y = tree.report(forward.low[f[s]], forward.high[f[s]], backward.low[b[s]], backward.high[b[s]])
            i, place, j = asked[row[s[which]]], p[s[which]], by_y[y]
            if inserted:
                last = (place == length[i]) | (codes[first[j] + place] != codes[np.minimum(first[i] + place, len(codes) - 1)])
                out += [(i[last], j[last]), (j[last], i[last])]
            else:
                out.append((i[i != j], j[i != j]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=np.int64) for k in (0, 1))


def _found(table: pa.Table) -> pa.Table:
    """Of a shard's words: how many near ones were found here, and the most frequent of them, the smallest of equals."""
    rows = table.select(["word", "n", "base", "a", "z"]).to_pydict()
    known = dict(zip(rows["word"], rows["n"], strict=True))
    words = sorted(known)
    number = {w: k for k, w in enumerate(words)}
    n = np.array([known[w] for w in words], dtype=np.int64)
    own = [k for k, (w, base) in enumerate(zip(rows["word"], rows["base"], strict=True)) if len(w) == base]
    asked = np.array([number[rows["word"][k]] for k in own], dtype=np.int64)
    start, end = (np.array([rows[c][k] for k in own], dtype=np.int64) for c in ("a", "z"))
    i, j = near_pairs(words, asked, start, end)
    order = np.lexsort((j, -n[j], i))
    i, j = i[order], j[order]
    heads = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(heads, len(i)))
    out = {"word": [words[k] for k in i[heads].tolist()], "n_near": sizes, "near_n": n[j[heads]], "near": [words[k] for k in j[heads].tolist()]}
    return trimmed(pa.table(out, schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, near, near_n: of words (word, n; all different) how many others
    are one edit apart, and of these the most frequent, of equals the smallest; 0 and
    nulls if there is none."""
    small_batches(words.sparkSession)
    shards = max(16, 4 * words.count() // SHARD)
    rows = _dealt(words)
    shard = F.pmod(F.xxhash64(_key(F.col("word"), F.col("base"), F.col("a"), F.col("z"))), F.lit(shards)).cast("int")
    found = rows.withColumn("shard", shard).groupBy("shard").applyInArrow(_found, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    joined = words.join(summed, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: where following word, form leads. A form is TIMES as frequent as its
    variant, so chains are short and end; each round doubles the steps."""
    links = written(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of ``vocabulary``.

    form is the near word of largest n, the smallest of equals in the order of code
    points, if its n is TIMES the word's or more, else null; root is where forms lead
    to, the word itself without a form. A null or empty text, or one without long
    runs, adds no word; repeated rows count each; a very long run is a word like any
    other. Columns besides id and text aren't read. An empty table gives none.
    """
    words = written(vocabulary(df, id_col, text_col), "words")
    is_form = F.col("near_n") >= F.lit(TIMES) * F.col("n")
    found = written(near_words(words).select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "near")
    roots = rooted(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
