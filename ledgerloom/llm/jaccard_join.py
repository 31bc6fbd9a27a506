"""Links between texts whose sets of word shingles have a high Jaccard similarity.

1. Copies with equal sets become one class. A count-min sketch finds shingles that no
   other text can have; a text with too many of them has no partner.
2. The rest learn the frequency of their shingles. Two linked texts share one of their
   rarest shingles (a prefix of the set in order of frequency). The texts that have a
   shingle in their prefix belong to its star, named after the smallest id among them:
   near copies, which share many shingles, have few stars, and a star holds direct
   neighbours only. Large stars are cut into blocks.
3. In a block, a T-occurrence search finds partners: DivideSkip sets the longest
   inverted lists aside, merges the short ones on a heap, and probes the long ones by
   binary search for those that occur often enough. Every pair of blocks of a star
   meets once, and every candidate is verified in the first star that it shares, so
   that links can be counted. Where components alone are wanted, a link inside a known
   one adds nothing and isn't sought.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import _exchange, count_min
from ledgerloom.llm._components import components
from ledgerloom.llm._shared import small_batches, trimmed, written
from ledgerloom.llm.exact_dedup import frequent
from ledgerloom.llm._words import Hasher, U, Words, inside, mix

SHINGLE = 4
#: Of a hundred: the least intersection for a union of 100.
SIMILARITY = 85
#: Shingles of a block of texts that are searched at once, and texts, on average.
BLOCK_SHINGLES = 1 << 17
BLOCK_ROWS = 512
#: Weight of probing against merging in the choice of how many lists are long.
MU = 0.001
_HASHER = Hasher(303)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, one after the other, and
    the bounds. A text with fewer than n words has its whole sequence as one."""
    words = Words.of(texts, lower=True)
    h, of = words.hashed(_HASHER), words.text
    full = inside(of, n)
    keys, owner = _HASHER.windows(h, n)[full], of[: len(full)][full]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        own = [mix(_HASHER.windows(h[words.first[d] : words.first[d + 1]], int(words.counts[d])) + U(int(words.counts[d]))) for d in short]
        keys, owner = np.concatenate([keys, *own]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(len(texts) + 1))


def needed(n: int, m, per_cent: int):
    """The least intersection of sets of n and m for the similarity."""
    return -(-per_cent * (n + m) // (100 + per_cent))


class _Groups:
    """Labels of items; joining relabels the smaller side."""

    def __init__(self, n: int):
        self.label, self.members = np.arange(n), {k: [k] for k in range(n)}

    def join(self, a: int, b: int) -> None:
        a, b = int(self.label[a]), int(self.label[b])
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            moved = self.members.pop(b)
            self.label[moved] = a
            self.members[a] += moved


class InvertedLists:
    """Positions of the texts that hold each token, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        _, first, inverse = np.unique(tokens[order], return_index=True, return_inverse=True)
        self.bounds, self.postings = np.append(first, len(tokens)), owner[order]
        place = np.empty(len(tokens), dtype=np.int64)
        place[order] = inverse
        ends = np.cumsum([len(s) for s in sets])
        self.lists = np.split(place, ends[:-1]) if sets else []
        self.lengths = np.diff(self.bounds)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.postings[self.bounds[k] : self.bounds[k + 1]]


def merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that occur in at least ``least`` of the lists, and in how many, by a heap over the lists."""
    found = [(p, len(list(same))) for p, same in groupby(heapq.merge(*(x.tolist() for x in lists if len(x))))]
    found = [(p, c) for p, c in found if c >= least]
    return np.array([p for p, _ in found], dtype=np.int64), np.array([c for _, c in found], dtype=np.int64)


def divided(index: InvertedLists, x: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts before x that the short ones of its lists hold often enough, how often, and the long lists, the longest last."""
    own = index.lists[x][np.argsort(index.lengths[index.lists[x]], kind="stable")]
    skip = min(least - 1, int(least / (MU * math.log2(int(index.lengths[own[-1]]) + 1) + 1)))
    short = [index[k] for k in own[: len(own) - skip].tolist()]
    at, counts = merged([row[: np.searchsorted(row, x)] for row in short], least - skip)
    return at, counts, own[len(own) - skip :]


def probed(index: InvertedLists, long: np.ndarray, tried: np.ndarray, seen: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Of the texts tried, seen so often, those that the long lists bring to what they need."""
    for left, k in zip(range(len(long), 0, -1), long.tolist(), strict=True):
        able = seen + left >= need
        if not able.all():
            tried, seen, need = tried[able], seen[able], need[able]
        if not len(tried):
            break
        row = index[k]
        seen = seen + (row[np.minimum(np.searchsorted(row, tried), len(row) - 1)] == tried)
    return tried[seen >= need]


def search(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], queries: np.ndarray, per_cent: int) -> list[tuple[int, int]]:
    """Links that span the components of all links between a query and a text before it.

    sizes: of the whole sets; sets: without shingles that no other text has. queries:
    positions, ascending.
    """
    index, groups, out = InvertedLists(sets), _Groups(len(ids)), []
    for x in queries.tolist():
        n = int(sizes[x])
        least = -(-per_cent * n // 100)
        if len(index.lists[x]) < least:
            continue
        at, counts, long = divided(index, x, least)
        m = sizes[at]
        fits = (100 * np.minimum(m, n) >= per_cent * np.maximum(m, n)) & (ids[at] != ids[x])
        at, counts = at[fits], counts[fits]
        for turn in range(len(at) + 1):
            other = groups.label[at] != groups.label[x]
            at, counts = at[other], counts[other]
            if not len(at):
                break
            if turn < 3:  # one text of each component first
                order = np.lexsort((-counts, groups.label[at]))
                labels = groups.label[at][order]
                chosen = order[np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))]
            else:
                chosen = np.arange(len(at))
            for y in probed(index, long, at[chosen], counts[chosen], needed(n, sizes[at[chosen]], per_cent)).tolist():
                if groups.label[y] != groups.label[x]:
                    groups.join(x, y)
                    out.append((int(ids[x]), int(ids[y])))
            rest = np.ones(len(at), dtype=bool)
            rest[chosen] = False
            at, counts = at[rest], counts[rest]
    return out


def count_links(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, elsewhere: list[list[int]], per_cent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that span the components, and for each text the number of all its links to
    texts before it; between two sides, or on the one that there is.

    sets: without shingles that no other text has. elsewhere: for each text the stars
    in which it has met others already; two texts that share one aren't linked again.
    """
    index, groups, out, n_links = InvertedLists(sets), _Groups(len(ids)), [], np.zeros(len(ids), dtype=np.int64)
    across = len(ids) > 0 and bool(side.min() != side.max())
    stars = {s: k for k, s in enumerate(sorted({s for own in elsewhere for s in own}))}
    met = np.zeros((len(ids), -(-len(stars) // 8) * 8), dtype=np.uint8)
    for x, own in enumerate(elsewhere):
        met[x, [stars[s] for s in own]] = 1
    met = np.packbits(met, axis=1)
    for x in range(len(ids)):
        n = int(sizes[x])
        least = -(-per_cent * n // 100)
        if len(index.lists[x]) < least:
            continue
        tried, seen, long = divided(index, x, least)
        m = sizes[tried]
        fits = (100 * np.minimum(m, n) >= per_cent * np.maximum(m, n)) & (ids[tried] != ids[x])
        if across:
            fits &= side[tried] != side[x]
        if len(stars):
            fits &= ~(met[tried] & met[x]).any(axis=1)
        tried = tried[fits]
        tried = probed(index, long, tried, seen[fits], needed(n, sizes[tried], per_cent))
        n_links[x] = len(tried)
        while len(tried := tried[groups.label[tried] != groups.label[x]]):
            groups.join(x, int(tried[0]))
            out.append((int(ids[x]), int(ids[tried[0]])))
    return out, n_links


def _classes(df: DataFrame, n: int, per_cent: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, digest of the set, live (its shingles that others may have; null if it can't have a partner)."""
    n_bytes = count_min.text_bytes(df, text_col)
    places = _exchange.chunks_for(n_bytes)
    width = count_min.slice_cells(n_bytes, places)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("live", T.BinaryType())])

    def sketch(ids: list, texts: list[bytes], answers: list) -> dict[int, bytes]:
        return count_min.Touched(shingle_sets(texts, n)[0], places, width).parts()

    def made(ids: list, texts: list[bytes], answers: list[dict[int, bytes]]) -> pa.Table:
        keys, bounds = shingle_sets(texts, n)
        maybe = count_min.Touched(keys, places, width).repeated(answers[0])
        digests, live = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = keys[a:b]
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if b > a else None)
            kept = own[maybe[a:b]]
            live.append(kept.tobytes() if b > a and 100 * len(kept) >= per_cent * (b - a) else None)
        return pa.table([pa.array(ids, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.binary()), pa.array(live, pa.binary())], schema=_exchange.arrow_schema(schema))

    docs = _exchange.chunked(df, id_col, text_col, places)
    answers = _exchange.ask(docs, sketch, lambda parts, bucket: count_min.merged(parts, width), places)
    return written(_exchange.finish(docs, made, schema, [answers]), "sets")


def _ranked(classes: DataFrame, per_cent: int) -> DataFrame:
    """rid, n, tokens (rarest first, without those of one class only) and prefix of the classes that can have partners."""
    able = classes.where("live IS NOT NULL AND id IS NOT NULL")
    places = _exchange.chunks_for(count_min.text_bytes(able, "live"))
    own = able.groupBy("digest").agg(F.min("id").alias("rid"), F.first("n").alias("n"), F.first("live").alias("live"))
    sized = F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), F.col("live"))
    docs = _exchange.packed(own.select(F.pmod(F.xxhash64("rid", "digest"), F.lit(places)).cast("int").alias("chunk"), F.col("rid").alias("id"), sized.alias("text")))

    def parsed(texts: list[bytes]):
        sets = [np.frombuffer(t, dtype=np.uint64, offset=8) for t in texts]
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        return sets, tokens, counts, _exchange.runs(_exchange.buckets_of(tokens, places))

    def send(ids: list, texts: list[bytes], answers: list) -> dict[int, bytes]:
        _, tokens, counts, cuts = parsed(texts)
        return {k: _exchange.Writer().steps(tokens[a:b].view(np.int64), 8).put(counts[a:b], 4).done(b - a) for k, a, b in cuts}

    def answer(blobs: list[bytes], bucket: int) -> list[bytes]:
        tokens, counts, sizes = [], [], []
        for blob in blobs:
            read = _exchange.Reader(blob, 1)
            sizes += read.sizes
            tokens.append(read.steps(sizes[-1], 8))
            counts.append(read.take(sizes[-1], 4))
        _, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts))[inverse]
        return [_exchange.Writer().put(np.minimum(x, 2**32 - 1).astype(np.int64), 4).done(len(x)) for x in np.split(total, np.cumsum(sizes)[:-1])]

    def done(ids: list, texts: list[bytes], answers: list[dict[int, bytes]]) -> pa.Table:
        sets, tokens, _, cuts = parsed(texts)
        often = np.zeros(len(tokens), dtype=np.int64)
        for k, a, b in cuts:
            often[a:b] = _exchange.Reader(answers[0][k], 1).take(b - a, 4)
        rows = []
        for rid, text, own in zip(ids, texts, sets, strict=True):
            n, count = int.from_bytes(text[:8], "big"), often[np.searchsorted(tokens, own)]
            shared = own[count >= 2]
            prefix = n - (-(-per_cent * n // 100)) + 1 - (n - len(shared))
            if prefix > 0:
                shared = shared[np.lexsort((shared, count[count >= 2]))]
                rows.append((rid, n, shared.tobytes(), shared[:prefix].view(np.int64).tolist()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], schema=_exchange.arrow_schema(schema))

    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return written(_exchange.finish(docs, done, schema, [_exchange.ask(docs, send, answer, places)]), "ranked")


def _starred(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rid, n, tokens and stars (ascending) of the texts that share a prefix shingle; star and blocks of each star."""
    tokens = ranked.select("rid", F.explode("prefix").alias("token"))
    firsts = tokens.groupBy("token").agg(F.min("rid").alias("star"), F.count("*").alias("c")).where("c > 1")
    members = written(tokens.join(firsts, "token").select("rid", "star").distinct(), "stars")
    size = members.join(ranked.select("rid", "n"), "rid").groupBy("star").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    blocks = size.where("rows > 1").select("star", F.ceil(F.greatest(F.col("n") / BLOCK_SHINGLES, F.col("rows") / BLOCK_ROWS)).cast("int").alias("blocks"))
    stars = members.join(blocks, "star", "left_semi").groupBy("rid").agg(F.array_sort(F.collect_list("star")).alias("stars"))
    return ranked.drop("prefix").join(stars, "rid"), written(blocks, "blocks")


def _links(placed: DataFrame, keys: list[str], per_cent: int) -> DataFrame:
    """u, v: spanning links of each group of placed (rid, n, tokens, query)."""

    def found(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["query"].to_pylist(), table["n"].to_pylist(), table["rid"].to_pylist(), table["tokens"].to_pylist(), strict=True), key=lambda r: r[:3])
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        queries = np.flatnonzero([r[0] for r in rows])
        links = search(np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), sets, queries, per_cent)
        return trimmed(pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())}))

    return placed.groupBy(*keys).applyInArrow(found, "u long, v long")


def _all_links(own: DataFrame, blocks: DataFrame, per_cent: int) -> DataFrame:
    """u, v: spanning links, n null; and u with the number n of its links, v null. Each two texts of a star meet in one task."""
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = own.withColumn("star", F.explode("stars")).join(blocks, "star").withColumn("side", F.pmod(F.xxhash64("rid"), "blocks").cast("int")).withColumn("other", F.explode(every))
    before = F.filter("stars", lambda s: s < F.col("star")).alias("elsewhere")
    dealt = placed.select("star", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "rid", "n", "tokens", before)

    def found(table: pa.Table) -> pa.Table:
        columns = (table[c].to_pylist() for c in ("n", "rid", "side", "tokens", "elsewhere"))
        rows = sorted(zip(*columns, strict=True), key=lambda r: r[:2])
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        # A pair of blocks of which one is empty has no links; both sides alike would be counted again.
        if low != high and len({r[2] for r in rows}) < 2:
            rows = []
        ids = np.array([r[1] for r in rows], dtype=np.int64)
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        links, counts = count_links(ids, np.array([r[0] for r in rows], dtype=np.int64), sets, np.array([r[2] for r in rows], dtype=np.int64), [r[4] for r in rows], per_cent)
        some = np.flatnonzero(counts)
        return trimmed(pa.table({
            "u": pa.array([a for a, _ in links] + ids[some].tolist(), pa.int64()),
            "v": pa.array([b for _, b in links] + [None] * len(some), pa.int64()),
            "n": pa.array([None] * len(links) + counts[some].tolist(), pa.int64()),
        }))

    # By all keys, so that the blocks of a star don't meet in one task.
    keys = ["star", "low", "high"]
    return written(dealt.repartition(*keys).groupBy(*keys).applyInArrow(found, "u long, v long, n long"), "links")


def _spanning_links(ranked: DataFrame, per_cent: int, count: bool = False) -> DataFrame:
    """u, v; with count as _all_links."""
    own, blocks = _starred(ranked)
    if count:
        return _all_links(own, blocks, per_cent)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = own.withColumn("star", F.explode("stars")).drop("stars").join(blocks, "star").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
    part = placed.withColumn("part", F.explode(F.when(F.col("block") == 0, every).otherwise(F.array("block"))))
    # By both keys, so that the blocks of a star don't meet in one task.
    dealt = part.withColumn("query", F.col("part") == F.col("block")).repartition("star", "part")
    links = written(_links(dealt, ["star", "part"], per_cent), "links")
    if not blocks.where("blocks > 1").limit(1).count():
        return links
    # Where a star has several blocks, texts outside its largest component still meet every block.
    known = components(links)
    known = known.unionByName(known.select(F.col("component").alias("id"), "component").distinct())
    large = placed.where("blocks > 1").join(known, F.col("rid") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rid"))
    sizes = large.groupBy("star", "component").count()
    most = sizes.groupBy("star").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    outside = large.join(most, "star").where("component <> largest").select("star", "blocks", "rid", "n", "tokens", F.pmod(F.xxhash64("rid", F.lit(1)), "blocks").cast("int").alias("asking"))
    outside = written(outside, "outside")
    asking = outside.select("star", "asking").distinct()
    queries = outside.withColumn("block", F.explode(every)).withColumn("query", F.lit(True))
    index = placed.where("blocks > 1").join(asking, "star").withColumn("query", F.lit(False))
    same = ["star", "asking", "block", "rid", "n", "tokens", "query"]
    more = _links(queries.select(*same).unionByName(index.select(*same)).repartition("star", "asking", "block"), ["star", "asking", "block"], per_cent)
    return links.unionByName(written(more, "links"))


def join_similar(df: DataFrame, n: int = SHINGLE, per_cent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row for each row: id, n_shingles, component_id (the smallest id reachable by links).

    Two rows link if 100 * intersection >= per_cent * union of their sets. Rows without
    words link with nothing. A row with a null id gets the component of its copies,
    null if they have no id either, and makes no links of its own. Rows of the same id
    are separate rows that share it. Ids are integers; other columns aren't read.

    links: every link is sought, and n_links says how many there are in the row's
    component between different sets; rows with equal sets count as one, under their
    smallest id. Different sets under the same smallest id have no link.
    """
    small_batches(df.sparkSession)
    rows = _classes(df.withColumn(id_col, F.col(id_col).cast("long")), n, per_cent, id_col, text_col)
    found = _spanning_links(_ranked(rows, per_cent), per_cent, links)
    linked = components(found.select("u", "v").where("v IS NOT NULL"))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rid"))
    classes = classes.join(linked.withColumnRenamed("id", "other"), F.col("rid") == F.col("other"), "left").select("digest", F.coalesce("component", "rid").alias("found"))
    more = []
    if links:
        per_text = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
        counts = per_text.join(linked, F.col("u") == F.col("id"), "left").groupBy(F.coalesce("component", "u").alias("of")).agg(F.sum("n").alias("n_links"))
        classes = classes.join(counts, F.col("found") == F.col("of"), "left").select("digest", "found", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    # Classes that hold a large share of the rows are few: they are broadcast, the others are shuffled.
    own = rows.drop("live")
    often = frequent(own.select("id", "digest").where("digest IS NOT NULL")).select("digest")
    large = F.broadcast(written(classes.join(F.broadcast(often), "digest", "left_semi"), "large"))
    found = own.join(large, "digest", "inner").unionByName(own.join(F.broadcast(often), "digest", "left_anti").join(classes, "digest", "left"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("id")).alias("component_id"), *more)


def drop_similar(df: DataFrame, n: int = SHINGLE, per_cent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the row of the smallest id of each component only, with df's columns.
    Rows without words and rows without an id stay."""
    found = join_similar(df, n, per_cent, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return df.join(gone, df[id_col] == gone["__gone"], "left_anti").select(*df.columns)
