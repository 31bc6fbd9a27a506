"""Exact top-k by inner product: best-first search in M-trees.

Vectors are lifted by one coordinate so that the largest inner product is the least
Euclidean distance. Each goes to the nearest of a bounded number of pivots, and the
vectors of a pivot, cut into blocks if they are many, are bulk-loaded into a tree of
pages: an inner entry holds a routing vector, its covering radius and its distance to
the routing vector above; a leaf entry holds the latter. Stored distances and the
triangle inequality spare most distance computations.

A query searches the tree that it lies in first. Its k-th score there is the bound with
which it asks the others, and only those whose root's bound isn't beyond it. Scores are
exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import small_batches, trimmed, written

SCALE = 1024
LEAF = 256
FANOUT = 16
#: Vectors of a tree, at most, on average, and of a pivot as long as pivots are few enough.
BLOCK_ROWS = 8192
PIVOT_ROWS = 2048
PIVOTS = 1024
#: Queries that meet a tree at once.
QUERY_ROWS = 2048
#: Bytes of roots, at most, that are broadcast to spare queries trees; beyond, queries ask all trees.
ROOT_BYTES = 64 << 20
_FOUND = "query_id long, vec_id long, score long"


class MTree:
    """Pages over the rows of an integer matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        """top: the largest squared length of all vectors."""
        self.ids, self.vectors, self.top = ids, vectors, top
        most = int(np.abs(vectors).max(initial=0))
        if most * most * max(1, vectors.shape[1]) >= 1 << 62:  # sums may leave 64 bits
            self.vectors = vectors.astype(object)
        self.points = lifted(vectors, top)
        #: Of each page: whether it is a leaf, its entries (rows or pages) and their distances to the page's routing vector.
        self.pages: list[tuple[bool, np.ndarray, np.ndarray]] = []
        self.centers: list[np.ndarray] = []
        self.radii: list[float] = []
        self.root = self._load(np.arange(len(ids))) if len(ids) else -1

    def _load(self, rows: np.ndarray) -> int:
        points = self.points[rows]
        mean = points.mean(0)
        center = points[np.argmin(((points - mean) ** 2).sum(1))]
        away = np.sqrt(((points - center) ** 2).sum(1))
        page = len(self.pages)
        self.pages.append((True, rows, away))
        self.centers.append(center)
        self.radii.append(float(away.max()))
        if len(rows) > LEAF and self.radii[page] > 0:
            chosen = [int(np.argmax(away))]
            near = np.sqrt(((points - points[chosen[0]]) ** 2).sum(1))
            nearest = np.zeros(len(rows), dtype=np.int64)
            while len(chosen) < FANOUT and near.max() > 0:
                chosen.append(int(np.argmax(near)))
                to = np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1))
                nearest[to < near] = len(chosen) - 1
                near = np.minimum(near, to)
            if len(chosen) > 1:
                below = [self._load(rows[nearest == k]) for k in range(len(chosen)) if (nearest == k).any()]
                self.pages[page] = (False, np.array(below), np.array([np.sqrt(((self.centers[b] - center) ** 2).sum()) for b in below]))
        return page

    def search(self, own: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best rows whose id isn't own, without scores below least; ties go to the smaller id."""
        if self.root < 0:
            return []
        query = query.astype(self.vectors.dtype)
        q = np.append(query.astype(np.float64), 0.0)
        base = float((q * q).sum()) + self.top
        best: list[tuple[int, int]] = []
        limit = np.inf if least is None else reach(base, least)
        to_root = float(np.sqrt(((self.centers[self.root] - q) ** 2).sum()))
        queue = [(max(0.0, to_root - self.radii[self.root]), self.root, to_root)]
        while queue:
            bound, page, to_center = heapq.heappop(queue)
            if bound > limit:
                break
            leaf, entries, away = self.pages[page]
            if leaf:
                rows = entries[np.abs(to_center - away) <= limit]
                scores = self.vectors[rows] @ query
                ids = self.ids[rows]
                able = ids != own
                if least is not None:
                    able &= scores >= least
                if len(best) == k:
                    able &= scores >= best[-1][0]
                scores, ids = scores[able], ids[able]
                if len(scores):
                    order = np.lexsort((ids, -scores))[:k]
                    best = sorted([*best, *((int(scores[o]), int(ids[o])) for o in order)], key=lambda b: (-b[0], b[1]))[:k]
                    if len(best) == k:
                        limit = min(limit, reach(base, best[-1][0]))
            else:
                for child, stored in zip(entries.tolist(), away.tolist(), strict=True):
                    if abs(to_center - stored) - self.radii[child] <= limit:
                        to = float(np.sqrt(((self.centers[child] - q) ** 2).sum()))
                        if (low := max(0.0, to - self.radii[child] - 1e-9 * (to + 1.0))) <= limit:
                            heapq.heappush(queue, (low, child, to))
        return best


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    points = vectors.astype(np.float64)
    return np.column_stack([points, np.sqrt(np.maximum(top - (points**2).sum(1), 0))])


def reach(base: float, score: int) -> float:
    """The distance of a point with a score from a query whose squared length and the lift are base, rounded up."""
    return float(np.sqrt(max(0.0, base - 2.0 * float(score)) + 1e-9 * (base + 1.0)))


def packed(vectors: np.ndarray) -> bytes:
    """The integers in as few of 2, 4 or 8 bytes as hold all of them."""
    most = max(-int(vectors.min(initial=0)) - 1, int(vectors.max(initial=0)))
    return vectors.astype(next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max or t == "<i8")).tobytes()


def unpacked(blob: bytes, rows: int, size: int) -> np.ndarray:
    width = len(blob) // (rows * size) if rows * size else 8
    return np.frombuffer(blob, dtype=f"<i{width}").astype(np.int64).reshape(rows, size)


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _assigned(own: DataFrame, rows: int, top: float) -> DataFrame:
    """own with the pivot nearest to each vector, of a bounded number that a hash of ids chooses; -1 without one of its length."""
    n = min(PIVOTS, max(1, rows // PIVOT_ROWS))
    chosen = [np.array(r[0], dtype=np.int64) for r in own.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(n).select("vector").collect()]
    pivots = {size: lifted(np.stack([v for v in chosen if len(v) == size]), top) for size in {len(v) for v in chosen}}
    shared = own.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = batch["size"].to_numpy(), np.full(batch.num_rows, -1, dtype=np.int32)
            for size, points in shared.value.items():
                at = np.flatnonzero(sizes == size)
                for part in np.array_split(at, -(-len(at) // 500) or 1):
                    if len(part):
                        v = lifted(batch["vector"].take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), size), top)
                        out[part] = ((points**2).sum(1) - 2 * v @ points.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "pivot"])
        trimmed(None)

    return own.mapInArrow(nearest, "vec_id long, vector array<long>, size int, pivot int")


def search_top(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each
    query, a row whose id is divisible by ``every``, with all other ids.

    Vectors that are null or hold null or non-finite components, and rows without an id,
    take no part. Vectors of other lengths aren't candidates; empty ones have the score
    0. Of repeated ids the row of the smallest vector asks, and each is a candidate. A
    score beyond 64 bits raises an error.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = df.where(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    own = own.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("vector")).withColumn("size", F.size("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows, top = own.agg(F.count("*"), F.max(square)).first()
    top = float(top or 0.0)
    assigned = written(_assigned(own, rows, top), "assigned")
    blocks = assigned.groupBy("size", "pivot").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int")
    placed = assigned.join(blocks, ["size", "pivot"]).withColumn("block", block)
    tree = ["size", "pivot", "block"]

    def built(table: pa.Table) -> pa.Table:
        ids, vectors = _matrix(table)
        own = MTree(ids, vectors, top)
        columns = [table[c].slice(0, 1) for c in tree]
        blobs = [ids.tobytes(), packed(vectors), own.centers[own.root].tobytes()]
        return trimmed(pa.table([*columns, *(pa.array([x], pa.binary()) for x in blobs), pa.array([own.radii[own.root]])], names=[*tree, "ids", "vectors", "center", "radius"]))

    pages = written(placed.groupBy(*tree).applyInArrow(built, "size int, pivot int, block int, ids binary, vectors binary, center binary, radius double"), "pages")
    asks = Window.partitionBy("vec_id").orderBy("size", "vector")
    queries = placed.where(F.col("vec_id") % every == 0).withColumn("nth", F.row_number().over(asks)).where("nth = 1").drop("nth", "blocks")
    queries = written(queries, "queries")
    none = F.lit(None).cast("long").alias("least")
    first = written(_searched(pages, queries.select(*tree, "vec_id", "vector", none), k, top), "first")
    bound = F.when(F.count("*") >= k, F.min("score"))
    known = queries.join(first.groupBy(F.col("query_id").alias("vec_id")).agg(bound.alias("least")), "vec_id", "left")
    rest = _searched(pages, _routed(pages, known, top), k, top)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _routed(pages: DataFrame, queries: DataFrame, top: float) -> DataFrame:
    """The other trees that each query has to ask, with its vector and bound."""
    asking = queries.select("vec_id", "vector", "least", "size", F.col("pivot").alias("own_pivot"), F.col("block").alias("own_block"))
    roots = pages.select("size", "pivot", "block", "center", "radius")
    elsewhere = (F.col("pivot") != F.col("own_pivot")) | (F.col("block") != F.col("own_block"))
    if (roots.agg(F.sum(F.octet_length("center") + 64)).first()[0] or 0) > ROOT_BYTES:
        return asking.join(roots.drop("center", "radius"), "size").where(elsewhere).drop("own_pivot", "own_block")
    held: dict = {}
    for r in sorted(roots.collect(), key=lambda r: r[:3]):
        held.setdefault(r["size"], []).append(r)
    made = {
        size: (np.array([r["pivot"] for r in own], dtype=np.int32), np.array([r["block"] for r in own], dtype=np.int32), np.stack([np.frombuffer(r["center"]) for r in own]), np.array([r["radius"] for r in own]))
        for size, own in held.items()
    }
    shared = pages.sparkSession.sparkContext.broadcast(made)

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (size, vector, least, pivot, block) in enumerate(zip(*(batch[c].to_pylist() for c in ("size", "vector", "least", "own_pivot", "own_block")), strict=True)):
                pivots, numbers, centers, radii = shared.value[size]
                q = np.append(np.array(vector, dtype=np.float64), 0.0)
                to = np.sqrt(((centers - q) ** 2).sum(1))
                limit = np.inf if least is None else reach(float((q * q).sum()) + top, least)
                at = np.flatnonzero((to - radii - 1e-9 * (to + 1.0) <= limit) & ((pivots != pivot) | (numbers != block)))
                same = batch.select(["vec_id", "vector", "least", "size"]).take(pa.array(np.full(len(at), row)))
                yield pa.RecordBatch.from_arrays([*same.columns, pa.array(pivots[at]), pa.array(numbers[at])], ["vec_id", "vector", "least", "size", "pivot", "block"])

    return asking.mapInArrow(able, "vec_id long, vector array<long>, least long, size int, pivot int, block int")


def _searched(pages: DataFrame, asking: DataFrame, k: int, top: float) -> DataFrame:
    """The best of each tree for the queries that ask it (size, pivot, block, vec_id, vector, least)."""
    tree = ["size", "pivot", "block"]
    parts = asking.groupBy(*tree).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    dealt = asking.join(parts, tree).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")).cast("int"))

    def gathered(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, vectors = table["vec_id"].to_numpy(), table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        least = pa.array([table["least"].to_pylist()], pa.list_(pa.int64()))
        return pa.table([*(table[c].slice(0, 1) for c in tree), pa.array([ids.tobytes()], pa.binary()), pa.array([packed(vectors)], pa.binary()), least], names=[*tree, "query_ids", "query_vectors", "least"])

    groups = dealt.groupBy(*tree, "part").applyInArrow(gathered, "size int, pivot int, block int, query_ids binary, query_vectors binary, least array<long>")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, asked = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["query_ids"], dtype=np.int64)
                own = MTree(ids, unpacked(row["vectors"], len(ids), row["size"]), top)
                vectors = unpacked(row["query_vectors"], len(asked), row["size"])
                found = [(q, i, s) for q, v, least in zip(asked.tolist(), vectors, row["least"], strict=True) for s, i in own.search(q, v, k, least)]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])
        trimmed(None)

    # Each query is here once for each tree that it asks, far beyond what its plan lets expect: neither side is broadcast.
    met = groups.hint("merge").join(pages.select(*tree, "ids", "vectors"), tree).select("size", "ids", "vectors", "query_ids", "query_vectors", "least")
    # Dealt in turn, so that each task has as many trees.
    return met.repartition(max(2, pages.count())).mapInArrow(searched, _FOUND)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, ascending by id and vector."""
    ids, size = table["vec_id"].to_numpy(), table["size"][0].as_py()
    flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)
    order = np.lexsort((*flat.T[::-1], ids))
    return np.ascontiguousarray(ids[order]), np.ascontiguousarray(flat[order].astype(np.int64))
