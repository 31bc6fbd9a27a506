"""Connected components of edges between long ids, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import written

_EDGE = "u long, v long"
_HELD = 500_000


def _forests(edges: DataFrame) -> DataFrame:
    """Spanning forests of bounded runs of edges: fewer edges, the same components."""

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        def out():
            nodes = list(root)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) > _HELD:
                yield out()
                root.clear()
        if root:
            yield out()

    return edges.select("u", "v").mapInArrow(contracted, _EDGE).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable, for each id that has an edge to another.

    edges: u, v, in any direction, repeated or not; those with nulls don't count.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now, before = written(_forests(now).distinct(), "edges"), None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = size
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        down = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = down.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
