"""Connected components by alternating large and small stars.

Tasks first contract the links they hold; then every round hangs nodes on smaller
ones until nothing changes. Links never reach the driver, only their count and
checksum do, and rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveframe.llm.common import stage

HELD = 200_000  # links a task contracts at a time


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        top = node
        while (up := self.parent.get(top, top)) != top:
            top = up
        while (up := self.parent.get(node, node)) != top and node != top:
            self.parent[node] = top
            node = up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, held = Forest(), 0

    def stars() -> pa.RecordBatch:
        pairs = [(node, forest.root(node)) for node in forest.parent]
        pairs = [pair for pair in pairs if pair[0] != pair[1]]
        columns = [pa.array([pair[side] for pair in pairs], pa.int64()) for side in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["node", "low"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a != b:
                forest.join(a, b)
                held += 1
        if held >= HELD:
            yield stars()
            forest, held = Forest(), 0
    yield stars()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("low").alias("node"), F.col("node").alias("low")))
    least = both.groupBy("node").agg(F.min("low").alias("least")).withColumn("least", F.least("node", "least"))
    return both.where("low > node").join(least, "node").select(F.col("low").alias("node"), F.col("least").alias("low"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("node").agg(F.min("low").alias("least"))
    hung = links.join(least, "node").where("low > least").select(F.col("low").alias("node"), F.col("least").alias("low"))
    return hung.unionAll(least.select("node", F.col("least").alias("low")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (two bigint columns): component is its smallest member."""
    a, b = links.columns
    links = links.select(F.col(a).alias("node"), F.col(b).alias("low")).mapInArrow(_contract, "node bigint, low bigint")
    links = stage(links.distinct(), "stars")
    state = _state(links)
    while state[0]:
        links = stage(_small_star(_large_star(links).distinct()).where("node <> low").distinct(), "stars")
        before, state = state, _state(links)
        if state == before:
            break
    nodes = links.select("node", F.col("low").alias("component"))
    return nodes.unionAll(links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
