"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, top = self.parent, x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in self.parent]


def contracted(edges: DataFrame) -> DataFrame:
    """The same components by fewer and shorter paths: every partition's edges become stars around their least nodes.

    A task holds the nodes of its own partition.
    """

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for frame in frames:
            for a, b in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                forest.join(a, b)
        stars = forest.stars()
        for at in range(0, len(stars), 100_000):
            part = stars[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in part], pa.int64()), pa.array([b for _, b in part], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, task_edges: int = 400_000) -> DataFrame:
    """(id, label): for each node of ``edges`` (a, b) the least node that can be reached from it.

    Edges are contracted where they lie, and what is left again in as few tasks as hold ``task_edges`` each. If that is
    one, its stars are the answer. If more, every round gives each node the least label of its neighbours and then the
    label of its label, so chains shrink by half at least. Labels only fall; the loop ends when their sum stays. Both
    sides of each join are written tables, so that adaptive execution can split the node that a third of the edges meet.
    """
    pairs = cut(contracted(edges.where("a <> b").distinct()))
    tasks = max(1, -(-pairs.count() // task_edges))
    pairs = cut(contracted(pairs.coalesce(tasks)))
    if tasks == 1:
        roots = pairs.where("a <> b").select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
        return cut(pairs.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(roots))
    pairs = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut(pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("label")))
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        heard = pairs.join(labels, pairs["b"] == labels["id"]).select(F.col("a").alias("id"), "label")
        spread = cut(heard.unionByName(labels).groupBy("id").agg(F.min("label").alias("label")))
        onward = spread.select(F.col("id").alias("of"), F.col("label").alias("next"))
        labels = cut(spread.join(onward, F.col("label") == F.col("of")).select("id", F.least("label", "next").alias("label")))
