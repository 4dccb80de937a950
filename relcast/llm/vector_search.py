"""Exact top-k search by inner product with a vector-approximation file.

The different vectors are written once with a number, and beside them the approximation file: blocks of packed cells, in
which every component is quantised to ``bits`` bits of its range in the block. Only cells are scanned: pieces of the file
meet chunks of queries, bounds of each inner product follow from the cells, and a task keeps those vectors of each query
whose upper bound isn't under the lower bounds of enough others. Exact vectors are fetched by number and read in the order of their bounds, in rounds,
until the kth best score is at least any bound left.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class SearchParams:
    k: int = 5
    bits: int = 6  # of a cell
    vector_block: int = 2048  # vectors with one range for each dimension
    piece_vectors: int = 1 << 20  # of the file that a task scans at most,
    least_vectors: int = 1 << 12  # and at least, if that makes fewer pieces than shuffle partitions
    query_chunk: int = 1 << 14  # queries that a task holds
    read: int = 32  # exact vectors read in the first round; each round reads ``more`` times as many
    more: int = 8


def whole_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as integers; null if the vector or a component is null or not finite.

    A component whose product is no bigint raises an error: cut off at the greatest bigint it would give wrong scores.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    large = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= 2.0**63)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return F.when(vector.isNotNull() & fine, F.when(large, F.raise_error(F.lit("a component is no bigint")).cast("array<bigint>")).otherwise(whole))


def packed(cells: np.ndarray, bits: int) -> bytes:
    """Cells below 2^bits, ``bits`` bits each."""
    return np.packbits(np.unpackbits(cells.astype(np.uint8).reshape(-1, 1), axis=1)[:, 8 - bits :]).tobytes()


def unpacked(raw: bytes, rows: int, dim: int, bits: int) -> np.ndarray:
    wide = np.zeros((rows * dim, 8), np.uint8)
    wide[:, 8 - bits :] = np.unpackbits(np.frombuffer(raw, np.uint8), count=rows * dim * bits).reshape(-1, bits)
    return np.packbits(wide, axis=1).reshape(rows, dim)


def approximations(entries: DataFrame, params: SearchParams) -> DataFrame:
    """(dim, rows, low, width, cells, places): the file, from ``entries`` (entry, v); one pass.

    A component is at least low + width * cell and less than that plus its width.
    """

    def block(dim: int, held: list[tuple[int, list[int]]]) -> tuple:
        exact = np.array([v for _, v in held], np.int64).reshape(len(held), dim)
        if dim and max(int(exact.max()), -int(exact.min())) >> 61:
            exact = exact.astype(object)  # the span of two bigints is no bigint
        low = exact.min(0)
        width = np.maximum(1, -((low - exact.max(0) - 1) // (1 << params.bits)))
        cells = (exact - low) // width
        return dim, len(held), low.astype(np.float64).tobytes(), width.astype(np.float64).tobytes(), packed(cells, params.bits), np.array([e for e, _ in held], np.int64).tobytes()

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int]]]] = {}

        def made(dim: int) -> pa.RecordBatch:
            kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(block(dim, held.pop(dim)), kinds, strict=True)], ["dim", "rows", "low", "width", "cells", "places"])

        for frame in frames:
            for entry, v in zip(frame.column("entry").to_pylist(), frame.column("v").to_pylist(), strict=True):
                held.setdefault(len(v), []).append((entry, v))
                if len(held[len(v)]) == params.vector_block:
                    yield made(len(v))
        for dim in list(held):
            yield made(dim)

    return entries.select("entry", "v").mapInArrow(run, "dim int, rows int, low binary, width binary, cells binary, places binary")


class Scan:
    """What a task knows of a chunk of queries (rows of ``queries``) while it scans its blocks."""

    def __init__(self, ids: list[int], queries: np.ndarray, wanted: int):
        self.ids, self.queries, self.wanted = np.array(ids, np.int64), queries.astype(np.float64), wanted
        self.least = np.full((len(ids), wanted), -np.inf)  # the greatest lower bounds so far
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def block(self, low: np.ndarray, width: np.ndarray, cells: np.ndarray, places: np.ndarray) -> None:
        for at in range(0, len(self.ids), 256):
            q = self.queries[at : at + 256]
            near = (q @ low)[:, None] + (q * width) @ cells.T.astype(np.float64)
            # more than what rounding can take from sums of so many products
            slack = (np.abs(q) @ (np.abs(low) + 256.0 * width)) * (len(low) + 4) * 2.0**-51
            slack = np.where(slack < 0.25, 0.0, slack)
            upper = near + (np.maximum(q, 0) @ (width - 1) + slack)[:, None]
            lower = near + (np.minimum(q, 0) @ (width - 1) - slack)[:, None]
            best = np.concatenate([self.least[at : at + 256], lower], 1)
            best = np.partition(best, best.shape[1] - self.wanted, 1)[:, -self.wanted :]
            self.least[at : at + 256] = best
            row, col = np.nonzero(upper >= best.min(1)[:, None])
            self.held.append((row + at, places[col], lower[row, col], upper[row, col]))
            self.rows += len(row)
        if self.rows > 1_000_000:
            self.held = [self.left()]
            self.rows = 0

    def left(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row, place, lower, upper = (np.concatenate(x) for x in zip(*self.held, strict=True))
        on = upper >= self.least.min(1)[row]
        return row[on], place[on], lower[on], upper[on]

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            row, place, lower, upper = self.left()
            for k in range(0, len(row), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[row[part]]), pa.array(place[part]), pa.array(lower[part]), pa.array(upper[part])], ["query", "entry", "lower", "upper"])


def scan(file: DataFrame, queries: DataFrame, params: SearchParams) -> DataFrame:
    """(query, entry, lower, upper): the vectors that may be among a query's k + 1 best, by the cells alone.

    ``file`` is written; ``queries`` has query and v, each query once. Blocks are dealt to pieces and queries to chunks;
    with one chunk, cells are sent once.
    """
    vectors, blocks = file.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    tasks = int(file.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(1, -(-vectors // params.piece_vectors), min(tasks, vectors // params.least_vectors, blocks))
    chunks = max(1, -(-queries.count() // params.query_chunk))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = F.lit(None).cast("binary")
    asked = queries.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int").alias("chunk"), every(pieces).alias("piece"), F.lit(0).alias("rows"), F.col("query"), F.col("v"), nothing.alias("low"), nothing.alias("width"), nothing.alias("cells"), nothing.alias("places"))
    there = file.select("dim", every(chunks).alias("chunk"), F.pmod(F.xxhash64("places"), F.lit(pieces)).cast("int").alias("piece"), "rows", F.lit(None).cast("bigint").alias("query"), F.lit(None).cast("array<bigint>").alias("v"), "low", "width", "cells", "places")
    keys = ["dim", "chunk", "piece"]
    # queries have no rows, so they come before the blocks
    met = asked.unionByName(there).repartition(*keys).sortWithinPartitions(*keys, "rows")

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, task = None, [], [], None
        for frame in frames:
            for *key, rows, query, v, low, width, cells, places in zip(*[frame.column(c).to_pylist() for c in (*keys, "rows", "query", "v", "low", "width", "cells", "places")], strict=True):
                if key != at:
                    if task is not None:
                        yield from task.batches()
                    at, ids, vectors, task = key, [], [], None
                if rows == 0:
                    ids.append(query)
                    vectors.append(v)
                elif ids:
                    task = task or Scan(ids, np.array(vectors, np.int64).reshape(len(ids), key[0]), params.k + 1)
                    task.block(np.frombuffer(low), np.frombuffer(width), unpacked(cells, rows, key[0], params.bits), np.frombuffer(places, np.int64))
        if task is not None:
            yield from task.batches()

    return met.mapInArrow(run, "query bigint, entry bigint, lower double, upper double")


def survivors(found: DataFrame, k: int) -> DataFrame:
    """The rows of ``found`` whose upper bound isn't under the (k + 1)th lower bound of their query over all pieces."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("lower").desc()))
    least = found.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("query").agg(F.min("lower").alias("least"), F.max("place").alias("places"))
    # one entry may hold the query alone, so k + 1 entries have k others
    least = least.select(F.col("query").alias("of"), F.when(F.col("places") > k, F.col("least")).alias("least"))
    return found.join(least, F.col("query") == F.col("of")).where("least IS NULL OR upper >= least").select("query", "entry", "upper")


def search(vectors: DataFrame, is_query: Column, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all other vectors, exactly.

    ``vectors`` has id (integer) and v (bigints, or null); ``is_query`` is a condition on id. Ties go to the smaller id.
    Vectors that are null or have a null id take no part, vectors of different length are not compared, equal rows count
    once and, of rows that share an id, the best score counts. With fewer than k others all are returned; an empty table
    gives an empty result. Scores are sums of decimals; one of an answer that is no bigint raises an error.
    """
    k = params.k
    rows = vectors.select("id", "v").where("id IS NOT NULL AND v IS NOT NULL")
    # of equal vectors no query needs more than the k + 1 least ids; the limit works before the exchange
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    grouped = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = cut(grouped.withColumn("entry", F.monotonically_increasing_id()))
    asking = cut(rows.where(is_query).distinct().select(F.col("id").alias("query_id"), "v").withColumn("query", F.monotonically_increasing_id()))
    found = cut(scan(cut(approximations(entries, params)), asking.select("query", "v"), params))
    left = cut(survivors(found, k))
    best, width = None, params.read
    while True:
        order = Window.partitionBy("query").orderBy(F.col("upper").desc(), "entry")
        ranked = left.withColumn("place", F.row_number().over(order))
        got = exact_scores(ranked.where(F.col("place") <= width), entries, asking)
        best = cut(best_of(got if best is None else best.unionByName(got), k))
        # of a query id with several vectors, each has to be certain for itself
        certain = best.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).withColumnRenamed("query", "of")
        left = cut(ranked.where(F.col("place") > width).drop("place").join(certain, F.col("query") == F.col("of"), "left").where("least IS NULL OR upper >= least").select("query", "entry", "upper"))
        if left.isEmpty():
            break
        width *= params.more
    won = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).cast("int")
    return won.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("bigint").alias("score"))


def exact_scores(wanted: DataFrame, entries: DataFrame, asking: DataFrame) -> DataFrame:
    """(query, query_id, vec_id, score) of the pairs in ``wanted`` (query, entry): the only place that reads exact vectors."""
    total = F.aggregate(F.zip_with("v", "w", lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)")), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    plain = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0).cast("bigint"), lambda a, x: a + x)
    small = lambda c: F.forall(c, lambda x: (x < 1 << 26) & (x > -(1 << 26)))
    score = F.when(small("v") & small("w") & (F.size("v") < 1 << 10), plain.cast("decimal(38,0)")).otherwise(total)
    pairs = wanted.select("query", "entry").join(entries, "entry").join(asking.withColumnRenamed("v", "w"), "query")
    scored = pairs.select("query", "query_id", "ids", score.alias("score"))
    return scored.select("query", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")


def best_of(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return scored.groupBy("query", "query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
