"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the controls 9 to 13 (what ``bytes.split`` splits on).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files of an execution go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it back: lineage ends there, an executor may be lost.

    The folder is that of ``spark.checkpoint.dir``. Without one, a session in a single process gets a folder of its own;
    any other raises an error, since its executors share no local folder. What the plan has shuffled is deleted then.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="relcast-"))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def batches(frames: Iterable[pa.RecordBatch], column: str, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows and few bytes of ``column``, so that what Python makes of a slice stays small.

    A single longer text is a slice of its own.
    """
    for frame in frames:
        lengths = pc.fill_null(pc.binary_length(frame.column(column).cast(pa.binary())), 0).to_pylist()
        start = held = 0
        for at, length in enumerate(lengths):
            if at > start and (at - start >= rows or held + length > size):
                yield frame.slice(start, at - start)
                start, held = at, 0
            held += length
        if frame.num_rows > start:
            yield frame.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The texts of a batch as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Return the memory that a worker has freed: it serves other tasks later, beside those of other workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def per_text(df: DataFrame, keep: list[str], text: str, fields: str, make: Callable[[], Callable[[list], dict[str, pa.Array]]], rows: int = 512, size: int = 1 << 20) -> DataFrame:
    """Columns ``keep`` of ``df`` and what ``make()(texts)`` gives for its texts; one pass over the rows, no exchange.

    ``fields`` is the DDL of the added columns; ``make`` runs once in each task, and what it returns may have a ``close``.
    """
    wanted = df.select(*[F.col(name) for name in keep], F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1]), fields])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches(frames, "__text", rows, size):
            made = work(texts(batch, "__text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), *made.values()], [*keep, *made])
        if close := getattr(work, "close", None):
            close()
        del work
        give_back()

    return wanted.mapInArrow(run, schema)


def beside(df: DataFrame, facts: DataFrame, key: str, how: str = "inner", size: int = 64 << 20) -> DataFrame:
    """``df`` joined with a narrow written table: broadcast if that takes at most about ``size`` bytes, by an exchange beyond.

    The driver holds what is broadcast, some 200 bytes a row and its values.
    """
    row = F.lit(200) + F.octet_length(F.to_json(F.struct("*")))
    small = facts.agg(F.coalesce(F.sum(row), F.lit(0)) <= size).first()[0]
    return df.join(F.broadcast(facts) if small else facts.hint("merge"), key, how)
