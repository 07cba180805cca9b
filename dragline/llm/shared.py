"""Helpers of the corpus operators: stored tables, row numbers, words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dragline.scale import ensure_checkpoint_dir

_GIVE_BACK = 1 << 26  # bytes made
POSITION_BITS = 33  # monotonically_increasing_id keeps the place in the partition in its low 33 bits


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def arrow_batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Hand Python tasks batches of about ``size`` while the jobs inside run (batches also end at a number of rows)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return freed memory to the system: Python workers stay alive between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back when it has seen them all, and after every large batch it makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for out in rows(batches):
            made += out.nbytes
            yield out
            if made > _GIVE_BACK:
                made = 0
                give_back()
        give_back()

    return run


def content_keys(key: str, text: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's id and text.

    They name a row whichever scan reads it; rows that share them have the same id and text.
    """
    return F.xxhash64(F.col(key), F.lit("id"), F.col(text)), F.xxhash64(F.col(text), F.lit("text"), F.col(key))


def part_of(at: str) -> Column:
    return F.shiftright(at, POSITION_BITS)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
