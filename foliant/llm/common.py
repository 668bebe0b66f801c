"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule, as a regular-expression class and as a trim set.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch that meet Python at once; long texts make larger batches costly.
BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Where the session names none, one is made for a local master, as in tests; a cluster has
    no folder of one machine that the others read, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def as_bytes(column: str):
    """UTF-8 bytes of a text column; null is the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def row_key(id_col: str, text_col: str):
    """A key of a row by content: rows that share it have the same id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def small_batches(batches, rows: int = BATCH_ROWS, size: int = 8 << 20):
    """Slices of Arrow batches with few rows and few bytes, views without copies."""
    for batch in batches:
        step = rows
        if batch.num_rows and batch.nbytes > size:
            step = max(1, min(rows, batch.num_rows * size // batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: What a worker process makes once for all its tasks of one operator.
HELD: dict = {}


def held(key, make):
    if key not in HELD:
        HELD[key] = make()
    return HELD[key]


def give_back() -> None:
    """Return free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run, keeps: bool = False):
    """A function for mapInArrow, after which its worker, which other stages use too, gives back the memory that is free.

    Unless it ``keeps`` what is held, that of other operators goes before it begins.
    """

    @wraps(run)
    def tidied(batches):
        if HELD and not keeps:
            HELD.clear()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_keeping(run):
    return tidy(run, keeps=True)
