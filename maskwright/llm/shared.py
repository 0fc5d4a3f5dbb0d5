"""What the operators share: tables, cuts of lineage and word splitting."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word in Java's and DuckDB's pattern syntax: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in local runs without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='maskwright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/maskwright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a written table that no plan reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Ends the lineage: the rows as a written table in the shared folder, computed once and readable after any executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> Column:
    """All columns of the rows as one, so that their names can't meet an operator's own."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns))


def runs(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about so many bytes, so that working memory doesn't follow the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = before = 0
    while start < len(ends):
        end = min(len(ends), int(np.searchsorted(ends, before + most_bytes)) + 1)
        yield start, end
        start, before = end, int(ends[end - 1])


def trim() -> None:
    """Gives the memory that this process has freed back to the system; allocators would keep it for as long as the process lives.

    The collection is for the interpreter's lists of free objects, each of which holds the memory around it.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        give_back = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # not glibc
        return
    give_back(ctypes.c_size_t(0))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function after which its worker, which stays for other work, holds no more than it needs."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def uncollected(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function, trimmed, with the cycle collector off: it would walk millions of small objects, which form no cycles, again and again."""

    @trimmed
    @wraps(run)
    def quiet(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return quiet


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8. bytes.split() parts at the six bytes that WORD leaves out, and at no others."""
    return (text or "").encode("utf-8", "surrogatepass").split()


#: Two adjacent white-space characters, by any definition of white space.
_ADJACENT = re.compile(r"[\s\x1c-\x1f\x85]{2}")
#: All white space but space and line feed.
_OTHER_SPACE = [chr(c) for c in (9, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def has_adjacent_space(text: str) -> bool:
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in _OTHER_SPACE) and _ADJACENT.search(text) is not None
