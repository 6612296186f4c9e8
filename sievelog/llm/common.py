"""Shared helpers: durable intermediate tables, workers that give memory back, texts in pieces, white space and letter classes, stable fold numbers."""

from __future__ import annotations

import ctypes
import functools
import math
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only characters that count as white space in these operators.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE}]+"


#: Runs of letters and of numerals that are no digits, such as fractions and Roman numerals.
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """The runs of letters in a text."""
    found = _LETTERS.findall(text)
    if "".join(found).isalpha() or not found:
        return found
    return [run for x in found for run in "".join(c if c.isalpha() else " " for c in x).split()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder will do if
    they are one process; on a cluster that is an error, as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Where the tables made by ``durable`` are.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the running stage, not what came before. Unlike ``checkpoint`` the copy is
    columnar, compressed and pruned by later readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``durable`` made and nothing will read any more; others are left alone."""
    for df in tables:
        if (at := _paths.pop(df, None)) is not None:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # the GNU library's
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with memory given back when a task ends: a worker waits for further tasks, and what it keeps
    meanwhile is an executor's memory that the JVM's stages lack."""

    @functools.wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            # what ``run`` holds goes when it ends
            yield from run(batches)
        finally:
            give_back()

    return lean_run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most: what a worker sends is then as small, on either side."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of runs of a text column of about ``most`` characters, nulls as empty; a longer text comes
    alone. A batch of tens of megabytes is so never held as Python strings at once."""
    at, texts, size = 0, [], 0
    for i, x in enumerate(column):
        text = x.as_py() or ""
        if texts and size + len(text) > most:
            yield at, texts
            at, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield at, texts


def fold(key: str, n: int) -> Column:
    """CRC-32 of the key written as text, modulo ``n``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def chunks_for(rows: int, size: int, least: int = 16) -> int:
    """A number of chunks, a power of two, that leaves about ``size`` rows in each."""
    return max(least, 1 << math.ceil(math.log2(max(1, rows / size))))
