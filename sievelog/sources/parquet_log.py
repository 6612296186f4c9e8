"""A log kept as Parquet files, and a Spark data source ("sievelog") that reads it by partition and offset range.

``write`` lays a log out by partition of the log, in files of some spans of offsets each, sorted by offset, so that a selection
of partitions prunes folders and a range of offsets prunes row groups. ``read`` is the plain scan. The data source serves
partitions as Kafka would, batch and streaming, for a folder that driver and executors reach as a file path: a task reads
row groups of a partition one after another, ``TASK_BYTES`` at most or a single one.
"""

from __future__ import annotations

import functools
import glob
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators import ranges
from ..schema import RECORD

#: Bytes that one task of the data source reads, before compression, and records that a worker holds at once.
TASK_BYTES, BATCH = 64 << 20, 4096


def write(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Spans of offsets are dealt, not partitions of the log, of which each would be one task's."""
    log.repartition("partition", ranges.spanned("offset")).sortWithinPartitions("partition", "offset").write.mode(mode).partitionBy("partition").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path).select(*RECORD.fieldNames())


class Group(NamedTuple):
    """A row group of a file: its offsets from low to before high."""

    low: int
    high: int
    file: str
    number: int
    size: int


class Range(InputPartition):
    """Offsets of a partition, and the row groups that hold them."""

    def __init__(self, partition: int, start: int, end: int, groups: list[Group]):
        self.partition, self.start, self.end, self.groups = partition, start, end, groups


@functools.lru_cache(maxsize=10_000)
def _file_groups(file: str, size: int, changed: int) -> tuple[Group, ...]:
    """``size`` and ``changed`` tell a file from a later one of its name."""
    footer = pq.read_metadata(file)
    at = footer.schema.names.index("offset")
    groups = [footer.row_group(i) for i in range(footer.num_row_groups)]
    return tuple(Group(g.column(at).statistics.min, g.column(at).statistics.max + 1, file, i, g.total_byte_size) for i, g in enumerate(groups))


def _groups(path: str) -> dict[int, list[Group]]:
    """The row groups of each partition, by their first offsets."""
    found: dict[int, list[Group]] = {}
    for folder in glob.glob(os.path.join(path, "partition=*")):
        files = [(f, os.stat(f)) for f in glob.glob(os.path.join(folder, "*.parquet"))]
        if own := sorted(g for f, at in files for g in _file_groups(f, at.st_size, at.st_mtime_ns)):
            found[int(folder.rsplit("=", 1)[1])] = own
    return found


def _offsets(path: str) -> dict[int, tuple[int, int]]:
    """(low, high) of each partition, from the files' statistics."""
    return {p: (own[0].low, max(g.high for g in own)) for p, own in _groups(path).items()}


def _tasks(groups: dict[int, list[Group]], edges: dict[int, tuple[int, int]]) -> list[Range]:
    """The records within ``edges``, by tasks of neighbouring row groups of one partition."""
    found: list[Range] = []
    for p, (a, b) in edges.items():
        size = 0
        for g in groups.get(p, ()):
            if a < b and g.low < b and g.high > a:
                if not found or found[-1].partition != p or size + g.size > TASK_BYTES:
                    found.append(Range(p, a, b, []))
                    size = 0
                found[-1].groups.append(g)
                size += g.size
    return found


def edges(spark: SparkSession, path: str) -> DataFrame | None:
    """(partition, low, high) of a stored log from its files' statistics, so that no record is read for them; None for a
    folder that the driver doesn't reach as a file path."""
    local = path.removeprefix("file://")
    if "://" in local or not os.path.isdir(local) or not (found := _offsets(local)):
        return None
    return spark.createDataFrame([(p, low, high) for p, (low, high) in sorted(found.items())], "partition int, low long, high long")


def _batches(part: Range) -> Iterator[pa.RecordBatch]:
    """The records of a range, as Arrow batches of the record's schema. No file is read ahead of what is asked for."""
    names = RECORD.fieldNames()
    for group in part.groups:
        with pq.ParquetFile(group.file, buffer_size=1 << 20, pre_buffer=False) as file:
            for batch in file.iter_batches(BATCH, [group.number], [n for n in names if n != "partition"], use_threads=False):
                if group.low < part.start or group.high > part.end:
                    batch = batch.filter(pc.and_(pc.greater_equal(batch["offset"], part.start), pc.less(batch["offset"], part.end)))
                if batch.num_rows:
                    columns = {n: batch.column(n) for n in batch.schema.names} | {"partition": pa.repeat(pa.scalar(part.partition, pa.int32()), batch.num_rows)}
                    at = columns["timestamp"]
                    columns["timestamp"] = (at if at.type.tz else pc.assume_timezone(at, "UTC")).cast(pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


class _Options:
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.partitions = None if "partitions" not in options else set(json.loads(options["partitions"]))
        self.start, self.end = int(options.get("start", 0)), None if "end" not in options else int(options["end"])

    def offsets(self) -> dict[int, tuple[int, int]]:
        found = {p: (max(low, self.start), high if self.end is None else min(high, self.end)) for p, (low, high) in _offsets(self.path).items()}
        return {p: edges for p, edges in sorted(found.items()) if self.partitions is None or p in self.partitions}


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.options = _Options(options)

    def partitions(self) -> list[Range]:
        """Tasks for each partition that has records in the range."""
        return _tasks(_groups(self.options.path), self.options.offsets())

    def read(self, partition: Range) -> Iterator:
        yield from _batches(partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {str(p): a for p, (a, _) in self.options.offsets().items()}

    def latestOffset(self) -> dict:
        return {str(p): max(a, b) for p, (a, b) in self.options.offsets().items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _tasks(_groups(self.options.path), {int(p): (start.get(p, self.options.start), b) for p, b in end.items()})

    def read(self, partition: Range) -> Iterator:
        yield from _batches(partition)


class LogSource(DataSource):
    """Options: path, partitions (JSON list), start, end."""

    @classmethod
    def name(cls) -> str:
        return "sievelog"

    def schema(self) -> StructType:
        return RECORD

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
