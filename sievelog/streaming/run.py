"""Queries over logs that grow: follow mode, bounded catch-up, count limits, ordered output and periodic statistics."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import ranges, stats
from ..operators.transform import emitted, raising, transform
from ..plans.query import LogQuery, parse_duration


LIMITS = "partition int, low long, high long, start long, end long"


def resolved(query: LogQuery, stored: DataFrame | None, checkpoint: str) -> DataFrame | None:
    """What ``ranges.boundaries`` says of the log as it is when the stream first starts; None if no position needs it.

    Kept with the checkpoint: a restart goes on within the boundaries that the first start found.
    """
    start, end = query.positions()
    if start.kind in ("beginning", "offset") and (end is None or end.kind in ("offset", "snapshot")):
        return None
    if stored is None:
        raise ValueError("a start relative to the end and timestamps need the stored log")
    spark, path = stored.sparkSession, f"{checkpoint}/boundaries"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        own = ranges.select_partitions(stored.where(F.col("topic") == query.topic), query.selected_partitions())
        ranges.boundaries(own, start, end).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema(LIMITS).parquet(path)


def admitted(query: LogQuery, log: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """The stream's records in the query's partitions and positions. ``limits``: of ``resolved``, where it gives any.

    A partition that came up later has no limits: it is followed from its first record, and outside of a run with an end.
    """
    start, end = query.positions()
    log = ranges.select_partitions(log.where(F.col("topic") == query.topic), query.selected_partitions())
    if limits is not None:
        edges = limits.select(F.col("partition").alias("_partition"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        columns = log.columns
        log = log.join(F.broadcast(edges), F.col("partition") == F.col("_partition"), "inner" if end is not None else "left")
        log = log.where(F.col("_start").isNull() | (F.col("offset") >= F.col("_start")))
        log = (log if end is None else log.where(F.col("offset") < F.col("_end"))).select(*columns)
    if start.kind == "offset":
        log = log.where(F.col("offset") >= start.value)
    if end is not None and end.kind == "offset":
        log = log.where(F.col("offset") < end.value)
    if query.count is not None:
        log = log.limit(query.count)
    if query.count_per_partition is not None:
        log = first_of_each(log, query.count_per_partition)
    return log


def _may_be_first(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The records of a task that come before all but ``n - 1`` of those seen so far of their partition: ``n`` of each where
    offsets ascend, more where they don't, never fewer. Only offsets are kept, ``n`` of a partition at most."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for batch in batches:
            parts, offsets = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("partition", "offset"))
            order = np.lexsort((offsets, parts))
            kept = []
            for run in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
                if len(run := run[:n]):
                    best = np.sort(np.concatenate([least.get(parts[run[0]], offsets[:0]), offsets[run]]))[:n]
                    least[parts[run[0]]] = best
                    kept.append(run[offsets[run] <= best[-1]])
            if sum(map(len, kept)):
                yield batch.take(pa.array(np.sort(np.concatenate(kept))))

    return few


def first_of_each(log: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records of each partition over the whole stream: a count per partition is the only state.

    Tasks send on what may be among the first ones only; some ``2 n`` records of a partition are held at once."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = log.columns

    def keep(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        # copies, as parts of a frame keep all of it in memory
        first = lambda frames: pd.concat(frames).sort_values("offset").head(max(0, n - seen)).copy()
        held: list[pd.DataFrame] = []
        for p in parts:
            held.append(first([p]))
            if sum(map(len, held[1:])) > n:
                held = [first(held)]
        rows = first(held)
        state.update((seen + len(rows),))
        yield rows[columns]

    return log.mapInArrow(_may_be_first(n), log.schema).groupBy("partition").applyInPandasWithState(keep, log.schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def transformed(query: LogQuery, log: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    acted = raising(transform(admitted(query, log, limits), query.plan(), embeds_json=query.embeds_json))
    return acted.withColumn("rendered", query.rendered_column())


def start(query: LogQuery, log: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None, stored: DataFrame | None = None) -> StreamingQuery:
    """Run ``write`` on each batch of emitted records, in order of partition and offset unless the query is unordered.

    A query with an end reads what is there when it starts and stops; one without follows until it is stopped. The
    checkpoint makes a restart go on where the last batch ended. ``stored``: the same log as a batch frame, by which starts
    relative to the end and timestamps are resolved; such a query is an error without it.
    """
    acted = transformed(query, log, resolved(query, stored, checkpoint))
    if query.stats or query.stats_interval is not None or query.count is not None or query.count_per_partition is not None:
        acted = acted.observe("stats", *stats.counters())

    def batch(df: DataFrame, number: int) -> None:
        out = emitted(df).select("partition", "offset", "action", "payload", "rendered")
        write(out if query.unordered else out.repartition("partition").sortWithinPartitions("partition", "offset"), number)

    writer = acted.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if query.bounded else writer).start()


class StatsListener(StreamingQueryListener):
    """Adds up what batches observe, and reports at most once an interval and at the end."""

    def __init__(self, say: Callable[[str], None], interval: str | None = None):
        self.say, self.every = say, None if interval is None else parse_duration(interval) / 1000
        self.began = self.last = time.monotonic()
        self.total, self.ended = dict.fromkeys(stats.COUNTERS, 0), threading.Event()

    def report(self) -> None:
        self.say(stats.report(self.total, int(1000 * (time.monotonic() - self.began))))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("stats")
        if row is not None:
            for n in stats.COUNTERS:
                self.total[n] += row[n] or 0
        if self.every is not None and time.monotonic() - self.last >= self.every:
            self.last = time.monotonic()
            self.report()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report()
        self.ended.set()
