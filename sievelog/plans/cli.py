"""Command line: ``python -m sievelog -t TOPIC --log PATH …`` reads a Parquet log; with ``-b`` it reads Kafka.

A run with an end is a batch query. One without follows the log, until its counts are reached or it is interrupted. The first
SIGINT or SIGTERM lets a follower finish its batch and cancels a batch query; the second ends the process at once.
"""

from __future__ import annotations

import argparse
import dataclasses
import os
import signal
import sys
import tempfile
import threading
import time
import uuid

from .query import LogQuery


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sievelog", description="Filter, transform and print records of a log.")
    p.add_argument("-t", "--topic", required=True)
    p.add_argument("-b", "--brokers")
    p.add_argument("--log", help="a Parquet log to read instead of Kafka")
    p.add_argument("-p", "--partition", dest="partitions", action="append", default=[])
    p.add_argument("-o", "--offset", dest="offsets", action="append", default=[])
    p.add_argument("--end-offset", type=int)
    counts = p.add_mutually_exclusive_group()
    counts.add_argument("-c", "--count", type=int)
    counts.add_argument("--count-per-partition", type=int)
    p.add_argument("-e", "--exit-at-end", action="store_true")
    p.add_argument("--snapshot", action="store_true")
    p.add_argument("--drop-if", action="append", default=[])
    p.add_argument("--tombstone-if", action="append", default=[])
    p.add_argument("--drop-tombstones", action="store_true")
    p.add_argument("--project")
    variables = p.add_mutually_exclusive_group()
    variables.add_argument("--vars")
    variables.add_argument("--vars-file")
    shape = p.add_mutually_exclusive_group()
    shape.add_argument("-f", "--format")
    shape.add_argument("-J", "--json-envelope", action="store_true")
    p.add_argument("--envelope-payload", choices=("string", "value"))
    p.add_argument("-u", "--unbuffered", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--stats-interval")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-j", "--jobs", type=int)
    p.add_argument("--consumers", type=int, default=1)
    p.add_argument("--unordered", action="store_true")
    p.add_argument("--max-inflight-records", type=int, default=8192)
    p.add_argument("--max-inflight-bytes", default="256MiB")
    p.add_argument("--max-inflight-per-partition", type=int)
    p.add_argument("--on-invalid-json", choices=("fail", "drop", "tombstone", "pass"))
    p.add_argument("--on-eval-error", choices=("fail", "drop", "tombstone"), default="fail")
    p.add_argument("--on-kafka-error", choices=("fail", "continue"), default="fail")
    p.add_argument("-F", "--config")
    p.add_argument("-X", "--property", dest="properties", action="append", default=[])
    p.add_argument("--check", action="store_true")
    return p


def _joined(argv: list[str]) -> list[str]:
    """``-o -2`` as ``-o=-2``: a value that begins with a dash is no option."""
    out, i = [], 0
    while i < len(argv):
        if argv[i] in ("-o", "--offset") and i + 1 < len(argv):
            out += [f"--offset={argv[i + 1]}"]
            i += 2
        else:
            out.append(argv[i])
            i += 1
    return out


class Signals:
    """Notes the first SIGINT or SIGTERM, and ends the process at the second. Only the main thread can be told of them."""

    def __init__(self):
        self.got, self._before = 0, {}

    def __enter__(self) -> Signals:
        if threading.current_thread() is threading.main_thread():
            self._before = {n: signal.signal(n, self._note) for n in (signal.SIGINT, signal.SIGTERM)}
        return self

    def __exit__(self, *_) -> None:
        for n, handler in self._before.items():
            signal.signal(n, handler)

    def _note(self, n: int, _frame) -> None:
        if self.got:
            os._exit(self.status)
        self.got = n

    @property
    def status(self) -> int:
        return 128 + self.got if self.got else 0


def watched(spark, signals: Signals, do):
    """What ``do`` returns. It runs in a thread of its own, so that a signal can cancel its jobs from here."""
    done: dict = {}

    def run() -> None:
        try:
            done["value"] = do()
        except BaseException as error:
            done["error"] = error

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    while worker.is_alive():
        worker.join(0.1)
        if signals.got:
            spark.sparkContext.cancelAllJobs()
            worker.join(10)
            raise KeyboardInterrupt
    if "error" in done:
        raise done["error"]
    return done["value"]


class _Reader:
    """``out``, and whether its reader has gone."""

    def __init__(self, out):
        self.out, self.gone = out, False

    def _try(self, do, *args):
        try:
            return do(*args)
        except BrokenPipeError:
            self.gone = True
            raise

    def write(self, data):
        return self._try(self.out.write, data)

    def flush(self):
        return self._try(self.out.flush)


def _scratch(spark) -> str:
    """A folder's name that driver and executors share."""
    from pyspark.errors import PySparkRuntimeError

    shared, master = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise PySparkRuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/sievelog-{uuid.uuid4().hex}"


def _delete(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def batch(spark, query: LogQuery, log, out, edges=None) -> tuple[dict | None, str | None]:
    """Write a bounded run's records; (what it counted, the text of the failure that ended it).

    Records are transformed once: counts are observed as the result is kept, and the sort and the search for a failure
    read what was kept. Of a partition with a failure the records before it are written. A run that neither counts nor can
    fail isn't kept.
    """
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from ..operators import stats
    from ..operators.transform import before_failures, emitted, failure_text
    from .sink import to_stream

    acted = query.acted(log, edges=edges).withColumn("rendered", query.rendered_column())
    counted, text = query.stats or query.stats_interval is not None, None
    path, seen = None, None
    try:
        if counted or query.can_fail:
            path, observed = _scratch(spark), Observation()
            if counted:
                acted = acted.observe(observed, *stats.counters())
            kept = acted.withColumn("failure", failure_text())
            kept.select("partition", "offset", "action", "rendered", "failure").write.parquet(path)
            seen, acted = observed.get if counted else None, spark.read.parquet(path)
            first = acted.where("action = 'fail'").orderBy("partition", "offset").select("failure").first()
            if first is not None:
                text, acted = first[0], before_failures(acted)
        shown = emitted(acted).select("partition", "offset", "rendered")
        to_stream(shown if query.unordered else shown.orderBy("partition", "offset"), out, query.unbuffered)
        return seen, text
    finally:
        if path is not None:
            _delete(spark, path)


def follow(spark, query: LogQuery, path: str | None, out, signals: Signals) -> None:
    """Write records as they come. Counts end the run once each is reached, as does a reader that has gone, and a signal once the
    batch at work is written."""
    from pyspark.sql import functions as F

    from ..sources import kafka, parquet_log
    from ..streaming import run as streaming
    from .query import parse_duration
    from .sink import to_stream

    if path is not None:
        parquet_log.register(spark)
        stream, stored = spark.readStream.format("sievelog").options(path=path).load(), parquet_log.read(spark, path)
    else:
        stream = kafka.read(spark, query)
        stored = kafka.read(spark, dataclasses.replace(query, offsets=(), exit_at_end=True))
    reader, wanted = _Reader(out), query.count
    if query.count_per_partition is not None:
        selected = query.selected_partitions()
        wanted = query.count_per_partition * (len(selected) if selected else stored.where(F.col("topic") == query.topic).select("partition").distinct().count())

    def write(df, number: int) -> None:
        # kept, as sorting reads a batch twice, and what is observed would count twice
        df = df.persist()
        try:
            to_stream(df if query.unordered else df.orderBy("partition", "offset"), reader, query.unbuffered)
        finally:
            df.unpersist()

    say = (lambda text: print(text, file=sys.stderr, flush=True)) if (query.stats or query.stats_interval) and not query.quiet else (lambda text: None)
    listener, every = streaming.StatsListener(say), None if query.stats_interval is None else parse_duration(query.stats_interval) / 1000
    spark.streams.addListener(listener)
    state = _scratch(spark)
    try:
        running = streaming.start(query, stream, write, state, stored=stored)
        try:
            last = time.monotonic()
            while not running.awaitTermination(0.1):
                if signals.got and not running.status["isTriggerActive"]:
                    break
                if reader.gone or wanted is not None and listener.total["admitted"] >= wanted:
                    break
                # by the clock, whether or not there are records
                if every is not None and time.monotonic() - last >= every:
                    last = time.monotonic()
                    listener.report()
        finally:
            running.stop()
            listener.ended.wait(10)
    finally:
        spark.streams.removeListener(listener)
        _delete(spark, state)


def main(argv: list[str] | None = None, out=None, spark=None) -> int:
    """Exit status: 0 done, 1 failed while running, 2 wrong options, 130 or 143 ended by SIGINT or SIGTERM."""
    try:
        args = vars(parser().parse_args(_joined(sys.argv[1:] if argv is None else argv)))
    except SystemExit as end:
        return int(end.code or 0)
    path = args.pop("log")
    try:
        query = LogQuery(**args).validate(brokers=path is None)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    if query.check:
        return 0
    from pyspark.sql import SparkSession

    from ..operators import ranges, stats
    from ..sources import kafka, parquet_log

    began, out = time.monotonic(), out or sys.stdout.buffer
    try:
        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    except Exception as error:
        print(error, file=sys.stderr)
        return 1
    with Signals() as signals:
        try:
            log = None if path is None else parquet_log.read(spark, path)
            if log is not None:
                ranges.discovered(log, query.topic)
            if not query.bounded:
                follow(spark, query, path, out, signals)
                return signals.status
            log, edges = (kafka.read(spark, query), None) if log is None else (log, parquet_log.edges(spark, path))
            seen, failure = watched(spark, signals, lambda: batch(spark, query, log, out, edges))
            if seen is not None and not query.quiet:
                print(stats.report(seen, int(1000 * (time.monotonic() - began))), file=sys.stderr)
            if failure is not None:
                print(failure, file=sys.stderr)
            return int(failure is not None)
        except KeyboardInterrupt:
            return signals.status or 130
        except Exception as error:
            print(error, file=sys.stderr)
            return signals.status or 1
