"""Which records of a log a run reads: partitions, start and end positions, counts, and how partitions are shared out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import MOST_PARTITIONS

MOST_INT, MOST_LONG = 2**31 - 1, 2**63 - 1
#: Records that one task may sort for a count, and offsets or ids that are numbered and stored together.
MOST_SORTED, SPAN = 100_000, 1 << 12


@dataclass(frozen=True)
class Position:
    """kind: beginning, end, offset, before_end, timestamp, or (as an end) snapshot."""

    kind: str
    value: int = 0


class RangeError(ValueError):
    """All that is wrong with one option."""


#: An entry of a partition list, and a position. Blanks around entries and plus signs are allowed.
_SPAN = re.compile(r"\s*\+?(?P<low>[0-9]+)(?:-\+?(?P<high>[0-9]+))?\s*")
_POSITION = re.compile(r"(?P<edge>beginning|end)|s@\+?(?P<start_ms>[0-9]+)|e@\+?(?P<end_ms>[0-9]+)|-(?P<back>[0-9]+)|\+?(?P<offset>[0-9]+)")


def _complain(option: str, problems: Sequence[str]) -> None:
    if problems:
        raise RangeError(f"{option}: {'; '.join(problems)}")


def parse_partitions(values: Sequence[str]) -> list[int]:
    """``0,2,4-6`` as partitions, in the order written. Spans ascend, overlap nowhere and name MOST_PARTITIONS at most."""
    spans, problems = [], []
    for entry in ",".join(values).split(","):
        if (found := _SPAN.fullmatch(entry)) is None:
            problems.append(f"{entry!r} is neither a partition nor a span such as 4-6")
            continue
        low = int(found["low"])
        high = low if found["high"] is None else int(found["high"])
        if high < low or high > MOST_INT:
            problems.append(f"{entry!r} doesn't ascend to a partition's number")
        else:
            spans.append((low, high))
    if (size := sum(high - low + 1 for low, high in spans)) > MOST_PARTITIONS:
        problems.append(f"{size} partitions, and {MOST_PARTITIONS} can be read at once")
    problems += [f"partition {later[0]} is there twice" for before, later in pairwise(sorted(spans)) if later[0] <= before[1]]
    _complain("partitions", problems)
    return [p for low, high in spans for p in range(low, high + 1)]


def parse_positions(offsets: Sequence[str], end_offset: int | None = None) -> tuple[Position, Position | None]:
    """Start and end of ``beginning``, ``end``, ``N``, ``-N``, ``s@ms`` and ``e@ms``; the start is the beginning by default."""
    starts, ends, problems = [], [] if end_offset is None else [Position("offset", end_offset)], []
    for text in offsets:
        found = _POSITION.fullmatch(text)
        if found is None or (kind := found.lastgroup) != "edge" and int(found[kind]) > MOST_LONG:
            problems.append(f"{text!r} is none of beginning, end, N, -N, s@MS and e@MS")
        elif kind == "edge":
            starts.append(Position(found[kind]))
        elif kind.endswith("_ms"):
            (starts if kind == "start_ms" else ends).append(Position("timestamp", int(found[kind])))
        else:
            # nothing before the end is the offset 0, as it reads
            n = int(found[kind])
            starts.append(Position("before_end" if kind == "back" and n else "offset", n))
    if end_offset is not None and end_offset < 0:
        problems.append(f"the end {end_offset} lies before the first offset")
    problems += [f"{len(found)} {side} positions, and a run has one" for side, found in (("start", starts), ("end", ends)) if len(found) > 1]
    _complain("positions", problems)
    return starts[0] if starts else Position("beginning"), ends[0] if ends else None


def discovered(log: DataFrame, topic: str) -> list[int]:
    """The topic's partitions, in order; a topic without any is an error, as are more than a run can read."""
    own = log.where(F.col("topic") == topic).select("partition").distinct().orderBy("partition").limit(MOST_PARTITIONS + 1)
    found = [r.partition for r in own.collect()]
    _complain("topic", [f"the log has no partition of {topic!r}"] * (not found) + [f"{topic!r} has more than {MOST_PARTITIONS} partitions"] * (len(found) > MOST_PARTITIONS))
    return found


def shards(partitions: Sequence[int], consumers: int) -> list[list[int]]:
    """Partitions dealt in turn to as many consumers as have any."""
    n = min(consumers, len(partitions))
    return [list(partitions[i::n]) for i in range(n)]


def select_partitions(log: DataFrame, partitions: Sequence[int] | None) -> DataFrame:
    """A filter on the partition column, which a reader of partitioned files prunes by."""
    return log if partitions is None else log.where(F.col("partition").isin(*partitions))


def boundaries(log: DataFrame, start: Position, end: Position | None, edges: DataFrame | None = None) -> DataFrame:
    """One row per partition: partition, low, high, start, end (exclusive), by one aggregation of offsets and timestamps.

    ``edges`` (partition, low, high): what the source itself knows of the log; if no timestamp is to be found, no record is
    read then. Timestamps are offset boundaries, not filters: the first record at or after them, or the end where there is
    none. An absolute start outside of a partition is an error whatever the policy; its end is a place to start from.
    """
    ms = F.unix_millis("timestamp")
    first_at = lambda t: F.min(F.when(ms >= t, F.col("offset")))
    timed = [first_at(p.value).alias(name) for name, p in (("start_at", start), ("end_at", end)) if p and p.kind == "timestamp"]
    if edges is not None and not timed:
        found = edges.select("partition", "low", "high")
    else:
        found = log.groupBy("partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"), *timed)
    high, low = F.col("high"), F.col("low")

    def resolve(p: Position, name: str) -> Column:
        value = F.lit(p.value).cast("long")
        return {
            "beginning": low, "end": high, "snapshot": high, "offset": value, "before_end": F.greatest(high - value, low),
            "timestamp": F.coalesce(F.col(f"{name}_at") if p.kind == "timestamp" else F.lit(None), high),
        }[p.kind]

    first = resolve(start, "start")
    if start.kind == "offset":
        said = F.concat(F.lit("offset error: partition "), F.col("partition"), F.lit(" holds "), low, F.lit(" to "), high, F.lit(f", and not {start.value}"))
        first = F.when((first > high) | (first < low), F.raise_error(said).cast("long")).otherwise(first)
    return found.select("partition", "low", "high", first.alias("start"), (resolve(end, "end") if end else high).alias("end"))


def bounded(log: DataFrame, start: Position, end: Position | None, strict: bool = True, edges: DataFrame | None = None) -> DataFrame:
    """The records within [start, end) of each partition.

    Absolute offsets are plain filters and reach the scan. Others take ``boundaries``: a row per partition, of which there
    are ``MOST_PARTITIONS`` at most, so it is safe to broadcast. ``strict``: absolute starts are held against the log too.
    """
    simple = start.kind == "beginning" or start.kind == "offset" and not strict
    if simple and (end is None or end.kind in ("offset", "snapshot")):
        conditions = [F.col("offset") >= start.value] if start.kind == "offset" else []
        conditions += [F.col("offset") < end.value] if end and end.kind == "offset" else []
        for c in conditions:
            log = log.where(c)
        return log
    limits = boundaries(log, start, end, edges).select(F.col("partition").alias("_partition"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    for p, test in ((start, F.col("offset") >= start.value), (end, F.col("offset") < (end.value if end else 0))):
        if p is not None and p.kind == "offset":
            log = log.where(test)
    inside = (F.col("partition") == F.col("_partition")) & (F.col("offset") >= F.col("_start")) & (F.col("offset") < F.col("_end"))
    return log.join(F.broadcast(limits), inside).select(*log.columns)


def first_records(log: DataFrame, count: int | None = None, per_partition: int | None = None) -> DataFrame:
    """The first ``count`` records by partition and offset, or the first of each partition: before any transform."""
    if count is not None:
        return log.orderBy("partition", "offset").limit(count) if count <= MOST_SORTED else _first_of_all(log, count)
    if per_partition is not None:
        place = F.row_number().over(Window.partitionBy("partition").orderBy("offset"))
        return log.withColumn("_place", place).where(F.col("_place") <= per_partition).drop("_place")
    return log


def _first_of_all(log: DataFrame, count: int) -> DataFrame:
    """As many records as one task shouldn't sort: whole partitions, and of the one where the count ends its first."""
    before = F.sum("n").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1))
    room = log.groupBy("partition").agg(F.count("*").alias("n")).withColumn("room", count - F.coalesce(before, F.lit(0)))
    # a row per partition, of which there are MOST_PARTITIONS at most
    room = F.broadcast(room.where("room > 0").select(F.col("partition").alias("_partition"), "n", "room"))
    placed = sequenced(log.join(room, F.col("partition") == F.col("_partition")))
    return placed.where(F.col("sequence") < F.col("room")).select(*log.columns)


def spanned(number: str, span: int | None = None) -> Column:
    """Which span a whole number lies in; spans ascend with the numbers, and a null's is the last."""
    return F.coalesce(F.floor(F.col(number) / (span or SPAN)), F.lit(MOST_LONG))


def numbered(rows: DataFrame, order: Sequence[str], name: str, span: int | None = None) -> DataFrame:
    """``name``: a row's place in its partition by ``order``, whole numbers with nulls last, whatever gaps they have.

    Rows are numbered within spans of the first number, and spans begin where those before them end: no task holds a
    partition of the log, and counting spans reads no other column. Rows that share a first number are numbered by one task.
    """
    columns = rows.columns
    # a null partition is one like others
    rows = rows.withColumns({"_part": F.coalesce(F.col("partition").cast("long"), F.lit(MOST_LONG)), "_span": spanned(order[0], span)})
    before = Window.partitionBy("_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.groupBy(F.col("_part").alias("_p"), F.col("_span").alias("_s")).agg(F.count("*").alias("_n")).select("_p", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_part", "_span").orderBy(*(F.col(c).asc_nulls_last() for c in order))).cast("long") - 1
    joined = rows.withColumn("_within", within).join(begins, (F.col("_part") == F.col("_p")) & (F.col("_span") == F.col("_s")))
    return joined.select(*columns, (F.col("_begin") + F.col("_within")).alias(name))


def sequenced(log: DataFrame, span: int | None = None) -> DataFrame:
    """``sequence``: a record's dense place in its partition, whatever gaps its offsets have."""
    return numbered(log, ["offset"], "sequence", span)
