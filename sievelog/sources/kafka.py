"""Options of Spark's Kafka source for a query. The connector is a package of its own; these are plain functions."""

from __future__ import annotations

import json

from ..plans.query import LogQuery

EARLIEST, LATEST = -2, -1
#: Client properties that the source sets itself.
FORCED = {"failOnDataLoss": "true"}


def _offsets(topic: str, partitions: list[int] | None, value: int | str) -> str:
    if partitions is None:
        return {EARLIEST: "earliest", LATEST: "latest"}.get(value) or json.dumps({topic: value})
    return json.dumps({topic: {str(p): value for p in partitions}})


def options(query: LogQuery, partitions: list[int] | None = None, streaming: bool = False) -> dict[str, str]:
    """Reader options. ``partitions``: all of the topic's, needed where each gets an offset of its own.

    A start relative to the end has no option of its own, nor has a batch that starts at the end: the reader starts early,
    and ``ranges.bounded`` or, in a stream, ``streaming.run.resolved`` and ``admitted`` cut. Headers are fetched only if the
    output shows them.
    """
    selected = query.selected_partitions() or partitions
    start, end = query.positions()
    out = {f"kafka.{k}": v for k, v in query.kafka_properties().items()} | FORCED | {"includeHeaders": str("headers" in query.columns_used).lower()}
    out["assign" if query.selected_partitions() else "subscribe"] = json.dumps({query.topic: selected}) if query.selected_partitions() else query.topic
    if query.on_kafka_error == "continue":
        out["failOnDataLoss"] = "false"
    if start.kind == "timestamp":
        out["startingTimestamp"], out["startingOffsetsByTimestampStrategy"] = str(start.value), "latest"
    elif start.kind == "offset":
        if selected is None:
            raise ValueError("an absolute start needs the topic's partitions")
        out["startingOffsets"] = _offsets(query.topic, selected, start.value)
    else:
        out["startingOffsets"] = _offsets(query.topic, None, LATEST if start.kind == "end" and streaming else EARLIEST)
    if not streaming:
        if end is not None and end.kind == "timestamp":
            out["endingTimestamp"] = str(end.value)
        elif end is not None and end.kind == "offset":
            if selected is None:
                raise ValueError("an absolute end needs the topic's partitions")
            out["endingOffsets"] = _offsets(query.topic, selected, end.value)
        else:
            out["endingOffsets"] = "latest"
    elif query.max_inflight_records:
        out["maxOffsetsPerTrigger"] = str(query.max_inflight_records)
    return out


def read(spark, query: LogQuery, partitions: list[int] | None = None):
    """The topic as records, if the connector is on the class path."""
    from pyspark.sql import functions as F

    reader = spark.read if query.bounded else spark.readStream
    df = reader.format("kafka").options(**options(query, partitions, streaming=not query.bounded)).load()
    none = F.array().cast("array<struct<key:string,value:binary>>")
    headers = F.coalesce("headers", none) if "headers" in df.columns else none
    return df.select("topic", "partition", "offset", "timestamp", "timestampType", "key", headers.alias("headers"), "value")
