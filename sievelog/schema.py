"""The record of a log, and what a transform makes of it."""

from pyspark.sql import types as T

HEADERS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))
RECORD = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("timestampType", T.IntegerType()),
    T.StructField("key", T.BinaryType()), T.StructField("headers", HEADERS), T.StructField("value", T.BinaryType()),
])
#: action: drop, tombstone, pass, project, or fail (with the error's text); issue: InvalidJson or Evaluation.
ACTION = T.StructType([
    T.StructField("action", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_length", T.LongType()),
    T.StructField("issue", T.StringType()), T.StructField("error", T.StringType()),
])
TIMESTAMP_NAMES = {0: "createTime", 1: "logAppendTime"}
MOST_PARTITIONS = 100_000
