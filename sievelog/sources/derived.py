"""Logs made of the test tables: each row of a table becomes a record of a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), "[.]0$", "")


def _record(df: DataFrame, topic: str, partition: Column, order: list[str], value: Column, key: Column, timestamp: Column | None = None, headers: Column | None = None) -> DataFrame:
    return ranges.numbered(df.withColumn("partition", partition.cast("int")), order, "offset").select(
        F.lit(topic).alias("topic"), "partition", "offset",
        (timestamp if timestamp is not None else F.lit(None)).cast("timestamp").alias("timestamp"), F.lit(-1 if timestamp is None else 0).alias("timestampType"),
        key.cast("binary").alias("key"), (headers if headers is not None else F.array()).cast("array<struct<key:string,value:binary>>").alias("headers"), value.cast("binary").alias("value"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four partitions by user; JSON objects, tombstones (ids divisible by 97) and malformed values (by 101)."""
    whole = F.concat(F.lit('{"id":'), "event_id", F.lit(',"user":'), "user_id", F.lit(',"type":"'), "event_type", F.lit('","amount":'), _number(F.col("value")), F.lit(',"props":'), "props", F.lit("}"))
    value = F.when(F.col("event_id") % 97 == 0, None).when(F.col("event_id") % 101 == 0, F.concat(F.lit('{"id":'), "event_id")).otherwise(whole)
    header = lambda name, x: F.struct(F.lit(name).alias("key"), x.cast("binary").alias("value"))
    headers = F.array(header("source", F.lit("events")), header("empty", F.lit("")), header("none", F.lit(None)))
    return _record(_table(spark, sf_dir, "events"), "events", F.col("user_id") % 4, ["event_id"], value, F.col("user_id").cast("string"), F.col("ts"), headers)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partitions by customer; an order with the array of its items."""
    # items are dealt as numbers, by as many tasks as the session says: the keys alone, which numbering counts, are so small
    # that few tasks would get all of them
    item = lambda x: F.concat(F.lit('{"sku":'), x["l_partkey"], F.lit(',"price":'), _number(x["l_extendedprice"]), F.lit("}"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("item"))
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey").groupBy("o_orderkey")
    lines = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list("item")), item), ",").alias("items"))
    both = _table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    value = F.concat(F.lit('{"order":'), "o_orderkey", F.lit(',"status":"'), "o_orderstatus", F.lit('","items":['), "items", F.lit("]}"))
    return _record(both, "orders", F.col("o_custkey") % 3, ["o_orderkey"], value, F.col("o_custkey").cast("string"), F.col("o_orderdate"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partitions; raw text with quotes, backslashes and newlines; no timestamps."""
    key = F.concat("conv_id", F.lit(":"), "turn")
    return _record(_table(spark, sf_dir, "conversations"), "conversations", F.col("conv_id") % 2, ["conv_id", "turn"], F.col("text"), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partitions; long values that aren't JSON, some of them no UTF-8 either."""
    value = F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return _record(_table(spark, sf_dir, "documents"), "documents", F.col("doc_id") % 2, ["doc_id"], value, F.lit(None).cast("string"))
