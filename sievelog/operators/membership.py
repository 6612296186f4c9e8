"""Membership in a set kept as a table: the join that stands in for looking a key up in a large constant object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_key(path: str) -> Column:
    """The text at a field path of a JSON value, NULL unless it is a string."""
    return F.try_variant_get(F.try_parse_json(F.col("value").cast("string")), "$" + "".join(f"['{p}']" for p in path.split(".")), "string")


def members(log: DataFrame, key: Column, allowed: DataFrame, *, keep: bool = True) -> DataFrame:
    """Records whose key is (or with ``keep`` off, isn't) in ``allowed``'s only column.

    Spark broadcasts the set while it is under its size threshold and sorts both sides beyond. Records without a key are
    in no set.
    """
    named = allowed.toDF("_member").where(F.col("_member").isNotNull()).distinct()
    return log.withColumn("_key", key).join(named, F.col("_key") == F.col("_member"), "left_semi" if keep else "left_anti").drop("_key")
