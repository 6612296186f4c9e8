"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest: each digest with the row that holds it. New data is reduced to one row
per digest, joined to the index by a sort-merge anti-join (the index's side needs no shuffle), and what is new is appended.
A table is fed to it in batches of ascending keys, so that a later batch never holds a smaller key than the index.

Defined cases: null text counts as empty; equal texts are those with the same SHA-256 after each run of white space
becomes one space; the smallest key stays and null keys come last; repeated rows are copies of each other, of which every
one with the key that stays is kept, for they can't be told apart; empty input gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, durable


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+", " ")


def digest(text: str) -> Column:
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """A table (digest, keep_id) in the warehouse, in ``buckets`` files a batch, each sorted by digest.

    Choose ``buckets`` for the size the index is to reach: a bucket should fit a task (at 100 TB of short documents some
    10^10 digests of 64 bytes: 4096 buckets of 160 MB). ``compact`` rewrites a bucket's files as one.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        """Whether the table is there. A compaction that was cut off between dropping the old table and renaming the new
        one is finished; the rest of one that was cut off earlier goes."""
        there, new = self.spark.catalog.tableExists(self.table), self.spark.catalog.tableExists(self._new)
        if new and not there:
            self.spark.sql(f"ALTER TABLE {self._new} RENAME TO {self.table}")
        elif new:
            self.spark.sql(f"DROP TABLE {self._new}")
        return there or new

    @property
    def _new(self) -> str:
        return f"{self.table}_compacted"

    def create(self, key_type: str = "bigint") -> None:
        self._write(self.spark.createDataFrame([], f"digest string, keep_id {key_type}"))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame, table: str | None = None) -> None:
        # dealt out as the buckets are, so that each task writes one file for one bucket
        rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(table or self.table, format="parquet")

    def add(self, found: DataFrame) -> DataFrame:
        """Append the digests of ``found`` (digest, keep_id; one row per digest) that the index lacks; return them."""
        if not self.exists():
            self.create(found.schema["keep_id"].dataType.simpleString())
        new = durable(found.join(self.rows().hint("merge"), "digest", "left_anti"), "new-digests")
        self._write(new)
        return new

    def compact(self) -> None:
        """The new table is whole before the old one goes, and is found by ``exists`` should the driver be lost in between."""
        if self.exists():
            self._write(self.rows(), self._new)
            self.spark.sql(f"DROP TABLE {self.table}")
            self.exists()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def batch_edges(light: DataFrame, batches: int, sample: int = 1000) -> list:
    """Keys that cut a table (_key, …) into ``batches`` of about the same size, from ``sample`` keys, first in hash order."""
    if batches < 2:
        return []
    rows = light.where(F.col("_key").isNotNull()).orderBy(F.xxhash64("_key", "digest")).limit(sample).select("_key").collect()
    keys = sorted(r[0] for r in rows)
    return sorted({keys[len(keys) * i // batches] for i in range(1, batches)}) if keys else []


def dedup(docs: DataFrame, index: DigestIndex, *, key: str = "doc_id", text: str = "text", batches: int = 1) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256. The index then holds all its digests.

    ``keep_id`` is the row of the index's earlier data, if it has the text, else the smallest key of these data;
    ``group_size`` counts rows of these data. ``batches``: how many parts, by ascending key, meet the index one after
    another. Only keys and digests are shuffled. A group of any size is one row per task before the shuffle; looking groups
    up by digest is a sort-merge join that Spark splits where a digest is frequent.
    """
    light = durable(docs.select(F.col(key).alias("_key"), digest(text).alias("digest")), "digests")
    edges = batch_edges(light, batches)
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = light
        if low is not None:
            # null keys come last
            part = part.where(F.col("_key").isNull() | (F.col("_key") >= low) if high is None else F.col("_key") >= low)
        if high is not None:
            part = part.where(F.col("_key") < high)
        index.add(part.groupBy("digest").agg(F.min("_key").alias("keep_id")))
    # kept as a table: joined to the bucketed side directly, the rows of a frequent digest could not be split
    counts = light.groupBy("digest").agg(F.count("*").alias("group_size"))
    held = durable(counts.join(index.rows().hint("merge"), "digest"), "held-digests")
    return light.join(held, "digest").select(
        F.col("_key").alias(key), "keep_id", "group_size", F.col("_key").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def dedup_once(docs: DataFrame, *, batches: int = 4, **columns: str) -> DataFrame:
    """``dedup`` of one table, in batches, by an index of its own, dropped once the table is resolved."""
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    try:
        return durable(dedup(docs, index, batches=batches, **columns), "deduplicated")
    finally:
        index.drop()
