"""A corpus pipeline of five operators: each stage is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.llm import bag_minhash, byte_bpe, line_dedup, mixing, toxicity
from sievelog.llm.common import shared_dir
from sievelog.llm.queries import WEIGHTS, bpe_model, table, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from these documents and the labels, rejects go; others stay as they are."""
    return toxicity.keep_clean(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all its lines stays, with empty text. n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays (rows that repeat its id and words stay with it), whatever
    becomes of other texts with that id."""
    return bag_minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix that takes words of a document, with those words. n_chars follows the text."""
    return mixing.mixed_documents(docs, WEIGHTS).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, as number and digests, and the digest of what they decode to."""
    return byte_bpe.round_trip(docs, *bpe_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can express neither the trained model, nor the signatures, nor the encoding: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """The stages' result. ``at``: a folder for this run's tables, by which a run that was cut off goes on after the last stage
    that it wrote; without one, a table goes once the next stage has read it."""
    docs, own = table(spark, sf_dir, "documents"), at is None
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}" if own else at.rstrip("/")
    files, path = spark._jvm.org.apache.hadoop.fs, lambda i, name="": f"{at}/{i}{name}"
    system = files.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, (_, stage) in enumerate(STAGES):
        if not system.exists(files.Path(path(i, "/_SUCCESS"))):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path(i))
        docs = spark.read.parquet(path(i))
        if own and i:
            system.delete(files.Path(path(i - 1)), True)
    return docs
