"""Line dedup by two Bloom filters.

Pass 1: every task sets the hashes of its documents' lines in a once-seen filter and, where that has them already, in a
twice-seen filter. Filters of two tasks merge as once = a | b and twice = ta | tb | (a & b), segment by segment, so a line
that occurs twice anywhere is surely in the merged twice-seen filter.
Pass 2: lines not in the twice-seen filter stay; only the suspects are shuffled, as (digest, document), to be counted
exactly. Of a line found in at least ``least_docs`` documents, the occurrences in one document stay, the rest go.

The filters' size follows the number of rows and is bounded (``bloom.MOST_BITS`` by half), as is the number of tasks that make
them, so that filters are a small part of what the lines are. More lines than they are made for mean more false suspects,
which cost shuffle and never change the result. Texts without a line to drop aren't shuffled: a Bloom filter of the rows
that have one tells them apart, and only those are joined to what they lose.

Defined cases: null and empty texts are one empty line; rows are documents, and rows with one key hold a line together
(each counts; all of those with the key that stays keep their lines); null keys count as the smallest; a line repeated in
one document counts once for it, and all its occurrences there stay or go; columns may have any names, but n_lines and
n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .bloom import SEGMENTS, has, positions, put
from .common import SPACE_CHARS, durable, lean, slices

#: Lines of a row that filters are made for, and bytes of filters that a row may cost.
LINES, COST = 8, 100


def line_key(line: str, least_chars: int) -> bytes | None:
    """What makes lines equal: stripped, A-Z lower-cased. None for lines that are too short to be judged."""
    line = line.strip(SPACE_CHARS)
    return line.encode().lower() if len(line) >= least_chars else None


def digest_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class Filters:
    """A once-seen and a twice-seen Bloom filter."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        hashes, counts = np.unique(hashes, return_counts=True)
        at = positions(hashes, self.bits)
        again = (counts > 1) | has(self.once, at)
        put(self.twice, at[again])
        put(self.once, at)


def merge(parts: Iterator[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    once = twice = None
    for a, b in parts:
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        if once is None:
            once, twice = a.copy(), b.copy()
        else:
            twice |= b | (once & a)
            once |= a
    return once.tobytes(), twice.tobytes()


def twice_seen(docs: DataFrame, least_chars: int, bits: int, text: str = "text", tasks: int | None = None) -> np.ndarray:
    """The merged twice-seen filter over all lines. At most ``tasks`` tasks make filters, so what is shuffled is that many."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, hashes = Filters(bits), []
        for batch in batches:
            for value in batch.column(0):
                found = {k for line in (value.as_py() or "").split("\n") if (k := line_key(line, least_chars)) is not None}
                hashes += [xxhash.xxh3_64_intdigest(k) for k in found]
                if len(hashes) > 100_000:
                    filters.add(np.array(hashes, np.uint64))
                    hashes = []
        filters.add(np.array(hashes, np.uint64))
        size = bits // 8 // SEGMENTS
        for k in range(SEGMENTS):
            once = filters.once[k * size : (k + 1) * size]
            if once.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "once": [once.tobytes()], "twice": [filters.twice[k * size : (k + 1) * size].tobytes()]})

    def join(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, twice = merge((a.as_py(), b.as_py()) for part in parts for a, b in zip(part.column("once"), part.column("twice"), strict=True))
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int32()), "twice": [twice]})

    tasks = tasks or docs.sparkSession.sparkContext.defaultParallelism
    made = docs.select(text).coalesce(tasks).mapInArrow(lean(build), "segment int, once binary, twice binary")
    table, size = np.zeros(bits // 8, np.uint8), bits // 8 // SEGMENTS
    for segment, twice in made.groupBy("segment").applyInArrow(join, "segment int, twice binary").toLocalIterator():
        table[segment * size : (segment + 1) * size] = np.frombuffer(twice, np.uint8)
    return table


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 40, least_docs: int = 5, bits: int | None = None) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and columns n_lines, n_dropped."""
    spark, rows = docs.sparkSession, docs.count()
    bits = bits or bloom.bits_for(LINES * rows, bloom.MOST_BITS // 2)
    tasks = max(spark.sparkContext.defaultParallelism, COST * rows // (bits // 4))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # by place, so that no name of the caller's can clash with one of ours
    own = docs.select(*names).toDF(*[f"c{i}" for i in range(len(names))])
    key, text, at = f"c{names.index(key)}", f"c{names.index(text)}", names.index(text)
    shared = spark.sparkContext.broadcast(twice_seen(own, least_chars, bits, text, tasks).tobytes())
    kind = own.schema[key].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            keys, owner, found = [], [], []
            for i, value in enumerate(batch.column(2)):
                # a key once a document, whatever it repeats
                lines = {k for line in (value.as_py() or "").split("\n") if (k := line_key(line, least_chars)) is not None}
                keys += lines
                owner += [i] * len(lines)
            if not keys:
                continue
            found = np.flatnonzero(has(table, positions(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), bits)))
            rows = pa.array([owner[i] for i in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([digest_of(keys[i]) for i in found], pa.binary())], names=["key", "row", "digest"])

    marked = own.withColumn("row", F.xxhash64(key, text))
    light = durable(marked.select(F.col(key).alias("key"), "row", text).mapInArrow(lean(suspects), f"key {kind}, row long, digest binary"), "suspects")
    shared.destroy()
    # one row per line before the shuffle from each task, however frequent it is; as a table, so that Spark can split the
    # join where a line is
    lines = light.groupBy("digest").agg(F.count("*").alias("docs"), F.max("key").alias("keep")).where(F.col("docs") >= least_docs)
    lines = durable(lines.select("digest", "keep"), "repeated-lines")
    gone = light.join(lines, "digest").where(~F.col("key").eqNullSafe(F.col("keep")))
    # rows with one key and text are one group here: each loses the same lines
    gone = durable(gone.groupBy("key", "row").agg(F.collect_set("digest").alias("gone")), "dropped-lines")

    size = bloom.bits_for(gone.count())
    losing = spark.sparkContext.broadcast(bloom.of(gone.select("row"), size).tobytes())
    maybe = bloom.known_in("row", losing, size)
    joined = marked.where(maybe).withColumnRenamed(key, "k").withColumnRenamed("row", "r")
    joined = joined.join(gone, joined["k"].eqNullSafe(gone["key"]) & (joined["r"] == gone["row"]), "left").withColumnRenamed("k", key)
    columns = [f"c{i}" for i in range(len(names))]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for value, gone in zip(batch.column(at), batch.column(len(names)), strict=True):
                value, gone = value.as_py() or "", gone.as_py()
                if gone:
                    lines, gone = value.split("\n"), set(gone)
                    kept = [line for line in lines if (k := line_key(line, least_chars)) is None or digest_of(k) not in gone]
                    value = "\n".join(kept)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                else:
                    n_lines.append(value.count("\n") + 1)
                    n_dropped.append(0)
                texts.append(value)
            out = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    schema = own.schema.add("n_lines", "long").add("n_dropped", "long")
    touched = joined.select(*columns, "gone").mapInArrow(lean(rebuild), schema)
    # the others lose nothing, and need no Python: a null text is one empty line
    filled = F.coalesce(F.col(text), F.lit(""))
    breaks = F.length(filled) - F.length(F.replace(filled, F.lit("\n"), F.lit("")))
    others = marked.where(~maybe).select(*[filled.alias(c) if c == text else F.col(c) for c in columns], (breaks + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return touched.unionByName(others).toDF(*names, "n_lines", "n_dropped")
