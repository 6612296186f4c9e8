"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

The trees are split on a bounded random sample (``SAMPLE`` vectors): a node's hyperplane lies halfway between two of its
sample's points, and so down to leaves of about ``LEAF`` sample points. All distinct vectors are then filed under the leaf
of each tree. A query walks all trees with one queue, ordered by the largest margin by which it is on the other side of a
hyperplane on the way to a node, until the leaves that it has seen hold a set share of the vectors; these are compared
with it exactly, in double precision. The share is the one that reaches the recall asked for within the sample, as brute
force over the sample tells.

Equal vectors are filed once, with their smallest ids (as many as a query may return, and one more, as its own is left
out), and equal queries are searched once. Leaves are cut into pieces of about ``PIECE`` vectors, so a full leaf is shared
by many tasks. The trees, whose size depends on the sample alone, are broadcast.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take no part, nor do those without an
id as candidates; vectors of different lengths aren't compared; equal distances are ordered by id, and
of the vectors seen none is left out for another at the same distance with a greater id; fewer than ``k`` other vectors: all of
them; rows with one id and several vectors are each a candidate, and a query; rows with one id and one vector count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, release

SAMPLE, LEAF, TREES, PIECE = 20_000, 48, 16, 4096


class Tree:
    """Inner nodes: normal, offset and two children; a child below 0 is the leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.offsets, self.children, self.share = [], [], [], []
        self.root = self._split(sample, np.arange(len(sample)), leaf, rng)
        self.normals, self.offsets = np.array(self.normals).reshape(-1, sample.shape[1]), np.array(self.offsets)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _split(self, sample: np.ndarray, own: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(own) > leaf:
            for _ in range(5):
                p, q = sample[rng.choice(own, 2, replace=False)]
                normal = p - q
                if not (norm := np.linalg.norm(normal)):
                    continue
                normal /= norm
                along = sample[own] @ normal
                offset = float((p + q) @ normal / 2)
                left = along < offset
                if 0.05 * len(own) <= left.sum() <= 0.95 * len(own):
                    break
            else:
                # no even split between two points: a random direction, at the median
                normal = rng.standard_normal(sample.shape[1])
                normal /= np.linalg.norm(normal)
                along = sample[own] @ normal
                offset = float(np.median(along))
                left = along < offset
            if left.any() and not left.all():
                at = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append(None)
                self.children[at] = (self._split(sample, own[left], leaf, rng), self._split(sample, own[~left], leaf, rng))
                return at
        self.share.append(len(own))
        return -len(self.share)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, level by level."""
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.normals[n]) >= self.offsets[n]
            at[inner] = self.children[n, right.astype(int)]
        return -1 - at


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.trees, self.size = [Tree(sample, leaf, rng) for _ in range(trees)], len(sample)

    def search(self, x: np.ndarray, share: float) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs for one query whose leaves held ``share`` of the sample, over all trees."""
        # the margins to all hyperplanes at once; the walk then only looks them up
        margins = [(t.normals @ x - t.offsets) if len(t.normals) else t.offsets for t in self.trees]
        queue = [(-np.inf, i, t.root) for i, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found, have, enough = [], 0, share * self.size - 1e-6
        while queue and (have < enough or len(found) < len(self.trees)):
            slack, i, at = heapq.heappop(queue)
            while at >= 0:
                margin = margins[i][at]
                near, far = (1, 0) if margin >= 0 else (0, 1)
                heapq.heappush(queue, (max(slack, abs(margin)), i, int(self.trees[i].children[at, far])))
                at = int(self.trees[i].children[at, near])
            found.append((i, -1 - at))
            have += self.trees[i].share[-1 - at]
        return found


    def share_for(self, sample: np.ndarray, recall: float, k: int, trials: int = 100) -> float:
        """The share that finds ``recall`` of the k nearest in the sample, for evenly chosen rows of it, by brute force.

        Of each true neighbour it is noted how much the search has seen when it comes to the first leaf that holds it.
        """
        leaves = [t.leaves(sample) for t in self.trees]
        norms, needed = np.einsum("ij,ij->i", sample, sample), []
        for q in np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int):
            near = norms - 2 * sample @ sample[q]
            near[q] = np.inf
            seen, first = 0, {}
            for i, leaf in self.search(sample[q], float(len(self.trees))):
                seen += self.trees[i].share[leaf]
                first[(i, leaf)] = seen / self.size
            top = min(k, len(sample) - 1)
            needed += [min(first[(i, int(own[n]))] for i, own in enumerate(leaves)) for n in np.argpartition(near, top - 1)[:top]] if top else []
        return float(np.quantile(needed, recall)) if needed else 1.0


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, key: str = "vec_id", vector: str = "embedding", recall: float = 0.95, seed: int = 0) -> DataFrame:
    """(query_id, rank, key, score): the k nearest found of ``vectors`` for each row of ``queries`` but itself, by key.

    ``recall``: what the search is set to find of the sample's true neighbours; it decides how many leaves are visited.
    """
    spark = vectors.sparkSession
    # single precision travels as it is, and is widened where it is compared
    real = "float" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "double"

    def usable(df: DataFrame, name: str) -> DataFrame:
        """(name, v, h): the vectors that take part, and a hash that tells them apart; minus zero counts as zero."""
        broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        whole = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~broken & F.exists(vector, lambda x: x != 0))
        whole = whole.select(F.col(key).alias(name), F.transform(vector, lambda x: x.cast(real) + F.lit(0.0).cast(real)).alias("v"))
        return whole.withColumn("h", F.unhex(F.md5(F.concat_ws(",", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))))

    smallest = Window.partitionBy("h").orderBy(F.col("id").asc_nulls_last())
    ids = durable(usable(vectors, "id").select("h", "id", "v").dropDuplicates(["h", "id"]), "vectors")
    # the first k + 1 ids of equal vectors; Spark keeps no more than these of a group before the shuffle either
    firsts = ids.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    distinct = durable(firsts.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("v", "nth").alias("v")), "distinct-vectors")
    asked = durable(usable(queries, "q"), "queries")
    kind = vectors.schema[key].dataType.simpleString()
    # distances are between vectors of one length, of which a table has one as a rule: each is searched by itself
    lengths = sorted(r[0] for r in distinct.select(F.size("v")).distinct().collect())
    parts = [_search(distinct.where(F.size("v") == dim), asked.where(F.size("v") == dim), dim, kind, real, k, recall, seed) for dim in lengths]
    release(distinct, ids)
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    ranked = reduce(DataFrame.union, parts)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _search(distinct: DataFrame, asked: DataFrame, dim: int, kind: str, real: str, k: int, recall: float, seed: int) -> DataFrame:
    """(q, rank, id, score) for vectors (h, ids, v) and queries (q, v, h) of ``dim`` components."""
    spark = distinct.sparkSession
    sample = distinct.orderBy(F.xxhash64("h", F.lit(seed))).limit(SAMPLE).select("v").collect()
    known = np.array([r.v for r in sample], float)
    forest = Forest(known, seed=seed)
    share = forest.share_for(known, recall, k)
    forest = spark.sparkContext.broadcast(forest)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for i, tree in enumerate(forest.value.trees):
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(x) * len(forest.value.trees) + i), *batch.columns], names=["leaf", "h", "v", "id"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, x in enumerate(matrix(batch.column(1))):
                found = np.array([leaf * len(forest.value.trees) + i for i, leaf in forest.value.search(x, share)])
                same = pa.array(np.full(len(found), n))
                yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(0).take(same), batch.column(1).take(same)], names=["leaf", "qh", "qv"])

    filed = distinct.where(F.size("ids") > 0).select("h", "v", F.col("ids")[0].alias("id")).mapInArrow(file, f"leaf long, h binary, v array<{real}>, id {kind}")
    sizes = durable(filed.groupBy("leaf").agg(F.ceil(F.count("*") / PIECE).alias("pieces")), "leaf-sizes")
    filed = filed.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("h"), "pieces").alias("piece"), "h", "v", "id")
    probes = asked.groupBy("h").agg(F.first("v").alias("v")).select("h", "v").mapInArrow(probe, f"leaf long, qh binary, qv array<{real}>")
    probes = probes.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "qh", "qv")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("qh", pa.binary()), ("h", pa.binary()), ("id", left.schema.field("id").type), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        names, ids, asking = left.column("h").combine_chunks(), left.column("id").combine_chunks(), right.column("qh").combine_chunks()
        x, queries = matrix(left.column("v").combine_chunks()), matrix(right.column("qv").combine_chunks())
        norms, parts, by_id = np.einsum("ij,ij->i", x, x), [], np.empty(len(x), np.int64)
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(x))
        top = min(k + 1, len(x))
        for at in range(0, len(queries), 256):
            # a product finds all that can be among the nearest, given its rounding; differences then give their distances
            q = queries[at : at + 256]
            near = norms[None, :] - 2 * q @ x.T
            error = 4 * (dim + 2) * np.finfo(float).eps * (norms.max() + np.einsum("ij,ij->i", q, q))
            # an overflow isn't greater either
            row, picked = np.nonzero(~(near > (np.partition(near, top - 1, axis=1)[:, top - 1] + 2 * error)[:, None]))
            score = np.empty(len(row))
            for i in range(0, len(row), 1 << 16):
                gap = x[picked[i : i + (1 << 16)]] - q[row[i : i + (1 << 16)]]
                score[i : i + (1 << 16)] = np.sqrt((gap * gap).sum(axis=1))
            order = np.lexsort((by_id[picked], score, row))
            row, picked, score = row[order], picked[order], score[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < top
            picked = pa.array(picked[first])
            parts.append(pa.Table.from_arrays([asking.take(pa.array(at + row[first])), names.take(picked), ids.take(picked), pa.array(score[first])], schema=out))
        return pa.concat_tables(parts)

    compared = filed.groupBy("leaf", "piece").cogroup(probes.groupBy("leaf", "piece")).applyInArrow(compare, f"qh binary, h binary, id {kind}, score double")
    once = compared.groupBy("qh", "h", "id").agg(F.min("score").alias("score"))
    best = once.withColumn("nth", F.row_number().over(Window.partitionBy("qh").orderBy("score", "id"))).where(F.col("nth") <= k + 1).drop("id")
    # each distinct vector brings its first ids; then the query's own row goes
    pairs = best.join(distinct.select("h", "ids"), "h").select("qh", "score", F.explode("ids").alias("id"))
    first = Window.partitionBy("qh").orderBy("score", "id")
    short = durable(pairs.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("qh", "score", "id"), "nearest")
    forest.destroy()
    release(sizes)
    mine = asked.select("q", "h").distinct().join(short, F.col("h") == F.col("qh")).where(~F.col("q").eqNullSafe(F.col("id")))
    return mine.withColumn("rank", F.row_number().over(Window.partitionBy("q", "h").orderBy("score", "id"))).where(F.col("rank") <= k).select("q", "rank", "id", "score")
