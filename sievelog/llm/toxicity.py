"""Toxicity by multiple-instance learning.

A document is a bag of sentences. With s the weights of its distinct words, a sentence isn't toxic with probability
(1 + e^bias) / (1 + e^(bias + s)): surely not if no word is known, however many such sentences there are. A document is by
noisy-or: 1 - prod(1 - p), over the sentences of which p is ``LEAST_P`` at least: less is what single words in clean
sentences come to by chance, and thousands of them would make any long text toxic. Weights are trained from document labels alone, and the sentence probabilities then locate what
offends. A word's weight is that of the word itself and of its first four and five letters, so inflected
and compounded forms of an offensive stem are found too.

Training uses a bounded sample of labelled rows (``SAMPLE`` rows, those whose keys come first in hash order); training and
scoring read every document whole, however long.

Defined cases: null and empty texts, and texts without letters, score 0; null labels aren't learned from; no labels of
both kinds to learn from: everything scores 0; repeated rows are learned from once and score alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean, letter_runs, release, slices

SAMPLE = 6000
#: Features must occur in so many sampled documents, and their rates in the two classes differ by so many standard errors.
LEAST_DOCS, LEAST_Z = 3, 3.5
REMEMBERED = 200_000
#: What a sentence's words must outweigh.
BIAS = -8.0
#: Sentences that are less likely toxic have no share in a document's score.
LEAST_P = 0.1

SENTENCE_END = re.compile(r"[.!?\n]+")


def features(word: str) -> list[str]:
    """The word, and its stems marked as such."""
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans between sentence ends."""
    at = 0
    for end in SENTENCE_END.finditer(text):
        yield at, end.start()
        at = end.end()
    yield at, len(text)


def bags(text: str) -> list[set[str]]:
    """The distinct words of each sentence that has any."""
    return [words for s in SENTENCE_END.split(text.lower()) if (words := set(letter_runs(s)))]


def tells(c0, c1, n0, n1):
    """Whether a feature of c0 of n0 clean and c1 of n1 toxic documents is learned. Of numbers or of columns."""
    mean = (c0 + c1) / (n0 + n1)
    gap = c1 / n1 - c0 / n0
    # squared, as columns have no numpy root; rates of 1 leave no error, and no gap
    return (c0 + c1 >= LEAST_DOCS) & (gap > 0) & (gap * gap >= LEAST_Z**2 * mean * (1 - mean) * (1 / n0 + 1 / n1))


def evidence(text: str, at: dict[str, int]) -> Counter:
    """How many of the text's sentences hold which learned features; sentences without any aren't counted."""
    return Counter(tuple(sorted(found)) for words in bags(text) if (found := [i for word in words for f in features(word) if (i := at.get(f)) is not None]))


def fit(rows: list[tuple[str, int]], **how) -> dict:
    """The model from (text, label) rows: {"bias", "weights"}. Plain data, so that it can be sent and stored."""
    labels, by_class = Counter(int(y) for _, y in rows), [Counter(), Counter()]
    if len(labels) < 2:
        return {"bias": -50.0, "weights": {}}
    for text, label in rows:
        by_class[label].update({f for words in bags(text or "") for word in words for f in features(word)})
    kept = sorted(f for f, c1 in by_class[1].items() if tells(by_class[0][f], c1, labels[0], labels[1]))
    at = {f: i for i, f in enumerate(kept)}
    return descend(kept, [(int(y), list(evidence(text or "", at).items())) for text, y in rows], **how)


def descend(kept: list[str], docs: list[tuple[int, list]], *, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> dict:
    """The model from each document's label and the (features, times) of its sentences with evidence.

    Weights are kept at 0 or above, so that no sentence is less likely toxic than one without evidence, which isn't at all.
    """
    index, instance, doc_of, times = [], [], [], []
    for d, (_, own) in enumerate(docs):
        for found, n in own:
            index += found
            instance += [len(doc_of)] * len(found)
            doc_of.append(d)
            times.append(n)
    index, instance, doc_of = (np.array(x, np.int64) for x in (index, instance, doc_of))
    times, y = np.array(times, float), np.array([label for label, _ in docs], float)
    # from 1, as at 0 a toxic document has no slope to speak of
    w = np.ones(len(kept))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        s = BIAS + np.bincount(instance, w[index], len(doc_of))
        p = 1 / (1 + np.exp(-s))
        # log of the probability that no sentence is toxic, each by what its words add to the bias
        none = -np.bincount(doc_of, times * (np.logaddexp(0, s) - np.logaddexp(0, BIAS)), len(docs))
        some = np.maximum(-np.expm1(none), 1e-6)
        slope = (np.where(y == 1, -np.exp(none) / some, 1.0))[doc_of] * times
        g = np.bincount(index, (slope * p)[instance], len(w))
        g = g / len(docs) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = np.maximum(w, 0)
    return {"bias": BIAS, "weights": {f: float(x) for f, x in zip(kept, w)}}


class Scorer:
    def __init__(self, model: dict):
        self.bias, self.weights, self.known = model["bias"], model["weights"], {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, p) of each sentence that is more likely toxic than not."""
        total, found, known = 0.0, [], self.known
        base = float(np.logaddexp(0, self.bias))
        lowered = text.lower()
        if not any(map(self.weight, set(letter_runs(lowered)))):
            # no word of this document says anything
            return 0.0, found
        # lower-casing can change lengths; offsets then come from the text as it is
        source = text if len(lowered) == len(text) else None
        for start, end in sentences(lowered if source is not None else text):
            words = set(letter_runs(lowered[start:end] if source is not None else text[start:end].lower()))
            if not words:
                continue
            s = 0.0
            for word in words:
                w = known.get(word)
                s += self.weight(word) if w is None else w
            if s <= 0.0:
                continue
            none = float(np.logaddexp(0, self.bias + s)) - base
            if (p := float(-np.expm1(-none))) < LEAST_P:
                continue
            total += none
            if p >= 0.5:
                found.append((start, end, p))
        return float(-np.expm1(-total)), found


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", learn_from=None) -> dict:
    """Fit on the sample. ``learn_from``: a condition on the key of rows that may be learned from.

    Texts stay where they are: the driver gets the sample's keys, the features that tell, and which sentences hold them.
    """
    some = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    if learn_from is not None:
        some = some.where(learn_from("_k"))
    # twice as many ids as rows wanted, as some have no text
    ids = some.orderBy(F.xxhash64("_k"), "_k", "_y").limit(2 * SAMPLE)
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(ids), "_k").where(F.col("_t").isNotNull())
    texts = durable(texts.select("_k", F.xxhash64("_t").alias("_h"), "_y", "_t"), "labelled-texts")
    keys = texts.select("_k", "_h", "_y").distinct().orderBy(F.xxhash64("_k"), "_k", "_h", "_y").limit(SAMPLE)
    # as an Arrow table, which takes no Python worker to become a frame again
    chosen = keys.toArrow()
    n = Counter(chosen["_y"].to_pylist())
    if len(n) < 2:
        release(texts)
        return fit([])
    rows = texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, keys.schema)), ["_k", "_h", "_y"]).select("_k", "_h", "_y", "_t")
    head, columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3]), ["_k", "_h", "_y"]

    def mapped(make, kind: str, arrow: pa.DataType) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32)):
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([make(x.as_py()) for x in batch.column(3)], arrow)], names=[*columns, "_f"])

        # rows with one key, text and label are learned from once
        return rows.mapInArrow(lean(run), f"{head}, _f {kind}").dropDuplicates(columns)

    def named(text: str) -> list[str]:
        return sorted({f for word in set(letter_runs(text.lower())) for f in features(word)})

    counts = mapped(named, "array<string>", pa.list_(pa.string())).select("_y", F.explode("_f").alias("f")).groupBy("f").agg(*[F.sum((F.col("_y") == y).cast("long")).alias(f"c{y}") for y in (0, 1)])
    kept = sorted(r.f for r in counts.where(tells(F.col("c0"), F.col("c1"), n[0], n[1])).select("f").collect())
    at = {f: i for i, f in enumerate(kept)}
    pairs = pa.list_(pa.struct([("i", pa.list_(pa.int32())), ("n", pa.int64())]))
    found = mapped(lambda text: [{"i": list(i), "n": n} for i, n in sorted(evidence(text, at).items())], "array<struct<i:array<int>,n:bigint>>", pairs)
    learned = [(r["_y"], [(p.i, p.n) for p in r["_f"]]) for r in found.orderBy("_k", "_h", "_y").select("_y", "_f").collect()]
    release(texts)
    return descend(kept, learned)


def score(docs: DataFrame, model: dict, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted, offending array<struct<start, end, p>> of every row: a map over Arrow batches."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = [scorer.document(x.as_py() or "") for x in batch.column(1)]
            scores = [s for s, _ in rows]
            found = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in f] for _, f in rows], spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), found], names=["key", "score", "predicted", "offending"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {kind}, score double, predicted int, offending array<struct<start:int,end:int,p:double>>").toDF(key, "score", "predicted", "offending")


def keep_clean(docs: DataFrame, model: dict, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer.document(x.as_py() or "")[0] < 0.5 for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
