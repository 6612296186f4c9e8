"""Language ID by a linear-chain conditional random field over the words of code-switched text.

Each line of a text, cut into chains of at most ``CHAIN`` words, is a sequence of words with a language each. A word's
emission scores come from its affixes (1 to 3 letters at either end), its character n-grams (2 and 3, with word ends) and
lexicon features (the word itself, and the language that it is most typical of); transitions between languages are
learned. Forward-backward gives each word's posterior; a document's score for a language is the mean over its words.

Only documents' languages are known, so training chains are made of runs of words from one document and, for switching,
of runs from documents of different languages joined. Training uses a bounded sample: ``SAMPLE`` documents for each
language, first in the hash order of their keys, and of each chains of about ``SAMPLE_WORDS`` words from all over its text,
drawn where the text is; and the ``MOST_LANGUAGES`` most frequent languages, as weights are dense by language. Prediction
reads every text whole.

Defined cases: a text that is null or has no letters (numerals such as fractions are none) is ``und`` with score 0; null
languages aren't learned from; nothing to learn from: all are ``und``; repeated rows are predicted alike; ties go to the
first language in code point order.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, letter_runs, pieces, release

SAMPLE, SAMPLE_WORDS, MOST_LANGUAGES, CHAIN, LEXICON = 250, 300, 64, 64, 3000
#: Affixes and n-grams are hashed to so many weights for each language.
SLOTS = 1 << 18
REMEMBERED = 300_000
UNKNOWN = "und"
START, END, MIX = 2, 3, np.uint64(0x9E3779B97F4A7C15)


def hashed_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, slot) of every n-gram of 2 and 3 characters of each word, with its start and end marked, and of the
    affixes of 3 letters (those of 1 and 2 are such n-grams), for all words at once."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == END)
    owner = np.zeros(len(codes), np.int64)
    owner[ends[:-1] + 1] = 1
    owner = np.cumsum(owner)
    numbers, slots, value = [], [], codes
    with np.errstate(over="ignore"):
        for n in (2, 3, 4):
            value = (value[:-1] * MIX) ^ codes[n - 1 :]
            whole = owner[: len(value)] == owner[n - 1 :]
            if n == 4:  # only at the word's start or end
                whole &= (codes[: len(value)] == START) | (codes[3:] == END)
            numbers.append(owner[: len(value)][whole])
            slots.append((((value[whole] + np.uint64(n)) * MIX) >> np.uint64(64 - 18)).astype(np.int64))
    numbers, slots = np.concatenate(numbers), np.concatenate(slots)
    order = np.argsort(numbers, kind="stable")
    return numbers[order], slots[order]


def chains(text: str) -> Iterator[list[str]]:
    """The words of each line, lower case, in runs of at most CHAIN."""
    for line in text.lower().split("\n"):
        words = letter_runs(line)
        for at in range(0, len(words), CHAIN):
            yield words[at : at + CHAIN]


def sampled(text: str, most: int = SAMPLE_WORDS) -> list[list[str]]:
    """Chains of ``most`` words or somewhat more, from all over the text: all chains of a short text, in order; of a longer
    one those that a shuffle seeded by its length puts first."""
    found = [words for words in chains(text) if words]
    if sum(map(len, found)) > most:
        random.Random(len(text)).shuffle(found)
    taken, size = [], 0
    for words in found:
        if size >= most:
            break
        taken.append(words)
        size += len(words)
    return taken


def forward_backward(emission: np.ndarray, transition: np.ndarray, length: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of words (n, T, L), of neighbouring words summed (L, L), and log partition (n), for padded chains.

    Messages are normalised at each step, so long chains neither under- nor overflow.
    """
    n, steps, labels = emission.shape
    top = emission.max(axis=2, keepdims=True)
    e = np.exp(emission - top)
    t = np.exp(transition)
    alive = np.arange(steps)[None, :] < length[:, None]
    e[~alive] = 1.0
    a, scale = np.empty_like(e), np.ones((n, steps))
    for i in range(steps):
        a[:, i] = e[:, i] if i == 0 else (a[:, i - 1] @ t) * e[:, i]
        if i:
            a[~alive[:, i], i] = a[~alive[:, i], i - 1]
        s = a[:, i].sum(axis=1)
        scale[:, i] = np.where(alive[:, i], s, 1.0)
        a[:, i] /= scale[:, i, None]
    b, pair = np.ones_like(e), np.zeros((labels, labels))
    for i in range(steps - 2, -1, -1):
        after = b[:, i + 1] * e[:, i + 1] / scale[:, i + 1, None]
        b[:, i] = np.where(alive[:, i + 1, None], after @ t.T, 1.0)
        if pairs:
            pair += (a[:, i] * alive[:, i + 1, None]).T @ after * t
    word = a * b
    word /= word.sum(axis=2, keepdims=True)
    log_z = (np.log(scale) * alive).sum(axis=1) + (top[:, :, 0] * alive).sum(axis=1)
    return word * alive[:, :, None], pair, log_z


def padded(rows: list[np.ndarray], labels: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), length.max(), labels))
    out[np.arange(out.shape[1])[None, :] < length[:, None]] = np.concatenate(rows)
    return out, length


def fit(rows: list[tuple[str, str]], **how) -> dict:
    """The model from (text, language) rows."""
    return learn([(sampled(text), y) for text, y in rows], **how)


def learn(rows: list[tuple[list[list[str]], str]], *, epochs: int = 6, rate: float = 0.5, l2: float = 1e-6, seed: int = 0) -> dict:
    """The model from (chains, language) rows, as plain data: languages, lexicon entries, weights, transitions."""
    languages = sorted({y for _, y in rows})
    number = {y: i for i, y in enumerate(languages)}
    runs, counts = [], {y: Counter() for y in languages}
    for own, y in rows:
        for words in own:
            runs.append((words, number[y]))
            counts[y].update(words)
    if not runs:
        return {"languages": [], "entries": {}, "weights": np.zeros((SLOTS, 0)), "transitions": np.zeros((0, 0))}
    total = Counter()
    for c in counts.values():
        total.update(c)
    size = {y: sum(c.values()) or 1 for y, c in counts.items()}
    lexicon = {w: max(languages, key=lambda y: (counts[y][w] / size[y], y)) for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    number_of = {w: i for i, w in enumerate(sorted(total))}
    owner, slots = hashed_features(list(number_of))
    coded = np.split(slots, np.cumsum(np.bincount(owner, minlength=len(number_of)))[:-1])
    entries = {w: [SLOTS + 2 * i, SLOTS + 2 * LEXICON + number[y]] for i, (w, y) in enumerate(lexicon.items())}
    coded = {w: np.append(coded[i], entries.get(w, [])).astype(np.int64) for w, i in number_of.items()}
    rng, examples = np.random.default_rng(seed), []
    for i in rng.permutation(len(runs)):
        words, y = runs[i]
        labels = [y] * len(words)
        if rng.random() < 0.3:  # a switch to another document's words within the chain
            other, z = runs[rng.integers(len(runs))]
            keep, more = rng.integers(1, len(words) + 1), rng.integers(1, len(other) + 1)
            words, labels = words[:keep] + other[:more], labels[:keep] + [z] * more
        examples.append(([coded[w] for w in words], np.array(labels)))
    L = len(languages)
    weights, transitions = np.zeros((SLOTS + 2 * LEXICON + L, L)), np.zeros((L, L))
    gw, gt = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(epochs):
        for start in range(0, len(examples), 64):
            part = examples[start : start + 64]
            words = [w for ws, _ in part for w in ws]
            flat = np.concatenate(words)
            owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
            scores = np.add.reduceat(weights[flat], np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1])), axis=0)
            lengths = [len(ws) for ws, _ in part]
            emission, length = padded(np.split(scores, np.cumsum(lengths)[:-1]), L)
            posterior, pair, _ = forward_backward(emission, transitions, length)
            alive = np.arange(emission.shape[1])[None, :] < length[:, None]
            gold = np.concatenate([y for _, y in part])
            error = posterior[alive]
            error[np.arange(len(gold)), gold] -= 1
            # only the slots that occur here move
            used, place = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(used), L))
            np.add.at(grad, place, error[owner])
            for _, y in part:
                np.subtract.at(pair, (y[:-1], y[1:]), 1)
            grad, pair = grad / len(part) + l2 * weights[used], pair / len(part) + 1e-3 * transitions
            gw[used] += grad * grad
            gt += pair * pair
            weights[used] -= rate * grad / np.sqrt(gw[used])
            transitions -= 0.1 * pair / np.sqrt(gt)
    return {"languages": languages, "entries": entries, "weights": weights.astype(np.float32), "transitions": transitions}


class Tagger:
    def __init__(self, model: dict):
        self.__dict__.update(model)
        self.known: dict[str, int] = {}
        self.emissions = np.zeros((0, len(self.languages)), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Emission scores of words that aren't known yet, all at once."""
        owner, slots = hashed_features(words)
        scores = np.add.reduceat(self.weights[slots], np.searchsorted(owner, np.arange(len(words))), axis=0)
        for i, w in enumerate(words):
            if (entry := self.entries.get(w)) is not None:
                scores[i] += self.weights[entry].sum(axis=0)
        self.known.update(zip(words, range(len(self.emissions), len(self.emissions) + len(words)), strict=True))
        self.emissions = np.concatenate((self.emissions, scores))

    def words(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(text's number, posteriors of its chain's words) of every chain, grouped by length."""
        found = [(i, words) for i, text in enumerate(texts) for words in chains(text) if words]
        new = {w for _, words in found for w in words}.difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.emissions, new = {}, self.emissions[:0], {w for _, words in found for w in words}
            self._learn(sorted(new))
        found.sort(key=lambda x: len(x[1]))
        for at in range(0, len(found), 2000):
            part = found[at : at + 2000]
            length = np.array([len(words) for _, words in part])
            codes = np.fromiter((self.known[w] for _, words in part for w in words), np.int64)
            emission = np.zeros((len(part), length.max(), len(self.languages)))
            emission[np.arange(length.max())[None, :] < length[:, None]] = self.emissions[codes]
            posterior, _, _ = forward_backward(emission, self.transitions, length, pairs=False)
            for (i, words), p in zip(part, posterior, strict=True):
                yield i, p[: len(words)]

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        n = len(self.languages)
        if not n:
            return [(UNKNOWN, 0.0)] * len(texts)
        total, count = np.zeros((len(texts), n)), np.zeros(len(texts))
        for i, p in self.words(texts):
            total[i] += p.sum(axis=0)
            count[i] += len(p)
        best = total.argmax(axis=1)
        return [(self.languages[b], float(min(1.0, t[b] / c))) if c else (UNKNOWN, 0.0) for b, t, c in zip(best, total, count, strict=True)]


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", learn_from=None) -> dict:
    """Fit on the sample. ``learn_from``: a condition on the key of rows that may be learned from.

    Ids are chosen without a look at texts, then the texts of the chosen ids are read once; only words reach the driver.
    """
    some = docs.where(F.col(lang).isNotNull()).select(F.col(key).alias("_k"), F.col(lang).alias("_l"))
    if learn_from is not None:
        some = some.where(learn_from("_k"))
    known = [r[0] for r in some.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(MOST_LANGUAGES).select("_l").collect()]
    # twice as many ids as wanted, as some have no text; Spark keeps no more than these of a language before the shuffle either
    by_id = Window.partitionBy("_l").orderBy(F.xxhash64("_k"), "_k")
    ids = some.where(F.col("_l").isin(known)).withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= 2 * SAMPLE).select("_k", "_l").distinct()
    own = docs.select(F.col(key).alias("_i"), F.col(lang).alias("_m"), F.col(text).alias("_t"))
    chosen = own.join(F.broadcast(ids), F.col("_i").eqNullSafe(F.col("_k")) & (F.col("_m") == F.col("_l"))).where(F.col("_t").isNotNull())
    chosen = chosen.select("_k", "_l", F.xxhash64("_t").alias("_h"), "_t")
    first = Window.partitionBy("_l").orderBy(F.xxhash64("_k"), "_k", "_h")
    light = durable(_drawn(chosen), "language-sample")
    rows = light.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLE).orderBy("_l", "_n").select("_c", "_l").collect()
    release(light)
    return learn([(r[0], r[1]) for r in rows])


def _drawn(chosen: DataFrame) -> DataFrame:
    """(_k, _l, _h, _t) with the sampled chains of a text for the text."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(3)):
                found = pa.array([sampled(t) for t in texts], pa.list_(pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in range(3)), found], names=["_k", "_l", "_h", "_c"])

    return chosen.mapInArrow(run, f"{kinds}, _c array<array<string>>")


def predict(docs: DataFrame, model: dict, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of every row: a map over Arrow batches, some 2 MB of text at a time."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for at, texts in pieces(batch.column(1), 2_000_000):
                rows = tagger.documents(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.float64())], names=["key", "lang_pred", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").toDF(key, "lang_pred", "score")
