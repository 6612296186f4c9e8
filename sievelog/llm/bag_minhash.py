"""Near-duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures, bands, verified overlap.

A document is a bag of shingles of ``WORDS`` words (white space collapsed, lower case); a shingle's weight is how often it
occurs. Two documents are linked if sum(min) / sum(max) of their weights is at least 0.8, and classes are the connected
components of links.

Signatures. Weights are discretised at integer levels and each dyadic interval of levels, (0,1], (1,2], (2,4], …, of each
shingle has a Poisson process in time, with the interval's length as its rate. A point falls on one level of the interval,
which bits of its hash choose half by half down the hierarchy, and counts if the shingle's weight reaches that level; it
falls in one register, which keeps its earliest point. Registers of two documents agree with a probability of exactly
their weighted Jaccard similarity. Points are made in order of time, all shingles of a batch at once, and a process stops
when it passes its document's latest register, so a document of n shingles takes about n + m log m points, not n m.

Steps. 1: one pass makes each row's signature bands and the digest of its words. 2: rows with equal words are one node,
with its bands once. 3: within a bucket (a band's value) nodes are verified against its most central one, the one that
shares most buckets with most nodes; then those of other classes against the most central of these. 4: in buckets whose
nodes are then still in several classes, every pair of different classes that can be a link is verified (``_rest`` tells
which can). Groups of thousands of copies so take a few verified pairs a node, and no link of a bucket that joins two
classes is lost. Verification is exact, on the bags of shingles; texts are read again only for nodes that share a bucket,
which a Bloom filter of bounded size tells before any text is shuffled. 5: classes are given to rows.

With 32 bands of 6 registers, a pair of similarity 0.8 meets in a bucket with a probability of 0.99994, one of 0.9 surely.

Defined cases: a text of 1 to 4 words is one shingle; null texts and those without words have no shingles and are each a
class of their own, by key; equal words make one class whatever white space and case; repeated rows are in one class; keys
that are null take part, and the class's id is its smallest key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bloom
from .common import SPACE, durable, lean, pieces, release
from .components import components

WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 6
M = BANDS * ROWS
#: Bytes of a long text hashed at a time, and processes followed at a time.
SEGMENT, AT_ONCE = 4_000_000, 500_000
#: Time is kept in integers, so that sums don't depend on how they are taken.
TICK = float(1 << 32)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(times)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
STEP = np.uint64(0xD1342543DE82EF95)


def normal_words(text: str) -> str:
    """Words in lower case with single spaces between them."""
    for space in "\t\n\x0b\x0c\r":
        text = text.replace(space, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ").lower()


def _has_words(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(f"[^{SPACE}]"), F.lit(False))


def _raw(text: str) -> Column:
    """What tells texts apart as they are."""
    return F.unhex(F.md5(F.col(text)))


def _windows(raw: bytes, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle of texts joined by newlines.

    A shingle's hash is that of its bytes, from running sums of a polynomial over all texts.
    """
    b = np.frombuffer(raw, np.uint8)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(len(b) + 1, STEP))
        inverse = np.multiply.accumulate(np.full(len(b) + 1, np.uint64(pow(int(STEP), -1, 1 << 64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[b] * power[:-1], dtype=np.uint64)))
        gaps = np.flatnonzero((b == 32) | (b == 10))
        begin, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(b)]))
        doc = np.concatenate(([0], np.cumsum(b[gaps] == 10)))
        full = begin < end  # no word between two newlines
        begin, end, doc = begin[full], end[full], doc[full]
        count = np.bincount(doc, minlength=n_docs)
        first = np.concatenate(([0], np.cumsum(count)))[doc]
        nth = np.arange(len(doc)) - first
        last = np.minimum(np.arange(len(doc)) + WORDS - 1, first + count[doc] - 1)
        starts = (nth == 0) | (nth + WORDS <= count[doc])
        begin, end, doc = begin[starts], end[last[starts]], doc[starts]
        return doc, mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * ODD)


def _segments(raw: bytes, size: int) -> Iterator[bytes]:
    """Parts of one text of ``size`` bytes or somewhat more; each begins with the last WORDS - 1 words of the one before, so
    that every run of WORDS words is in exactly one part."""
    at = 0
    while len(raw) - at > size:
        end = raw.find(b" ", at + size)
        back = end
        for _ in range(WORDS - 1):
            back = raw.rfind(b" ", at, back)
        # a cut needs words before it that it doesn't repeat, and words after it
        if end < 0 or back <= at:
            break
        yield raw[at:end]
        at = back + 1
    yield raw[at:]


def shingles(texts: list[str], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, weight) of the distinct shingles of each text; texts have single spaces between words.

    A text of more than ``size`` bytes is to come alone; it is then hashed in parts, so that what is held of it besides is
    8 bytes a word.
    """
    raw = "\n".join(texts).encode()
    if not raw:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty
    if len(texts) == 1 and len(raw) > size:
        value = np.concatenate([_windows(part, 1)[1] for part in _segments(raw, size)])
        value.sort()
        doc = np.zeros(len(value), np.int8)
    else:
        doc, value = _windows(raw, len(texts))
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at].astype(np.int64), value[at], np.diff(np.append(at, len(doc)))


def tagged(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A hash for each level of each shingle: bags become sets, and min / max of weights intersection / union."""
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return mixed(np.repeat(value, weight) + nth.astype(np.uint64) * ODD)


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """Registers (n_docs, m) in ticks: the earliest counted point of each. Processes are followed ``AT_ONCE`` at a time, so
    that what is held doesn't grow with a text; the order doesn't matter, as registers keep minima."""
    registers = np.full(n_docs * m, np.iinfo(np.int64).max, np.int64)
    # a process for each dyadic interval that the weight reaches into: (low, low + length]
    who, low, length = np.arange(len(doc)), 0, 1
    while who.size:
        for at in range(0, who.size, AT_ONCE):
            part = who[at : at + AT_ONCE]
            _points(registers, doc[part], value[part], weight[part], low, length, n_docs, m)
        low, length = (1, 1) if low == 0 else (2 * low, 2 * length)
        who = np.flatnonzero(weight > low)
    return registers.reshape(n_docs, m)


def _points(registers: np.ndarray, owner: np.ndarray, value: np.ndarray, limit: np.ndarray, low: int, length: int, n_docs: int, m: int) -> None:
    """Enter the points of one interval's processes, each until it passes its document's latest register."""
    with np.errstate(over="ignore"):
        seed = mixed(value + np.uint64(low + 1) * ODD)
        time, made = np.zeros(len(owner), np.int64), 0
        while len(owner):
            g = int(min(64, max(1, 200_000 // len(owner))))  # few processes: many points of each at once
            point = mixed(seed[:, None] + np.arange(made + 1, made + g + 1, dtype=np.uint64) * STEP)
            wait = -np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / length
            times = time[:, None] + np.cumsum((wait * TICK).astype(np.int64) + 1, axis=1)
            other = mixed(point ^ ODD)
            level = low + (((other >> np.uint64(32)) * np.uint64(length)) >> np.uint64(32)).astype(np.int64)
            counts = level < limit[:, None]
            at = owner[:, None] * m + ((other & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(registers, at[counts], times[counts])
            time, made = times[:, -1], made + g
            latest = registers.reshape(n_docs, m).max(axis=1)
            going = time < latest[owner]
            owner, limit, seed, time = (x[going] for x in (owner, limit, seed, time))


def bands_of(registers: np.ndarray) -> np.ndarray:
    """One hash per band, that holds the band's number."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2]).copy()
        for r in range(ROWS):
            out = mixed(out * STEP + parts[:, :, r])
    return out.astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in pieces(batch.column(2)):
            texts = [normal_words(t) for t in texts]
            doc, value, weight = shingles(texts)
            nodes = pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary())
            bands = bands_of(signatures(doc, value, weight, len(texts)))
            n = np.bincount(doc, weight, len(texts)).astype(np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in (0, 1)), nodes, pa.array(n), rows], names=["key", "raw", "node", "n", "bands"])


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in pieces(batch.column(1)):
            doc, value, weight = shingles([normal_words(t) for t in texts])
            ends = np.cumsum(np.bincount(doc, weight, len(texts)).astype(np.int64))
            bags = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(tagged(value, weight).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), bags], names=["node", "bag"])


def _pairs(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _could(n: str, other: str, similar: float) -> Column:
    """Whether sizes allow a link."""
    return F.least(n, other) >= similar * F.greatest(n, other)


def _overlap_wanted(n: str, other: str, similar: float) -> Column:
    """The overlap that makes a link of bags of these sizes."""
    return similar / (1 + similar) * (F.col(n) + F.col(other)) - 1e-9


def _rest(open_: DataFrame, compared, linked, similar: float) -> DataFrame:
    """The links between classes that stars left apart, in buckets ``open_`` (bucket, node, n, label, centre, second).

    ``centre`` is the bucket's most central node, ``second`` the most central one of another class, if any; every other node
    was verified against both. Each node has one of them as its pivot, the one it is more similar to. With i the overlap of a
    node's bag with a pivot's, two nodes x and y overlap in min(i_x, i_y) at most, unless they share something that the pivot
    lacks. So of all pairs in a bucket only these can be links, and are verified:

    - pairs that share enough shingles that a pivot lacks to make up for the difference,
    - pairs for which min(i_x, i_y) is overlap enough for their sizes.

    Two nodes with ``second`` as their pivot are judged by that, all others by ``centre``. Around a large group of near-copies
    such pairs are few, as what a copy has besides its source is mostly its own; and as central nodes lie amid their
    group, hardly a node that isn't linked to them overlaps enough with them. Nodes are compared with a pivot once, whatever
    the number of buckets.
    """
    open_ = open_.where(F.col("centre").isNotNull())
    ends = [open_.select(F.col(c).alias("a"), F.col("node").alias("b"), "n", "label") for c in ("centre", "second")]
    near = compared(ends[0].union(ends[1].where(F.col("a").isNotNull())).distinct())
    near = near.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "n", "label", F.size("bag_a").alias("pivot_n"), F.size(F.array_intersect("bag_a", "bag_b")).alias("i"), F.array_except("bag_b", "bag_a").alias("other"))
    near = durable(near, "near-pivots")
    light = near.select("pivot", "node", "i", (F.col("i") / (F.col("n") + F.col("pivot_n") - F.col("i"))).alias("s"))
    one, two = (light.select(F.col("pivot").alias(c), "node", F.col("i").alias(f"i_{c}"), F.col("s").alias(f"s_{c}")) for c in ("centre", "second"))
    # side: whether the second is the node's pivot
    rows = open_.join(one, ["centre", "node"]).join(two, ["second", "node"], "left")
    rows = durable(rows.select("bucket", "node", "n", "label", "centre", "second", "i_centre", "i_second", F.coalesce(F.col("s_second") > F.col("s_centre"), F.lit(False)).alias("side")), "pivoted")

    def apart(rows: DataFrame, *key: str) -> DataFrame:
        """Rows whose key occurs in several classes."""
        alike = Window.partitionBy(*key)
        return rows.withColumns({"low": F.min("label").over(alike), "high": F.max("label").over(alike)}).where(F.col("low") != F.col("high")).drop("low", "high")

    # a node's part under a pivot: ``own`` if it is the node's own pivot in some bucket; the others meet only such nodes
    parts = rows.select(F.col("centre").alias("pivot"), "node", (~F.col("side")).alias("own")).union(rows.where("side").select(F.col("second").alias("pivot"), "node", F.lit(True).alias("own")))
    parts = parts.groupBy("pivot", "node").agg(F.max("own").alias("own"))
    spread = near.join(parts, ["pivot", "node"]).select("pivot", "node", "n", "label", "i", "own", F.explode("other").alias("shingle"))
    shared = apart(spread, "pivot", "shingle")
    shared = shared.withColumns({"holders": F.count("*").over(Window.partitionBy("pivot", "shingle")), "owners": F.max("own").over(Window.partitionBy("pivot", "shingle"))}).where("owners")
    # a link of x with y shares k of the shingles that the pivot lacks, k being at least the overlap wanted less i_x; that is
    # 2 similar / (1 + similar) of its size if x is the smaller, similar of it if x is the larger. Of its e such shingles,
    # taken in one order for all, rare ones first, one of the first e - k + 1 is then among the first of the other node too
    own = Window.partitionBy("pivot", "node")
    first = lambda part: F.col("e") - F.greatest(F.ceil(part * F.col("n") - F.col("i") - 1e-9), F.lit(1)) + 1
    shared = shared.withColumns({"place": F.row_number().over(own.orderBy("holders", "shingle")), "e": F.count("*").over(own)})
    shared = shared.withColumns({"as_larger": first(similar), "as_smaller": first(2 * similar / (1 + similar))}).where(F.col("place") <= F.col("as_larger"))
    shared = shared.select("pivot", "shingle", "node", "n", "label", "i", "own", "e", (F.col("place") <= F.col("as_smaller")).alias("early"))
    x, y = (shared.select("pivot", "shingle", *[F.col(c).alias(f"{c}_{side}") for c in shared.columns[2:]]) for side in "xy")
    # x is its pivot's own, y isn't or comes later
    meet = (F.col("label_x") != F.col("label_y")) & (~F.col("own_y") | (F.col("node_x") < F.col("node_y"))) & _could("n_x", "n_y", similar)
    meet = meet & F.when(F.col("n_x") < F.col("n_y"), F.col("early_x")).when(F.col("n_x") > F.col("n_y"), F.col("early_y")).otherwise(F.col("early_x") & F.col("early_y"))
    meet = meet & (F.least("i_x", "i_y") + F.least("e_x", "e_y") >= _overlap_wanted("n_x", "n_y", similar))
    sharing = x.where("own_x").join(y, ["pivot", "shingle"]).where(meet).select(*_pairs("node_x", "node_y")).distinct()

    # overlap o suffices for sizes m and n if o >= similar / (1 + similar) (m + n): the other's size can be ``room`` at most
    room = lambda i: F.col(i) * ((1 + similar) / similar) - F.col("n")
    within = rows.select("bucket", "node", "n", "label", "side", room("i_centre").alias("room"), F.when(F.col("side"), room("i_second")).otherwise(0.0).alias("near_room"))
    within = within.withColumn("least", F.min("n").over(Window.partitionBy("bucket"))).where(F.greatest("room", "near_room") >= F.col("least")).drop("least")
    within = apart(within, "bucket")
    x, y = (within.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in within.columns[1:]]) for side in "xy")
    fits = lambda name: (F.col(f"{name}_x") >= F.col("n_y") - 1e-6) & (F.col(f"{name}_y") >= F.col("n_x") - 1e-6)
    judged = F.when(F.col("side_x") & F.col("side_y"), fits("near_room")).otherwise(fits("room"))
    enough = x.join(y, ["bucket"]).where((F.col("label_x") < F.col("label_y")) & _could("n_x", "n_y", similar) & judged)
    found = linked(sharing.union(enough.select(*_pairs("node_x", "node_y"))).distinct(), "links-rest")
    release(near, rows)
    return found


def row_id(key: Column, raw: Column) -> Column:
    """What tells rows apart by key, which may be null, and text."""
    return F.unhex(F.md5(F.concat_ws("|", F.hex(raw), F.to_json(F.struct(key.alias("k"))))))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest key, nulls last, and of these
    the one whose words' digest is smallest. Rows without words all stay, and so do those that repeat key and words of the
    row that stays; of rows without a key one does.

    Only texts of rows that may go are shuffled: a Bloom filter of bounded size knows those that do.
    """
    found = durable(_classed(docs, key, text, similar).select("node", "main", F.col("key").isNull().alias("nameless"), row_id(F.col("key"), F.col("raw")).alias("row")).distinct(), "judged-rows")
    gone = found.where("not main and not nameless").select("row")
    bits = bloom.bits_for(gone.count())
    shared = docs.sparkSession.sparkContext.broadcast(bloom.of(gone.select(F.xxhash64("row")), bits).tobytes())
    packed = docs.select(F.struct(*docs.columns).alias("d"), F.col(key).isNull().alias("nameless"), _has_words(text).alias("words"), row_id(F.col(key), _raw(text)).alias("row"))
    packed = packed.withColumn("h", F.xxhash64("row"))
    maybe = bloom.known_in("h", shared, bits)
    named = packed.where("not nameless")
    stay = [named.where(~maybe), named.where(maybe).join(gone, "row", "left_anti"), packed.where("nameless and not words")]
    first = F.row_number().over(Window.partitionBy("node").orderBy("row", F.xxhash64("d")))
    nameless = packed.where("nameless and words").join(found.where("main and nameless").select("row", "node"), "row")
    stay.append(nameless.withColumn("nth", first).where(F.col("nth") <= 1))
    parts = [part.select(*[F.col("d").getField(c).alias(c) for c in docs.columns]) for part in stay]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: key, class_id (smallest key of its class), class_size, copies (rows with equal words),
    kept (key is class_id)."""
    found = _classed(docs, key, text, similar)
    return found.select(F.col("key").alias(key), "class_id", "class_size", "copies", F.col("key").eqNullSafe(F.col("class_id")).alias("kept"))


def _classed(docs: DataFrame, key: str, text: str, similar: float) -> DataFrame:
    """key, raw (digest of the text), node (digest of the words), class_id, class_size, copies of each row, and main: whether
    its class is to be kept by rows of its key and words."""
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    rows = durable(given.where(_has_words("text")).select("key", _raw("text").alias("raw"), "text").mapInArrow(lean(_signed), f"key {kind}, raw binary, node binary, n long, bands array<long>"), "signatures")
    # the row that stands for a node: the one with the smallest key, nulls last
    stands = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "raw"))
    nodes = rows.groupBy("node").agg(stands.alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = durable(nodes.select("node", F.col("rep.key").alias("rep"), F.col("rep.raw").alias("raw"), "copies", "n", "bands"), "nodes")

    # buckets with more than one node
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    alike = Window.partitionBy("bucket")
    met = spread.withColumns({"low": F.min("node").over(alike), "high": F.max("node").over(alike), "size": F.count("*").over(alike)}).where(F.col("low") != F.col("high"))
    met = durable(met.select("bucket", "node", "n", "size"), "met")
    # how central a node is: the nodes that it meets, over all of its buckets
    central = met.groupBy("node").agg(F.sum("size").alias("meets"))
    sizes, met = met, durable(met.drop("size").join(central, "node").select("bucket", "node", "n", "meets"), "buckets")

    # the bags of nodes that share a bucket with another, from the one row that stands for each
    wanted = durable(met.select("node").distinct().join(nodes.select("node", "rep", "raw"), "node").select("node", F.col("rep").alias("r"), F.col("raw").alias("w")), "wanted")
    release(sizes)
    bits = bloom.bits_for(wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(bloom.of(wanted.select(F.xxhash64("r")), bits).tobytes())
    some = given.withColumn("h", F.xxhash64("key")).where(bloom.known_in("h", shared, bits)).select("key", "text", _raw("text").alias("raw"))
    texts = some.join(wanted, (some["raw"] == wanted["w"]) & some["key"].eqNullSafe(wanted["r"])).select("node", "text")
    # rows may repeat
    bags = durable(texts.dropDuplicates(["node"]).mapInArrow(lean(_bagged), "node binary, bag array<long>"), "bags")
    shared.destroy()

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b) with both bags: weighted overlap is the overlap of tagged bags."""
        left, right = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
        return pairs.join(left, "a").join(right, "b")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are similar enough."""
        both = F.size(F.array_intersect("bag_a", "bag_b"))
        good = compared(pairs).where(both >= similar * (F.size("bag_a") + F.size("bag_b") - both))
        return durable(good.select("a", "b").distinct(), name)

    def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows (bucket, node, …) of buckets whose nodes are in several classes so far, with their labels."""
        named = rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return named.withColumns({"low": F.min("label").over(alike), "high": F.max("label").over(alike)}).where(F.col("low") != F.col("high")).drop("low", "high")

    def star(rows: DataFrame, centre: str, name: str) -> DataFrame:
        """Links of nodes with the centre of their bucket, where that is of another class."""
        at = F.col(f"{centre}.node")
        tried = rows.where((F.col("label") != F.col(f"{centre}.label")) & _could("n", f"{centre}.n", similar))
        return linked(tried.select(F.least("node", at).alias("a"), F.greatest("node", at).alias("b")).distinct(), name)

    # the most central node of each bucket, and then that of the nodes which are in no class with it
    most = lambda when: F.max(F.when(when, F.struct("meets", "node", "n", "label"))).over(alike)
    first = met.withColumn("label", F.col("node")).withColumn("first", most(F.lit(True)))
    links = star(first, "first", "links-0")
    found = components(links)
    open_ = durable(still_open(first.withColumn("centre", F.col("first.node")).drop("first"), found), "open-buckets")
    release(found)
    there = F.max(F.when(F.col("node") == F.col("centre"), F.col("label"))).over(alike)
    open_ = open_.withColumn("there", there).withColumn("other", most(F.col("label") != F.col("there")))
    links = links.union(star(open_, "other", "links-1"))
    found = components(links)
    left = durable(still_open(open_.select("bucket", "node", "n", "centre", F.col("other.node").alias("second")), found), "open-buckets")
    release(found, met)
    links = durable(links.union(_rest(left, compared, linked, similar)), "all-links")
    release(bags, wanted, left)
    labels = components(links)
    release(links)

    labelled = nodes.join(labels, "node", "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    labelled = durable(labelled, "labelled")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))["node"]
    classes = labelled.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), first.alias("main"))
    held = durable(labelled.join(classes, "label").select("node", "class_id", "class_size", "copies", (F.col("node") == F.col("main")).alias("main")), "classes")
    release(nodes, labels, labelled)
    found = rows.select("key", "raw", "node").join(held, "node").withColumn("main", F.col("main") & F.col("key").eqNullSafe(F.col("class_id")))
    one = F.lit(1).cast("long")
    alone = given.where(~_has_words("text")).select("key", _raw("text").alias("raw"), F.lit(None).cast("binary").alias("node"), F.col("key").alias("class_id"), one.alias("class_size"), one.alias("copies"), F.lit(True).alias("main"))
    return found.select("key", "raw", "node", "class_id", "class_size", "copies", "main").unionByName(alone)
