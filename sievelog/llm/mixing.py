"""Mixing sources to target weights, by DataFrame functions only.

1. Each source's words form one stream, its documents in a fixed order; the stream is packed into blocks of ``block``
   words (the last may be shorter).
2. A source's quota is its target, rounded. Quotas are cut into slots of one block each, in passes ("epochs") over the
   source: within a pass every block occurs once, at the place that a pseudorandom permutation of block indices (one per
   source and pass) gives it. The last slot is cut where the quota ends.
3. Output shards have ``shard`` slots each. Which source fills how many slots of a shard is a multinomial draw: each slot
   draws one of all quota slots with replacement, by a hash of its number, and so its source. The draws of a source are
   numbered through, shard by shard, and a permutation (one per source) maps them to its quota's slots. Draws alone would miss
   the targets by their own noise and take a capped source more often than it may be; so a source's draws beyond its
   quota, which are those that the permutation maps there, are given to the slots that sources drawn too seldom have left.
   Some sqrt(slots) of them change hands; every quota is then met exactly.
4. Within a shard, slots are placed by another permutation. Slots and blocks are joined by (source, block index). A block
   occurs in at most one slot a pass, so no key is frequent.

All of it is arithmetic on indices: reruns give the same mix. Targets: shares of all words by weight, each stopped at
``most`` times its source's size, the excess reshared by weight.

Defined cases: null text has size 0; sources are taken in code point order with null last, each null source row belongs to
one source; rows of size 0 take 0 and lie in no shard; repeated rows are documents of their own; rows without an id take
part like others; empty input gives an empty mix; columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, chunks_for, durable

BLOCK, SHARD, ROUNDS = 256, 1024, 3
#: Slots made by a task, drawn slots that are looked up together, and shards summed together.
PER_TASK, BIN, CHUNK = 65_536, 8192, 1024
#: Multipliers of the permutations; a prime that divides the number of indices is not used for it. Fixed values.
PRIMES = (15485863, 15485867, 15485917)


def size_of(text: str) -> Column:
    """Words in a text: a word starts where a character that isn't white space follows one that is, or the text's start."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _folded(v: Column, bits: Column) -> Column:
    """Upper bits of ``v`` into its lower ones, for v below 2^bits; as a shift by half of the bits drops what it brought, this undoes itself."""
    shift = F.pow(F.lit(2.0), F.floor((bits + 1) / 2))
    return F.when(v < F.pow(F.lit(2.0), bits).cast("long"), v.bitwiseXOR(F.floor(v / shift).cast("long"))).otherwise(v)


def permuted(i: Column, n: Column, bits: Column, seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 (n up to 2^39), ``bits`` = floor(log2 n).

    Rounds of two bijections: an affine map modulo n, and an exclusive or of the upper with the lower bits on the largest
    power of two within n.
    """
    for k in range(ROUNDS):
        times = F.when(n % PRIMES[k] != 0, F.lit(PRIMES[k])).otherwise(F.lit(PRIMES[(k + 1) % len(PRIMES)])).cast("long")
        i = (i * times + (seed * (2 * k + 7919) + 104729 * (k + 1)) % n) % n
        i = bound(i, lambda v: _folded(v, bits))
    return i


def hashed(*parts: Column) -> Column:
    """A number below 2^60 from a hash of the parts' text; parts that are null count as not there."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def bits_of(n: Column) -> Column:
    return F.length(F.conv(F.greatest(n, F.lit(1)).cast("string"), 10, 2)) - 1


def targets(sizes: DataFrame, weights: Sequence[float], most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, weight, target, quota).

    Water-filling in one pass: sources in the order in which they would reach their cap, size to weight; the capped ones
    are those before the first whose share of what is left is no more than its cap. One row per source in one window.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("source_size") / weight, "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    filled = ranked.withColumn("weight", weight).withColumns({
        "left_words": F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = F.col("left_words") / F.col("left_weight")
    filled = filled.withColumn("level", F.min(F.when(level * F.col("weight") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), level.alias("level")))).over(everything)["level"])
    target = F.least(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"), most * F.col("source_size"))
    return filled.select("source", "source_size", "rank", "weight", target.alias("target"), F.round(target).cast("long").alias("quota"))


def streamed(rows: DataFrame, chunks: int) -> DataFrame:
    """Rows (…, id, source, size) with ``start``, their place in their source's stream.

    A running sum in two steps: within chunks of documents, then over the sums of chunks, so that no task holds a source.
    Order: by chunk, which is a hash of id and size, then id, null ids last; rows of one id by size.
    """
    rows = rows.withColumn("chunk", hashed(F.col("id"), F.col("size")) % chunks)
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "chunk").orderBy(F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(offsets, placed["source"].eqNullSafe(offsets["s"]) & (placed["chunk"] == offsets["c"]))
    return joined.withColumn("start", F.col("start") + F.col("offset")).drop("s", "c", "offset", "chunk")


def quotas(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """``targets``' plan with ``n``, the slots of each source's quota, and ``first``, those of the sources before it."""
    full, tail, size, quota = F.floor(F.col("source_size") / block), F.col("source_size") % block, F.col("source_size"), F.col("quota")
    per_epoch = full + F.when(tail > 0, 1).otherwise(0)
    epochs = F.floor(quota / size)
    n = epochs * per_epoch + F.ceil((quota - epochs * size) / block)
    counted = plan.where(F.col("quota") > 0).select("rank", "source_size", "quota", full.alias("full"), per_epoch.alias("per_epoch"), n.alias("n"), bits_of(full).alias("bits"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def drawn(counted: DataFrame, shard: int = SHARD, per_task: int = PER_TASK) -> DataFrame:
    """(shard, rank, c): how many slots of each shard the multinomial draw gives to each source that gets any."""
    spark, slots = counted.sparkSession, counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, -(-slots // per_task))
    draws = spark.range(0, slots, 1, tasks).select(F.floor(F.col("id") / shard).alias("shard"), (hashed(F.col("id")) % max(1, slots)).alias("x"))
    draws = draws.withColumn("bin", F.floor(F.col("x") / BIN))
    bins = counted.select("rank", "first", (F.col("first") + F.col("n")).alias("last"))
    bins = bins.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / BIN), F.floor((F.col("last") - 1) / BIN))))
    # as many rows as slots by BIN and sources: not to be broadcast unseen
    found = draws.join(bins.hint("merge"), "bin").where((F.col("x") >= F.col("first")) & (F.col("x") < F.col("last")))
    return found.groupBy("shard", "rank").agg(F.count("*").alias("c"))


def slots(plan: DataFrame, block: int = BLOCK, shard: int = SHARD, per_task: int = PER_TASK) -> DataFrame:
    """(shard, place, rank, epoch, block, slot_words): every slot of the mix, from ``targets``' plan."""
    counted = durable(quotas(plan, block), "quotas")
    draws = durable(drawn(counted, shard, per_task), "draws")
    count = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, -(-count // per_task))
    # of each source: what it drew, and the surplus or the gaps of those before it
    sources = counted.join(draws.groupBy("rank").agg(F.sum("c").alias("got")), "rank", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    over, short = F.greatest(F.col("got") - F.col("n"), F.lit(0)), F.greatest(F.col("n") - F.col("got"), F.lit(0))
    sources = sources.withColumns({"over_before": F.coalesce(F.sum(over).over(before), F.lit(0)), "short_before": F.coalesce(F.sum(short).over(before), F.lit(0))})
    sources = durable(sources, "drawn-sources")

    # the number of a shard's first draw of a source: a running sum in two steps, over chunks of shards and within them
    chunked = draws.withColumn("chunk", F.floor(F.col("shard") / CHUNK))
    of_chunks = chunked.groupBy("rank", "chunk").agg(F.sum("c").alias("sum"))
    of_chunks = of_chunks.select("rank", "chunk", F.coalesce(F.sum("sum").over(Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = Window.partitionBy("rank", "chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    chunked = chunked.withColumn("k0", F.coalesce(F.sum("c").over(within), F.lit(0))).join(of_chunks, ["rank", "chunk"])
    in_shard = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    chunked = chunked.select("shard", "rank", "c", (F.col("k0") + F.col("offset")).alias("k0"), F.coalesce(F.sum("c").over(in_shard), F.lit(0)).alias("p0"))
    runs = chunked.join(sources.select("rank", "n", "got", "over_before"), "rank").repartition(tasks, "shard", "rank")
    each = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    inside = F.least(F.lit(shard).cast("long"), F.lit(count) - F.col("shard") * shard)
    each = each.select(
        "shard", permuted(F.col("p0") + F.col("i"), inside, bits_of(inside), F.col("shard") + 40009).alias("place"), "rank", "n", "over_before",
        permuted(F.col("k0") + F.col("i"), F.col("got"), bits_of(F.col("got")), F.col("rank") * 31 + 20011).alias("v"),
    )
    kept = each.where(F.col("v") < F.col("n")).select("shard", "place", "rank", F.col("v").alias("k"))
    surplus = each.where(F.col("v") >= F.col("n")).select("shard", "place", (F.col("v") - F.col("n") + F.col("over_before")).alias("r"))
    gaps = sources.where(F.col("n") > F.col("got")).select("rank", "got", "short_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("got") - 1)).alias("i"))
    gaps = gaps.select("rank", (F.col("got") + F.col("i")).alias("k"), (F.col("short_before") + F.col("i")).alias("r"))
    given = surplus.join(gaps.hint("merge"), "r").select("shard", "place", "rank", "k")

    dealt = kept.union(given).join(counted.select("rank", "full", "per_epoch", "bits", "source_size", "quota"), "rank")
    epoch, j, size, quota = F.floor(F.col("k") / F.col("per_epoch")), F.col("k") % F.col("per_epoch"), F.col("source_size"), F.col("quota")
    chosen = F.when(j < F.col("full"), permuted(j, F.greatest(F.col("full"), F.lit(1)), F.col("bits"), F.col("rank") * 31 + epoch * 17 + 1)).otherwise(F.col("full"))
    words = F.least(F.lit(block).cast("long"), size - j * block, quota - epoch * size - j * block)
    return dealt.select("shard", "place", "rank", epoch.alias("epoch"), chosen.alias("block"), words.alias("slot_words"))


def mix(rows: DataFrame, weights: Sequence[float], *, most: float = 3.0, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows``: (…, id, source, size). Returns the placed rows, the plan per source, and the mix's pieces.

    A piece (rank, start, shard, place, epoch, word_from, words) is what a slot takes of the row that starts at ``start``
    in the stream of the source ``rank``: ``words`` words from ``word_from``.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sizes = durable(sizes, "source-sizes")
    plan = durable(targets(sizes.drop("docs"), weights, most), "mix-plan")
    count = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    by_source = plan.select(F.col("source").alias("s"), "source_size", "rank", "target")
    placed = streamed(rows, chunks_for(count, 20_000))
    placed = placed.join(by_source, placed["source"].eqNullSafe(by_source["s"])).drop("s")
    placed = durable(placed, "placed")
    spans = placed.where(F.col("size") > 0).select("rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    # slots come of a few rows of the plan but are as many as blocks: never to be broadcast
    taken = spans.join(slots(plan, block, shard).hint("merge"), ["rank", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("slot_words"))
    pieces = taken.where(end > begin).select("rank", "start", "shard", "place", "epoch", (begin - F.col("start")).alias("word_from"), (end - begin).alias("words"))
    return placed, plan, pieces


def mixed_sizes(docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per document: key, size, source_size, target, taken (words that the mix takes, repeats counted), and of the
    first slot that has words of it shard and place (null if none has)."""
    rows = durable(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size_of(text).alias("size")), "sizes")
    placed, _, pieces = mix(rows, weights, most=most, block=block, shard=shard)
    taken = pieces.groupBy("rank", "start").agg(F.sum("words").alias("taken"), F.min(F.struct("shard", "place")).alias("slot"))
    # rows of size 0 share their start with the row after them
    with_words = placed.where(F.col("size") > 0).join(taken, ["rank", "start"], "left")
    none = placed.where(F.col("size") == 0).withColumns({"taken": F.lit(0).cast("long"), "slot": F.lit(None).cast(taken.schema["slot"].dataType)})
    out = with_words.unionByName(none)
    return out.select(F.col("id").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.col("slot.shard").alias("shard"), F.col("slot.place").alias("place"))


def _pieces_of(docs: DataFrame, weights: Sequence[float], key: str, text: str, source: str, most: float, block: int, shard: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """``docs`` that have words, packed into ``_row`` beside what tells them apart; the mix's pieces with that; its names.

    Rows that agree in id, source, text's hash and size are numbered. The light table is made once, so both sides agree.
    """
    same = ["_id", "_source", "_hash", "_size"]
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_id"), F.col(source).alias("_source"), F.xxhash64(F.col(text)).alias("_hash"), size_of(text).alias("_size"))
    copy = lambda order: F.row_number().over(Window.partitionBy(*same).orderBy(order))
    # rows without words belong to their source but to no slot: one row of a source will do, as they add nothing to its size
    light = marked.select(*same)
    light = durable(light.where(F.col("_size") > 0).withColumn("_copy", copy(F.lit(0))).unionByName(light.where(F.col("_size") == 0).dropDuplicates(["_source"]).withColumn("_copy", F.lit(0))), "sizes")
    rows = light.select(F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("hash"), F.col("_copy").alias("copy"))
    placed, _, pieces = mix(rows, weights, most=most, block=block, shard=shard)
    names = placed.where(F.col("size") > 0).select("rank", "start", F.struct(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("hash").alias("_hash"), F.col("size").alias("_size"), F.col("copy").alias("_copy")).alias("_name"))
    numbered = marked.where(F.col("_size") > 0).withColumn("_copy", copy(F.xxhash64("_row"))).select("_row", F.struct(*same, "_copy").alias("_name"))
    return numbered, pieces.join(names, ["rank", "start"]), same


def _words(text: Column) -> Column:
    """A text's words, each with the white space that follows it."""
    return F.split(F.regexp_replace(text, f"^[{SPACE}]+", ""), rf"(?<=[{SPACE}])(?=[^{SPACE}])")


def mixed_documents(docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row for each pass that takes words of a document.

    A pass that takes the whole document repeats its text as it is; one that takes some of its blocks has those words, in
    order, each with the white space that follows it. Documents of which the mix takes no words don't occur. Texts are
    shuffled once.
    """
    numbered, pieces, _ = _pieces_of(docs, weights, key, text, source, most, block, shard)
    passes = pieces.groupBy("_name", "epoch").agg(F.sort_array(F.collect_list(F.struct("word_from", "words"))).alias("_runs"), F.sum("words").alias("_taken"))
    taken = numbered.join(passes.drop("epoch"), "_name")
    own = F.col("_row").getField(text)
    words = _words(own)
    cut = F.array_join(F.flatten(F.transform("_runs", lambda r: F.slice(words, r["word_from"].cast("int") + 1, r["words"].cast("int")))), "")
    whole = F.when(F.col("_taken") == F.col("_name._size"), own).otherwise(cut)
    return taken.select(*[whole.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])


def mixed_blocks(docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix laid out: one row per slot: shard, place, source, n_words, text. Slots have ``block`` words, but for the last block
    of a source and the last slot of a quota. Words keep the white space after them; documents follow each other at a newline."""
    numbered, pieces, _ = _pieces_of(docs, weights, key, text, source, most, block, shard)
    of_doc = pieces.groupBy("_name").agg(F.collect_list(F.struct("shard", "place", "start", "word_from", "words")).alias("_runs"))
    cut = numbered.join(of_doc, "_name").withColumn("_words", _words(F.col("_row").getField(text)))
    part = F.array_join(F.slice("_words", F.col("run.word_from").cast("int") + 1, F.col("run.words").cast("int")), "")
    cut = cut.select(F.col("_name._source").alias("source"), "_words", F.explode("_runs").alias("run")).select("source", "run.shard", "run.place", "run.start", "run.words", part.alias("part"))
    laid = cut.groupBy("shard", "place").agg(F.first("source").alias("source"), F.sum("words").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"))
    return laid.select("shard", "place", "source", "n_words", F.array_join(F.col("parts.part"), "\n").alias("text"))
