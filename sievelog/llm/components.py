"""Connected components of a table of links, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): label is a node of its component, the same for all of these.

    Each round every node points to that of itself and its neighbours which comes first in a pseudorandom order, pointers are
    followed once more, and links are drawn anew between the nodes pointed to. In such an order ways down are short, so that
    at least half of the nodes that still have links go each round, about; the order of the nodes themselves would go down a
    sorted chain link by link. As the order stays, a star takes two rounds however large it is. Each round's tables go
    when the next one's are there.
    """
    links = durable(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    place = lambda node: F.struct(F.xxhash64(node).alias("place"), F.col(node).alias("node"))
    for _ in range(most_rounds):
        if links.isEmpty():
            break
        both = links.select("a", "b").union(links.select("b", "a"))
        to = both.groupBy("a").agg(F.min(place("b")).alias("first"))
        near = durable(to.select(F.col("a").alias("node"), F.least(place("a"), "first")["node"].alias("to")), "pointers")
        up = near.select(F.col("node").alias("to"), F.col("to").alias("up"))
        to = durable(near.join(up, "to").select("node", F.col("up").alias("to")), "pointers")
        ends = to.select(F.col("node").alias("a"), F.col("to").alias("new_a")), to.select(F.col("node").alias("b"), F.col("to").alias("new_b"))
        drawn = links.join(ends[0], "a").join(ends[1], "b").where(F.col("new_a") != F.col("new_b"))
        drawn = durable(drawn.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "links")
        if labels is None:
            labels = durable(to.select("node", F.col("to").alias("label")), "labels")
        else:
            moved, old = to.select(F.col("node").alias("label"), F.col("to").alias("new")), labels
            labels = durable(old.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
            release(old)
        release(links, near, to)
        links = drawn
    else:
        raise RuntimeError("components: too many rounds")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
