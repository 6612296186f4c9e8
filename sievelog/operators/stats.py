"""Counts of what a run read, decided and wrote: as a frame, as an observation of a running query, or as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("admitted", "input_tombstones", "input_bytes", "dropped", "generated_tombstones", "passed", "projected", "invalid_json", "evaluation_failures", "output_records", "output_bytes")


def counters(rendered: str | None = "rendered") -> list[Column]:
    """Aggregates over transformed records. A source tombstone that stays one isn't a generated one; input bytes are
    payload bytes; output bytes are those of the rendered column, if there is one."""
    is_ = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    action, source = F.col("action"), F.col("value")
    out = action.isin("tombstone", "pass", "project")
    written = F.octet_length(rendered) if rendered else F.lit(0)
    found = {
        "admitted": F.count(F.lit(1)), "input_tombstones": is_(source.isNull()), "input_bytes": F.coalesce(F.sum(F.octet_length(source).cast("long")), F.lit(0)),
        "dropped": is_(action == "drop"), "generated_tombstones": is_((action == "tombstone") & source.isNotNull()), "passed": is_(action == "pass"), "projected": is_(action == "project"),
        "invalid_json": is_(F.col("issue") == "InvalidJson"), "evaluation_failures": is_(F.col("issue") == "Evaluation"),
        "output_records": is_(out), "output_bytes": F.coalesce(F.sum(F.when(out, written.cast("long"))), F.lit(0)),
    }
    return [found[n].alias(n) for n in COUNTERS]


def statistics(acted: DataFrame, rendered: str | None = "rendered") -> DataFrame:
    return acted.agg(*counters(rendered))


def report(values: dict, elapsed_ms: int) -> str:
    return " ".join([*(f"{n}={values[n]}" for n in COUNTERS), f"elapsed_ms={elapsed_ms}"])
