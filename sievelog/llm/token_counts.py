"""Token counts per field or section by offset-mapped attribution.

Each document is encoded once, whole. The byte lengths of its tokens give their character spans, and an interval join with
the spans of the document's sections says which sections each token touches. A token that crosses a boundary is allocated
by an explicit rule:

- ``start``: to the section that holds its first character,
- ``end``: to the section that holds its last character,
- ``share``: to each section by the share of the token's bytes that lie in it (fractional counts).

Counts of a document's sections add up to its tokens. Defined cases: null and empty texts have one empty section with 0
tokens; a token that holds part of a multi-byte character spans that character; sections without characters get 0 (``start``,
``end``); repeated rows are counted each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RULES = ("start", "end", "share")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens: base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Byte starts of lines; a line holds the newline that ends it."""
    return np.concatenate(([0], np.flatnonzero(raw == 10) + 1))


def attribute(ends: np.ndarray, starts: np.ndarray, total: int, rule: str) -> np.ndarray:
    """Interval join of token spans, given by their byte ends, with sections, given by their byte starts.

    Returns tokens per section. Both sides are sorted, so a binary search finds the section of each token's edge.
    """
    n = len(starts)
    if not len(ends):
        return np.zeros(n)
    begins = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float)
    whole = first == last
    counts = np.bincount(first[whole], minlength=n).astype(float)
    edges = np.append(starts, total)
    for i in np.flatnonzero(~whole):
        for k in range(first[i], last[i] + 1):
            counts[k] += (min(ends[i], edges[k + 1]) - max(begins[i], edges[k])) / (ends[i] - begins[i])
    return counts


def section_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, rule: str = "start", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section (line) of each document: key, section (from 0), char_start, char_end, n_tokens.

    A map over Arrow batches: no shuffle, memory bounded by a batch. The vocabulary is broadcast; its size is that of the
    rank file, whatever the corpus.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        size = np.zeros(max(shared.value.values(), default=0) + 1, dtype=np.int64)
        for token, rank in shared.value.items():
            size[rank] = len(token)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids, out = [], [[], [], [], []]
                for doc, value in zip(batch.column(0)[at : at + 200].to_pylist(), batch.column(1)[at : at + 200].to_pylist(), strict=True):
                    value = value or ""
                    raw = np.frombuffer(value.encode(), dtype=np.uint8)
                    starts = line_starts(raw)
                    ends = np.cumsum(size[encoding.encode_to_numpy(value, disallowed_special=())])
                    counts = attribute(ends, starts, len(raw), rule)
                    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before each byte
                    edges = chars[np.append(starts, len(raw))]
                    ids += [doc] * len(starts)
                    for to, x in zip(out, (np.arange(len(starts)), edges[:-1], edges[1:], counts), strict=True):
                        to.append(x)
                arrays = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *[pa.array(x, pa.int64()) for x in arrays[:3]], pa.array(arrays[3], pa.float64())], names=[key, "section", "char_start", "char_end", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"{key} {kind}, section long, char_start long, char_end long, n_tokens double")
