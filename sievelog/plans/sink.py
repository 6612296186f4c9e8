"""Writing rendered records: to a byte stream through the driver."""

from __future__ import annotations

from typing import BinaryIO

from pyspark.sql import DataFrame


def to_stream(rendered: DataFrame, out: BinaryIO, unbuffered: bool = False) -> int:
    """Write every record in the frame's order, one partition in memory at a time; returns the bytes written.

    A reader that has gone ends the writing without an error.
    """
    written = 0
    try:
        for row in rendered.select("rendered").toLocalIterator(prefetchPartitions=True):
            written += out.write(row.rendered)
            if unbuffered:
                out.flush()
        out.flush()
    except BrokenPipeError:
        pass
    return written
