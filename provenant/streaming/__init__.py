"""Tags on Structured Streaming queries.

The walker treats a streaming plan like any other: tags are columns and mergeable
aggregates, so watermarks, windows and state work as without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lattice import BOOL_OR, Lattice
from ..plans.walker import track


def windowed(
    events: DataFrame, time: str, value: str, watermark: str = "1 hour", size: str = "1 day", slide: str | None = None, keys: tuple[str, ...] = (),
    session: bool = False,
) -> DataFrame:
    """Sum and count of a value in windows of event time, with late data up to `watermark`.

    Tumbling windows of `size`, sliding ones if `slide` is given, or sessions that end after a gap of `size`.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    window = F.session_window(time, size).alias("window") if session else F.window(time, size, slide).alias("window")
    return (
        timed.groupBy(window, *keys)
        .agg(F.sum(value).alias("total"), F.count(value).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "total", "n")
    )


def write_tracked(
    stream: DataFrame, sink: str, checkpoint: str | None = None, mode: str = "append", lattice: Lattice = BOOL_OR, available_now: bool = True, **options
) -> StreamingQuery:
    """Start a streaming query of values beside their tags."""
    writer = track(stream, lattice, coarse=False).to_flat().writeStream.format(sink).outputMode(mode).options(**options)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
