"""Cell statistics of a stream of points; at the end of input they equal the batch operator's."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators.cells import TreeFilter, cell_histogram


def stream_cell_histogram(points: DataFrame, knobs: TreeFilter, name: str, checkpoint: str | None = None):
    """Starts a query over a streaming ``points`` whose table ``name`` always holds the whole histogram."""
    writer = cell_histogram(points, knobs).writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
