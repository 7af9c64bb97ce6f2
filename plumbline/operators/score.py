"""The surface for pluggable models: whatever scores a batch of rows, loaded once in every worker process."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame


@lru_cache(maxsize=4)
def _loaded(load: Callable):
    return load()


def scored(rows: DataFrame, load: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """What a model makes of ``rows``: ``load()`` gives a function from batches to batches of ``schema``.

    ``load`` runs on the workers, once in a process, so weights never pass the driver; batches are Arrow's, so a
    process holds one at a time. A model may return more or fewer rows than it gets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(load)
        for batch in batches:
            yield model(batch)

    return rows.mapInArrow(run, schema)
