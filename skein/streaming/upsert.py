"""A keyed table kept up to date by a stream: each micro-batch writes a delta of the folders that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators.keyed import KeyedTable
from .debounce import for_each_batch


def keep_updated(stream: DataFrame, table: KeyedTable, checkpoint: str, gone: Column | None = None, compact: int = 8, trigger: dict | None = None):
    """Start a query that merges each micro-batch into ``table``: the latest row of each key; where ``gone`` holds, the
    key is deleted. A batch that is repeated after a failure changes nothing. Folders of more than ``compact`` deltas are
    written anew.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, gone, batch_id, "stream")
        table.compact(compact)

    return for_each_batch(stream, merge, checkpoint, trigger)
