"""Debounced change events: a path is handed on once it has been quiet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GAP = "5 minutes"


def debounce(events: DataFrame, key: str, ts: str = "ts", gap: str = GAP, watermark: str | None = None) -> DataFrame:
    """(key, first, last, n): bursts of events of a key that lie less than ``gap`` apart.

    Works on tables and on streams; a stream needs a watermark, past which late events are dropped.
    """
    if watermark:
        events = events.withWatermark(ts, watermark)
    burst = F.session_window(ts, gap)
    return events.groupBy(key, burst.alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).select(key, "first", "last", "n")


def still_open(events: DataFrame, emitted: DataFrame, key: str, ts: str = "ts", gap: str = GAP) -> DataFrame:
    """The bursts of a table of events that a stream over it has not emitted when it ends: of each key, those after its
    last emitted one."""
    last = emitted.groupBy(key).agg(F.max("last").alias("last"))
    rest = events.join(last, key, "left").filter(F.col("last").isNull() | (F.col(ts) > F.col("last"))).drop("last")
    return debounce(rest, key, ts, gap)


def moves_apart(events: DataFrame, key: str, ts: str, op: str) -> DataFrame:
    """(key, ts, op): a move is a deletion of the old path and a creation of the new one (column ``dest``)."""
    both = F.when(F.col(op) == "moved", F.array(F.struct(F.col(key).alias("k"), F.lit("deleted").alias("o")), F.struct(F.col("dest").alias("k"), F.lit("created").alias("o"))))
    each = F.explode(F.coalesce(both, F.array(F.struct(F.col(key).alias("k"), F.col(op).alias("o")))))
    return events.select(ts, each.alias("x")).select(F.col("x.k").alias(key), ts, F.col("x.o").alias(op))


def _order(op: str) -> Column:
    """Of events of one time a deletion comes first."""
    return F.when(F.col(op) == "deleted", 0).otherwise(1)


def debounce_with_cancel(events: DataFrame, key: str = "path", ts: str = "ts", op: str = "op", seconds: int = 300) -> DataFrame:
    """(key, last, n): bursts of events of a key that lie less than ``seconds`` apart, with the number of events since the
    last deletion in the burst; bursts that end in a deletion are dropped.

    Moves count as a deletion of the old path and a creation of the new one (column ``dest``). Of events of one time a
    deletion comes first. Events without a key or a time are left out.
    """
    each = moves_apart(events, key, ts, op).filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    w = W.partitionBy(key).orderBy(ts, _order(op))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = (micros - F.lag(micros).over(w) >= seconds * 1_000_000) | F.lag(micros).over(w).isNull()
    numbered = each.withColumn("burst", F.sum(fresh.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    deleted = F.max(F.when(F.col(op) == "deleted", F.col(ts)))
    ends = numbered.groupBy(key, "burst").agg(F.max(ts).alias("last"), deleted.alias("gone"))
    live = numbered.join(ends, [key, "burst"]).filter(F.col("gone").isNull() | (F.col(ts) > F.col("gone")) | ((F.col(ts) == F.col("gone")) & (F.col(op) != "deleted")))
    return live.groupBy(key, "burst").agg(F.first("last").alias("last"), F.count("*").alias("n")).select(key, "last", "n")


#: Keys are dealt into so many states: what a state costs besides its events is paid once for all keys in it, and each holds
#: the open events of one in ``STATES`` keys. A stream that stands keeps its number.
STATES = 4096


class Bursts(StatefulProcessor):
    """The open events of the paths that one state holds, as one Arrow table. A timer at the first time at which a burst has
    been quiet for the gap closes it: the watermark has passed it, so no event that could fall in between can come any more."""

    def __init__(self, seconds: int) -> None:
        self.gap = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "events binary")

    def _open(self) -> list[pa.Table]:
        return [pa.ipc.open_stream(self.held.get()[0]).read_all()] if self.held.exists() else []

    def _bursts(self, held: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """(the events by path and time, the first place of each burst, the time at which it closes); of events of one time a
        deletion comes first."""
        at, gone = held.column("at").to_numpy(), held.column("deleted").to_numpy(zero_copy_only=False)
        path = held.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((~gone, at, path))
        path, at = path[order], at[order]
        begin = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (at[1:] - at[:-1] >= self.gap)))
        return held.take(pa.array(order)), begin, at[np.append(begin[1:], len(at)) - 1] + self.gap

    def _keep(self, held: pa.Table, closes: np.ndarray) -> None:
        """Hold these events, with one timer at the first closing."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not held.num_rows:
            self.held.clear()
            return
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held.schema) as stream:
            stream.write_table(held.combine_chunks())
        self.held.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(-(-int(closes.min()) // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = self._open() + [pa.Table.from_pandas(part[["key", "at", "deleted"]], preserve_index=False).replace_schema_metadata() for part in rows]
        held, _, closes = self._bursts(pa.concat_tables([p for p in parts if p.num_rows]))
        self._keep(held, closes)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        found = self._open()
        if not found:
            return
        held, begin, closes = self._bursts(found[0])
        done = closes <= timerValues.getCurrentWatermarkInMs() * 1000
        size = np.diff(np.append(begin, held.num_rows))
        place = np.arange(held.num_rows)
        last = np.maximum.reduceat(np.where(held.column("deleted").to_numpy(zero_copy_only=False), place, -1), begin)
        n = begin + size - np.maximum(last + 1, begin)  # the events behind the last deletion
        out = np.flatnonzero(done & (n > 0))
        self._keep(held.filter(pa.array(np.repeat(~done, size))), closes[~done])
        if len(out):
            yield pd.DataFrame({"key": held.column("key").take(pa.array(begin[out])).to_pandas(), "last": closes[out] - self.gap, "n": n[out]})

    def close(self) -> None:
        pass


def debounce_stream_with_cancel(events: DataFrame, key: str = "path", ts: str = "ts", op: str = "op", seconds: int = 300, watermark: str = "10 minutes") -> DataFrame:
    """The stream form of ``debounce_with_cancel``, on event time: a burst is handed on, once, when the watermark says that
    its path has been quiet, in whatever order its events came. Events later than the watermark are dropped; state holds
    open bursts only, of many paths together. Needs the RocksDB state store."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema}[key]
    each = moves_apart(events, key, ts, op).filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, watermark)
    rows = each.select(F.pmod(F.xxhash64(key), F.lit(STATES)).cast("int").alias("state"), F.col(key).alias("key"), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), (F.col(op) == "deleted").alias("deleted"))
    out = rows.groupBy("state").transformWithStateInPandas(Bursts(seconds), f"key {kind}, last long, n long", "append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("last").alias("last"), "n")


def still_open_with_cancel(events: DataFrame, emitted: DataFrame, key: str = "path", ts: str = "ts", op: str = "op", seconds: int = 300) -> DataFrame:
    """The bursts of a table of events that a stream over it has not emitted when its input ends."""
    return debounce_with_cancel(events, key, ts, op, seconds).join(emitted.select(key, "last"), [key, "last"], "left_anti")


def filtered(events: DataFrame, extensions: tuple[str, ...], exclude: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """Events of paths with an allowed extension that match no excluded shell pattern."""
    from ..functions.scalars import glob_regex

    keep = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)).isin(*extensions)
    for pattern in exclude:
        keep = keep & ~F.col(path).rlike(glob_regex(pattern))
    return events.filter(keep)


def for_each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that hands each micro-batch to ``sink``, once per batch id."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
