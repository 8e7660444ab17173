"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of ``BLOCK`` documents. In a schedule of one block a slot,
block ``i`` of a source of weight ``w`` is released at slot ``floor(i / w)`` and due by ``ceil((i + 1) / w)``;
of the released blocks the one due first takes the slot. On one processor that meets every deadline,
so each source stays less than one block from its share at every slot.

Weights are taken as exact fractions. The driver plans the slot of each block from counts alone: it holds one entry a
source, and writes the plan to the shared folder in parts of ``PLAN_ROWS`` slots; the plan is joined as a table. When a source runs out, the weights of those left are
scaled up and a new phase begins, so no document is dropped or repeated; sources of weight zero come after
all others. Within a source the order is that of a hash of the key; ranks
come from counts of hash buckets of about ``BUCKET_ROWS`` rows of all sources, so a source of any size is never
gathered in one task.

Defined results: a null source is a source of its own; a source without a target weight gets the
``default`` weight; repeated rows take one place each; the last block of a source may be short; an
empty table gives an empty table; other columns are ignored (``mix`` keeps them).
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, shared_dir

BLOCK = 64
#: Without target weights, a source of n documents weighs n to this power.
TEMPERATURE = 0.7
#: Documents that a hash bucket holds, about, of all sources together.
BUCKET_ROWS = 512
#: Buckets whose counts one task adds up; slots of the plan that the driver holds before it writes them.
RUN, PLAN_ROWS = 4096, 1 << 20


def in_slots(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int]]:
    """(source, block) of slot after slot, by the exact weights. Held are one release and at most one released block of
    each source."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    exact = {s: Fraction(weights[s]) for s in left}
    scale = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    while left:
        share = {s: whole[s] for s in left if whole[s] > 0} or dict.fromkeys(left, 1)
        total, slot = sum(share.values()), 0
        waiting = [(0, s, 0) for s in share]
        heapq.heapify(waiting)
        ready: list[tuple[int, str, int]] = []
        while True:
            while waiting and waiting[0][0] <= slot:
                _, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-((i + 1) * total // -share[s]), s, i))
            due, s, i = heapq.heappop(ready)
            if slot >= due:
                raise AssertionError("a deadline was missed")
            yield s, done[s]
            done[s] += 1
            slot += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
            heapq.heappush(waiting, ((i + 1) * total // share[s], s, i + 1))


def plan(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, float], rows: int = PLAN_ROWS) -> DataFrame:
    """(s, block, slot): the schedule as a table of the shared folder, written part by part."""
    path, slots, at = f"{shared_dir(spark)}/plan-{uuid.uuid4().hex}", in_slots(blocks, weights), 0
    while part := list(islice(slots, rows)):
        columns = {"s": pa.array([s for s, _ in part], pa.string()), "block": pa.array([b for _, b in part], pa.int64()), "slot": pa.array(range(at, at + len(part)), pa.int64())}
        spark.createDataFrame(pa.table(columns)).write.mode("append").parquet(path)
        at += len(part)
    return spark.read.schema("s string, block long, slot long").parquet(path) if at else spark.createDataFrame([], "s string, block long, slot long")


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, default: float | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, source, block, slot, position) of every row; ``position`` orders the mixed corpus."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("s"), F.xxhash64(key).alias("h"))
    sizes = {r.s: r.n for r in rows.groupBy("s").agg(F.count("*").alias("n")).collect()}
    weigh = {s: n**TEMPERATURE for s, n in sizes.items()}
    if weights is not None:
        low = default if default is not None else min([w for w in weights.values() if w > 0], default=1.0)
        weigh = {s: weights.get(s[1:], low) if s else low for s in sizes}
    buckets = max(1, sum(sizes.values()) // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = rows.groupBy("s", "bucket").agg(F.count("*").alias("n"))
    # Sums of runs of buckets first, so that no task has all buckets of a hot source.
    runs = counts.groupBy("s", F.expr(f"bucket div {RUN}").alias("run")).agg(F.sum("n").alias("n"))
    earlier = lambda by, at: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("s", "run", earlier(["s"], "run").alias("base"))
    before = counts.withColumn("run", F.expr(f"bucket div {RUN}")).withColumn("inner", earlier(["s", "run"], "bucket")).join(runs, ["s", "run"]).select("s", "bucket", (F.col("base") + F.col("inner")).alias("before"))
    ranked = rows.withColumn("i", F.row_number().over(W.partitionBy("s", "bucket").orderBy("h", "key")) - 1).join(before, ["s", "bucket"])
    ranked = ranked.withColumn("rank", F.col("i") + F.col("before")).withColumn("block", F.expr(f"rank div {block}"))
    placed = ranked.join(plan(spark, {s: -(-n // block) for s, n in sizes.items()}, weigh), ["s", "block"])
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), "block", "slot", (F.col("slot") * block + F.col("rank") % block).alias("position"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` in mixed order: range partitions by position, sorted within; rows and columns stay.

    Rows with equal keys share the places of their key, in any order.
    """
    own, place = fresh(docs, "key", "position")
    places = schedule(docs, weights, block, key=key, source=source).groupBy(F.col(key).alias(own)).agg(F.min("position").alias(place))
    out = docs.join(places, F.col(key).eqNullSafe(F.col(own)))
    return out.repartitionByRange(place).sortWithinPartitions(place).select(*docs.columns)
