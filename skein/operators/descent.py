"""An approximate graph of nearest neighbours by descent: neighbours of neighbours are likely neighbours.

Every vector starts with its best among those on the same sides of some planes, in cells of ``CELL`` that are dealt out
several ways. In each round a vector's list and the lists that name it come together, those that are new there are compared
with all others in one small product, and every one of them keeps its best. A list has ``K + EXTRA`` places and takes
``REVERSE`` of those that name it, new ones first, by hash, so a group is bounded whatever vector is popular; this bounds what
a round looks at, not who can become a neighbour. Vectors travel as they are stored, with the similarity that a pair must
reach to enter their list; lists in which nothing is new stay at home. Rounds end when few places change.

Defined results: vectors that are not usable (null, zero, odd components) have no neighbours; ids must be unique; fewer
vectors than places give all others; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import materialise, written
from .lists import usable

EXTRA, REVERSE, ROUNDS, FEW, DEALS, CELL = 10, 16, 12, 0.002, 6, 256
LIST = "id long, neighbor long, similarity double"


def units(x: pa.ListArray, n: pa.Array) -> np.ndarray:
    length = np.asarray(n)
    return np.asarray(x.flatten(), np.float64).reshape(len(length), -1) / length[:, None]


def pairs_of(ids: np.ndarray, sim: np.ndarray, places: int) -> Iterator[pa.RecordBatch]:
    """Of each row of similarities its best; what is not to be compared is minus infinity."""
    top = min(places, len(ids) - 1)
    order = np.argpartition(-sim, top - 1, axis=1)[:, :top]
    kept = np.take_along_axis(sim, order, 1)
    use = kept.ravel() > -np.inf
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top)[use]), pa.array(ids[order].ravel()[use]), pa.array(kept.ravel()[use])], names=["id", "neighbor", "similarity"])


def nearest(vectors: DataFrame, k: int, key: str = "id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """(id, neighbor, rank, similarity): about the ``k`` most similar other vectors of each."""
    rows = materialise(usable(vectors, key, vector, raw=True), "vectors")
    n, places = rows.count(), k + EXTRA
    kind = rows.schema["x"].dataType.simpleString()
    bits = max(0, int(np.ceil(np.log2(max(1, n / CELL)))))
    best = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbor"))).filter(F.col("rank") <= places)

    def sided(deal: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = units(batch.column(1), batch.column(2))
                along = v @ np.random.default_rng((seed, deal)).normal(size=(v.shape[1], bits + 1))
                cell = (along[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(along[:, bits])], names=["id", "x", "n", "cell", "along"])

        return run

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in np.array_split(np.arange(batch.num_rows), max(1, round(batch.num_rows / CELL))):
                if len(at) < 2:
                    continue
                part = batch.slice(int(at[0]), len(at))
                v = units(part.column(1), part.column(2))
                sim = np.round(v @ v.T, 9)
                np.fill_diagonal(sim, -np.inf)
                yield from pairs_of(np.asarray(part.column(0)), sim, places)

    start = None
    for deal in range(DEALS if n > CELL else 1):
        celled = rows.mapInArrow(sided(deal), f"id long, x {kind}, n double, cell long, along double")
        celled = celled.repartitionByRange(max(1, n // (16 * CELL)), "cell", "along", "id").sortWithinPartitions("cell", "along", "id")
        one = celled.select("id", "x", "n").mapInArrow(in_cells, LIST)
        start = one if start is None else start.unionByName(one)
    now, (count, _), _ = written(best(start.groupBy("id", "neighbor").agg(F.max("similarity").alias("similarity"))).select("id", "neighbor", "similarity", F.lit(True).alias("new")), "lists")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                held = group.values
                ids, new = np.asarray(held.field("id")), held.field("new").to_numpy(zero_copy_only=False)
                if len(ids) < 2:
                    continue
                v = units(held.field("x"), held.field("n"))
                sim = np.round(v @ v.T, 9)
                sim[(sim < np.asarray(held.field("worst"))[:, None]) | ~(new[:, None] | new)] = -np.inf
                np.fill_diagonal(sim, -np.inf)
                yield from pairs_of(ids, sim, places)

    for at in range(ROUNDS):
        worst = now.groupBy("id").agg(F.when(F.count("*") >= places, F.min("similarity")).otherwise(-2.0).alias("worst"))
        told = rows.join(worst, "id", "left").select(F.col("id").alias("neighbor"), "x", "n", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
        back = now.select(F.col("neighbor").alias("id"), F.col("id").alias("neighbor"), "new")
        back = back.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("new"), F.xxhash64("neighbor", F.lit(at)), "neighbor"))).filter(F.col("place") <= REVERSE).drop("place")
        group = now.select("id", "neighbor", "new").unionByName(back).unionByName(rows.select("id", F.col("id").alias("neighbor"), F.lit(False).alias("new")))
        group = group.groupBy("id", "neighbor").agg(F.max("new").alias("new")).withColumn("live", F.max("new").over(W.partitionBy("id"))).filter("live").drop("live")
        met = group.join(told, "neighbor").groupBy("id").agg(F.collect_list(F.struct(F.col("neighbor").alias("id"), "x", "n", "worst", "new")).alias("held"))
        found = met.select("held").mapInArrow(joined, LIST).withColumn("new", F.lit(True))
        both = found.unionByName(now.select("id", "neighbor", "similarity", F.lit(False).alias("new"))).groupBy("id", "neighbor").agg(F.max("similarity").alias("similarity"), F.min("new").alias("new"))
        now, (count, _), _ = written(best(both).drop("rank"), "lists")
        if now.filter("new").count() <= FEW * count:
            break
    return best(now).filter(F.col("rank") <= k).select("id", "neighbor", "rank", "similarity")
