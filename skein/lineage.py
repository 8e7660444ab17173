"""Cutting lineage in iterative plans, by tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and all of Spark is one process,
    as in tests: elsewhere executors would each write to a folder that the others do not see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="skein-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that nothing reads any more, on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one computation in the shared folder, under names of its own."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, {}

    def keep(self, label: str, df: DataFrame) -> DataFrame:
        """``df`` written and read back."""
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.tables[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete tables whose readers have all been written in turn."""
        for label in labels:
            discard(self.spark, self.tables.pop(label))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until no column of ``df`` has one of them, whatever its case."""
    taken = {c.lower() for c in df.columns}
    front = "__"
    while any((front + n).lower() in taken for n in names):
        front += "_"
    return [front + n for n in names]


def written(df: DataFrame, label: str) -> tuple[DataFrame, tuple, str]:
    """(``df`` written and read back, (rows, order-free hash of them), its path). The state is observed while the
    table is written; it costs no job of its own."""
    spark, watch = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), (watch.get["n"], watch.get["h"]), path


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], label: str, max_rounds: int | None = None) -> DataFrame:
    """Apply ``step`` until a state has been seen before (by an order-free hash of its rows) or rounds end.

    Seeing an older state again ends a cycle as well as a fixpoint.
    """
    spark = start.sparkSession
    now, state, path = written(start, label)
    seen, rounds = set(), 0
    while state not in seen and (max_rounds is None or rounds < max_rounds):
        seen.add(state)
        old = path
        now, state, path = written(step(now), label)
        discard(spark, old)  # the new state has been written from it
        rounds += 1
    return now


#: Vertices that a task holds at once while it joins the edges that it has.
HELD_VERTICES = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): edges that join what the edges (u, v) of a task join, at most one a vertex for every ``HELD_VERTICES``."""
    kind, root, value = None, {}, {}
    bare = lambda x: tuple((y is not None, y) for y in x.values()) if isinstance(x, dict) else x  # noqa: E731  the order of Spark's structs: nulls first

    def find(x: Any) -> Any:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def left() -> Iterator[pa.RecordBatch]:
        out = [x for x in root if find(x) != x]
        for at in range(0, len(out), 100_000):
            part = out[at : at + 100_000]
            columns = [[value.get(x, x) for x in part], [value.get(x, x) for x in map(find, part)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in columns], names=["u", "v"])
        root.clear()
        value.clear()

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = bare(a), bare(b)
            if isinstance(a, dict):
                value[x], value[y] = a, b
            x, y = find(root.setdefault(x, x)), find(root.setdefault(y, y))
            root[max(x, y)] = min(x, y)
        if len(root) > HELD_VERTICES:
            yield from left()
    if root:
        yield from left()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of each connected component, for every vertex of ``edges`` (a, b).

    Every task first thins out the edges that it has to a forest. Then two steps alternate until nothing changes: every
    vertex hands the smallest of its neighbours to the larger ones, then to the smaller ones. Both keep components whole,
    and halve distances, so rounds grow as a logarithm. Vertices may have any ordered type.
    """

    def step(now: DataFrame) -> DataFrame:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return small.filter("u <> v").distinct()

    start = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    kind = start.schema["u"].dataType.simpleString()
    now = until_stable(start.mapInArrow(_forest, f"u {kind}, v {kind}").distinct(), step, "edges")
    found = now.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("v"), "root").distinct())
