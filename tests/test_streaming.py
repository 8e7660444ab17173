import random

from pyspark.sql import functions as F

from skein.operators.keyed import KeyedTable
from skein.streaming import debounce as B
from skein.streaming import upsert as U

SCHEMA = "id long, v string, t long"


def test_stream_keeps_the_latest_row_of_each_key(spark, tmp_path):
    source = tmp_path / "in"
    held = KeyedTable(spark, f"file://{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema, ["id"], "t", folders=8)

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{source}")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{source}")
        U.keep_updated(stream, held, f"file://{tmp_path}/cp", F.col("v") == "gone", 2, {"availableNow": True}).awaitTermination()
        return {r.id: r.v for r in held.read().collect()}

    put([(1, "a", 1), (2, "b", 1), (1, "c", 2)])
    assert run() == {1: "c", 2: "b"}
    put([(2, "d", 5), (3, "e", 1), (1, "old", 0)])
    assert run() == {1: "c", 2: "d", 3: "e"}
    before = held.state()
    assert run() == {1: "c", 2: "d", 3: "e"} and held.state() == before  # nothing new, nothing written
    put([(3, "gone", 2), (2, "gone", 4), (1, "f", 9)])
    assert run() == {1: "f", 2: "d"}  # a deletion that is older than what is held does not count
    put([(3, "back", 3)])
    assert run() == {1: "f", 2: "d", 3: "back"}


def test_streamed_bursts_equal_the_batch_but_for_open_ones(spark, tmp_path):
    rows = [(f"p{i % 5}", 37 * i + (1000 if i % 11 == 0 else 0)) for i in range(200)] + [("end", 10**6)]
    events = spark.createDataFrame(rows, "path string, t long").withColumn("ts", F.timestamp_seconds("t"))
    events.repartition(4).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("path string, t long, ts timestamp").parquet(f"file://{tmp_path}/in")
    q = B.debounce(stream, "path", watermark="1 hour").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in B.debounce(events, "path").filter("path <> 'end'").collect()}
    whole = B.still_open(events, spark.read.parquet(f"file://{tmp_path}/out"), "path")
    assert got | {tuple(r) for r in whole.collect()} == {tuple(r) for r in B.debounce(events, "path").collect()}


def brute_bursts(events, gap):
    """(path, last, n) of (path, second, op, dest)."""
    each = {}
    for path, at, op, dest in events:
        for p, o in ((path, "deleted"), (dest, "created")) if op == "moved" else ((path, op),):
            each.setdefault(p, []).append((at, o != "deleted"))
    out = set()
    for path, rows in each.items():
        last = n = None
        for at, live in [*sorted(rows), (10**9, True)]:
            if last is not None and at - last >= gap:
                if n:
                    out.add((path, last, n))
                last = None
            n = (n + 1 if live else 0) if last is not None else int(live)
            last = at
    return out


def test_cancelled_bursts_of_table_and_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(6)}", rng.randrange(4000), rng.choice(("created", "modified", "modified", "deleted", "moved")), f"p{rng.randrange(6)}") for _ in range(300)]
    rows += [("mid", 10, "created", None), ("mid", 11, "deleted", None), ("mid", 12, "created", None), ("same", 20, "modified", None), ("same", 20, "deleted", None), ("gone", 30, "deleted", None), ("end", 10**6, "created", None)]
    events = spark.createDataFrame(rows, "path string, t long, op string, dest string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want = brute_bursts(rows, 60)
    seconds = lambda df: {(r.path, r.last.timestamp(), r.n) for r in df.collect()}
    assert {("mid", 12, 1), ("same", 20, 1)} <= want and not any(p == "gone" for p, _, _ in want)
    assert seconds(B.debounce_with_cancel(events, seconds=60)) == want
    # Files come in any order within the watermark; several micro-batches.
    for i, part in enumerate(events.randomSplit([1.0] * 4, 3)):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = B.debounce_stream_with_cancel(stream, seconds=60, watermark="20000000 seconds")
    out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 0  # nothing is settled yet
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    out = B.debounce_stream_with_cancel(stream, seconds=60, watermark="5000 seconds")
    out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out2").option("checkpointLocation", f"file://{tmp_path}/cp2").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out2")
    assert seconds(got) == {x for x in want if x[0] != "end"}
    assert seconds(B.still_open_with_cancel(events, got, seconds=60)) == {("end", 10**6, 1)}
