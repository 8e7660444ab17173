"""Keyed tables against a Python dictionary; what a batch writes and a refresh parses."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import keyed, refresh

KIND = "id long, v string, t long"


def table(spark, tmp_path, **more):
    return keyed.KeyedTable(spark, f"file://{tmp_path}/table", spark.createDataFrame([], KIND).schema, ["id"], **more)


def test_batches_replays_and_compaction(spark, tmp_path):
    rng, held, t = random.Random(4), {}, table(spark, tmp_path, recency="t", folders=16)
    for batch in range(6):
        rows = [(rng.randrange(40) or None, rng.choice(("a", "b", "gone")), rng.randrange(20)) for _ in range(25)]
        for key, v, at in rows:
            old = held.get(key)
            rank = (at, batch, v != "gone")
            if old is None or rank > old[0] or (rank == old[0] and v > old[1]):
                held[key] = (rank, v)
        # Of equal rows of one batch the struct does not decide: make them alike.
        rows = [(k, held[k][1] if held[k][0] == (at, batch, v != "gone") else v, at) for k, v, at in rows]
        t.merge(spark.createDataFrame(rows, KIND), F.col("v") == "gone", batch, "s")
        state = t.state()
        t.merge(spark.createDataFrame([(1, "again", 99)], KIND), None, batch, "s")
        assert t.state() == state  # a replay
        want = {k: v for k, (_, v) in held.items() if v != "gone"}
        assert {r.id: r.v for r in t.read().collect()} == want
        if batch == 3:
            t.compact(1)
            assert all(len(d) == 1 for d in t.state()["folders"].values())
            assert {r.id: r.v for r in t.read().collect()} == want
    assert {r.id: r.v for r in t.lookup((1,), (2,), (None,)).collect()} == {k: v for k, v in want.items() if k in (1, 2, None)}
    old = {r.id: r.v for r in t.read(2).collect()}
    assert old and t.vacuum() > 0 and len(t.versions()) == 1
    assert {r.id: r.v for r in t.read().collect()} == want


def test_a_batch_writes_the_folders_of_its_keys(spark, tmp_path):
    t = table(spark, tmp_path, folders=64)
    t.merge(spark.range(5000).selectExpr("id", "'x' AS v", "0L AS t"))
    assert len(t.state()["touched"]) == 64
    new = t.merge(spark.createDataFrame([(17, "y", 1), (18, "y", 1)], KIND))
    assert len(new["touched"]) <= 2 and t.changed().count() == 2
    assert t.read().filter("v = 'y'").count() == 2 and t.read().count() == 5000
    assert t.lookup((17,)).first().v == "y" and t.lookup((5001,)).count() == 0
    assert t.merge(spark.createDataFrame([], KIND))["touched"] == [] and t.read().count() == 5000


def test_an_empty_table_and_a_lost_commit(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == t.vacuum() == 0 and t.versions() == [] and t.compact()["version"] == 0
    t._write(spark.createDataFrame([(1, "never", 0)], KIND).withColumns({keyed.GONE: F.lit(False), keyed.VERSION: F.lit(1)}), "delta-0000000001-lost")
    t.merge(spark.createDataFrame([(2, "b", 0)], KIND))
    assert [tuple(r) for r in t.read().collect()] == [(2, "b", 0)]  # a delta that no version names is not read
    with pytest.raises(RuntimeError):
        t._commit(t.state())


def test_a_refresh_parses_changed_texts_alone(spark, tmp_path):
    old = spark.createDataFrame([(i, f"alpha name{i}") for i in range(300)], "id long, text string")
    new = old.filter("id <> 7").withColumn("text", F.when(F.col("id") < 3, "beta").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(900, "gamma alpha"), (901, None)], "id long, text string"))
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/index", refresh.index_schema(old), ["id"])
    got = {r.layer: r.n for r in refresh.reindex(t, old, new).collect()}
    assert got["parsed"] == 5 and got["files"] == 301
    assert got["symbols"] == 296 * 2 + 3 + 2
    assert len(t.state()["touched"]) <= 6
    parsed = refresh.refresh_table(t, new)
    assert parsed.filter("status <> 'unchanged'").count() == 0 and t.changed().count() == 0


def test_reads_and_merges_move_only_what_they_need(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], KIND))
    t.merge(spark.createDataFrame([(1, "c", 0), (2, None, 0)], KIND), gone=F.col("v").isNull())
    keys = t.read(columns=["id"])
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in keys.collect()] == [(1,)] and "ReadSchema" in plan and "v:string" not in plan
    assert [tuple(r) for r in t.read(1, ["v"]).sort("v").collect()] == [("a",), ("b",)]
    changes = t._placed(t.read().withColumn(keyed.GONE, F.lit(False)))
    merged = t._latest(changes, ~F.col(keyed.GONE), keyed.FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert merged.count(f"Exchange hashpartitioning({keyed.FOLDER}#") == merged.count("Exchange hashpartitioning(") - 1 == 1  # the other one is that of ``read``
