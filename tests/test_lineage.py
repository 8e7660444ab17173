import os

from pyspark.sql import functions as F

from skein import lineage


def test_fixpoint_cycle_and_bound(spark):
    start = spark.range(5).select((F.col("id") * 8).alias("x"))
    halved = lineage.until_stable(start, lambda df: df.select(F.expr("x div 2").alias("x")).distinct(), "t")
    assert [r.x for r in halved.collect()] == [0]
    flip = lineage.until_stable(spark.range(3).select(F.col("id").alias("x")), lambda df: df.select((2 - F.col("x")).alias("x")), "t")
    assert sorted(r.x for r in flip.collect()) == [0, 1, 2]
    grown = lineage.until_stable(spark.range(1).select(F.lit(0).alias("x")), lambda df: df.select((F.col("x") + 1).alias("x")), "t", max_rounds=4)
    assert grown.first().x == 4


def test_superseded_tables_are_deleted(spark):
    folder = lineage.shared_dir(spark).removeprefix("file://")
    before = {f for f in os.listdir(folder) if f.startswith("gone-")}
    lineage.until_stable(spark.range(4).select(F.col("id").alias("x")), lambda df: df.select(F.expr("x div 2").alias("x")), "gone")
    assert len({f for f in os.listdir(folder) if f.startswith("gone-")} - before) == 1


def test_components_of_a_long_path_a_star_and_nothing(spark, monkeypatch):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(200)]
    df = spark.createDataFrame([*path, *star, (7, 7), (999, 999)], "a long, b long")
    for held in (1 << 18, 1):  # whole partitions thinned out, and hardly any
        monkeypatch.setattr(lineage, "HELD_VERTICES", held)
        found = {r.v: r.root for r in lineage.components(df.repartition(5)).collect()}
        assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(201)}
    assert lineage.components(df.limit(0)).count() == 0
    text = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert {r.v: r.root for r in lineage.components(text).collect()} == {"a": "a", "b": "a", "c": "a"}


def test_components_of_structs_order_nulls_first(spark):
    df = spark.sql("select named_struct('x', 2L, 'y', 5L) a, named_struct('x', 2L, 'y', cast(null as bigint)) b union all select named_struct('x', 1L, 'y', 9L), named_struct('x', 2L, 'y', 5L)")
    assert {(r.v.x, r.v.y): (r.root.x, r.root.y) for r in lineage.components(df).collect()} == {(1, 9): (1, 9), (2, 5): (1, 9), (2, None): (1, 9)}


def test_fresh_names_and_scratch_tables(spark):
    df = spark.createDataFrame([(1, 2, 3)], "__id int, __ID2 int, x int")
    assert lineage.fresh(df, "id", "other") == ["___id", "___other"] and lineage.fresh(df, "x") == ["__x"]
    scratch = lineage.Scratch(spark)
    kept = scratch.keep("mine", df)
    path = scratch.tables["mine"].removeprefix("file://")
    assert kept.count() == 1 and os.path.isdir(path)
    scratch.drop("mine")
    assert not os.path.exists(path) and not scratch.tables
