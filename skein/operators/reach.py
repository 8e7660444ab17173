"""Reachability of all nodes at once: strongly connected components shrink to one node each, and what a component reaches
travels up the remaining acyclic graph as words of 64 bits, level by level from the sinks.

A row (component, word) stands for up to 64 components; words that nothing of is reached have no row. No pair of nodes
is built, but bits of k components take k * k / 64 words in the worst case. A level is a join and a shuffle, and there
are as many of them as the longest path of the acyclic graph has steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import materialise, written


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a number from 0 on, without gaps: places within partitions, moved by the sizes of those before."""
    placed = materialise(rows.withColumn(name, F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright(F.col(name), 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg((F.max(place) + 1).alias("n"))  # a row a partition
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn(name, place + F.col("before")).drop("part", "before")


def condensed(pairs: DataFrame, strong: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (id, c, size), edges (src, dst) between components): ``strong`` (id, component) of two nodes or more;
    every other node is a component of its own."""
    every = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    owner = every.join(strong, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    parts = numbered(owner.groupBy("component").agg(F.count("*").alias("size")), "c")
    members = materialise(owner.join(parts, "component").select("id", "c", "size"), "members")
    a, b = members.select(F.col("id").alias("src"), F.col("c").alias("c1")), members.select(F.col("id").alias("dst"), F.col("c").alias("c2"))
    return members, materialise(pairs.join(a, "src").join(b, "dst").filter("c1 <> c2").select(F.col("c1").alias("src"), F.col("c2").alias("dst")).distinct(), "condensed")


def bits(dag: DataFrame, parts: DataFrame) -> DataFrame:
    """(c, word, bits): the components that each of ``parts`` (c) reaches in ``dag`` (src, dst), itself included."""
    own = F.expr("shiftleft(1L, cast(c % 64 as int))")
    left, (n, _), _ = written(dag, "dag")
    todo, (rest, _), _ = written(parts.select("c"), "todo")
    done = None
    while rest:
        # Components none of whose successors is open; what they reach is known by then.
        ready = todo.join(left.select(F.col("src").alias("c")).distinct(), "c", "left_anti")
        rows = ready.select("c", F.expr("c div 64").alias("word"), own.alias("bits"))
        if done is not None:
            up = dag.join(ready.select(F.col("c").alias("src")), "src", "left_semi").join(done.select(F.col("c").alias("dst"), "word", "bits"), "dst")
            rows = rows.unionByName(up.select(F.col("src").alias("c"), "word", "bits")).groupBy("c", "word").agg(F.bit_or("bits").alias("bits"))
        rows = materialise(rows, "bits")
        done = rows if done is None else done.unionByName(rows)
        ids = rows.select("c").distinct()
        todo, (rest, _), _ = written(todo.join(ids, "c", "left_anti"), "todo")
        left, (n, _), _ = written(left.join(ids.withColumnRenamed("c", "dst"), "dst", "left_anti"), "dag")
    return done if done is not None else parts.select("c", F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("bits"))


def reached(pairs: DataFrame, strong: DataFrame) -> DataFrame:
    """(root, others, component_size): how many other nodes each node reaches along ``pairs``."""
    members, dag = condensed(pairs, strong)
    parts = members.select("c", "size").distinct()
    words = materialise(bits(dag, parts), "reach")
    # Every bit counts one node; components of more nodes add the rest where their bit is set.
    more = parts.filter("size > 1").select(F.expr("c div 64").alias("word"), F.expr("shiftleft(1L, cast(c % 64 as int))").alias("mask"), (F.col("size") - 1).alias("extra"))
    ones = words.select("c", F.bit_count("bits").cast("long").alias("n"))
    extra = words.join(more, "word").filter(F.col("bits").bitwiseAND(F.col("mask")) != 0).select("c", F.col("extra").alias("n"))
    total = ones.unionByName(extra).groupBy("c").agg(F.sum("n").alias("n"))
    return members.join(total, "c").select(F.col("id").alias("root"), (F.col("n") - 1).alias("others"), F.col("size").alias("component_size"))
