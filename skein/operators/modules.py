"""Modules of a source tree: what imports mean, and the graph that imports, containment and directories make together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

IMPORT, FUZZY, CONTAINED, NEAR = 1.0, 0.3, 0.3, 0.15


def suffixes(dotted: str) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def longest_suffix(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, name, target, matched) of imports (src, name): the module (id) that shares the longest dotted suffix with the
    name, of equals the smallest. Suffixes of both meet by equality; no module is compared with all imports."""
    one = imports.select("src", "name", F.explode(suffixes("name")).alias("suffix")).distinct()
    two = modules.select(F.col("id").alias("target"), F.explode(suffixes("id")).alias("suffix")).distinct()
    # The best owner of a suffix is known before imports meet it: the smallest module.
    owner = two.groupBy("suffix").agg(F.min("target").alias("target"))
    parts = F.size(F.split("suffix", r"\."))
    return one.join(owner, "suffix").groupBy("src", "name").agg(F.max_by("target", parts).alias("target"), F.max(parts).cast("long").alias("matched"))


def import_edges(imports: DataFrame, modules: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, w) of imports (src, name): the module that the first part of the name is, in full weight; else every
    module below it, in a fraction, unless it is one of the names ``known`` from elsewhere."""
    top = F.substring_index("name", ".", 1)
    one = imports.select("src", top.alias("top"))
    exact = one.join(modules.select(F.col("id").alias("top")), "top", "left_semi").select("src", F.col("top").alias("dst"), F.lit(IMPORT).alias("w"))
    rest = one.join(modules.select(F.col("id").alias("top")), "top", "left_anti").filter(~F.col("top").isin(*known) if known else F.lit(True))
    below = modules.select(F.explode(S.module_prefixes(F.col("id"))).alias("top"), F.col("id").alias("dst")).filter("top <> dst")
    return exact.unionByName(rest.join(below, "top").select("src", "dst", F.lit(FUZZY).alias("w")))


def fused_graph(imports: DataFrame, modules: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, w), symmetric: imports (src, name) among modules (id), modules and the one that contains them, modules
    of one parent; weights of a pair add up."""
    parent = F.regexp_replace("id", r"\.?[^.]*$", "")
    placed = modules.select("id", parent.alias("parent"))
    contained = placed.join(modules.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit(2 * CONTAINED).alias("w"))
    near = placed.select("parent", F.col("id").alias("src")).join(placed.select("parent", F.col("id").alias("dst")), "parent").filter("src < dst").select("src", "dst", F.lit(2 * NEAR).alias("w"))
    every = import_edges(imports, modules, known).filter("src <> dst").unionByName(contained).unionByName(near)
    # Both directions of a pair weigh the same: added up once, then told to either end.
    one = every.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return one.select(ends.alias("e"), "w").select("e.src", "e.dst", "w")
