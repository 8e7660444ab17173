"""Incremental maintenance: keyed differences, upserts, cascades and hash skips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, removed, modified or unchanged, from one full outer join on the keys."""
    a = old.select(*keys, *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("in_old"))
    b = new.select(*keys, *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("in_new"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """The latest row of each key; of equal recency the update wins."""
    both = base.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    order = W.partitionBy(*keys).orderBy(F.desc(recency), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__new", "__rn")


def cascade(removed: DataFrame, dependents: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Each dependent relation without the rows whose reference columns name a removed id."""
    out = {}
    for name, (df, columns) in dependents.items():
        for c in columns:
            df = df.join(removed.select(F.col("id").alias(c)).distinct(), c, "left_anti")
        out[name] = df
    return out


def changed_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, hash) whose hash the cache does not hold."""
    return files.join(cache, ["path", "hash"], "left_anti")


def merge_fields(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Old rows with the fields that the new ones give; ids and absent fields stay."""
    n = new.select(*keys, *(F.col(v).alias(f"new_{v}") for v in values))
    return old.join(n, keys, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns))
