"""Choosing context: diversity and token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diversity(df: DataFrame, group: str, score: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, best scores first."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), key))).filter(F.col("place") <= most)


def budget_select(df: DataFrame, group: str, order: str, cost: str, budget: int, first: int | None = None) -> DataFrame:
    """(group, order, cost) chosen in order while they fit; what does not fit is skipped, not an end.

    The fold is sequential by nature; it runs over one group's (order, cost) pairs as an array and keeps the rows
    themselves, so rows of equal order are told apart.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    held = df.groupBy(group).agg((F.slice(rows, 1, first) if first else rows).alias("rows"))
    kind = held.schema["rows"].dataType.simpleString()
    fold = F.expr(f"""aggregate(rows, struct(0L AS used, cast(array() AS {kind}) AS taken),
        (acc, r) -> if(acc.used + r.c <= {budget}, struct(acc.used + r.c AS used, array_append(acc.taken, r) AS taken), acc), acc -> acc.taken)""")
    return held.select(group, F.explode(fold).alias("r")).select(group, F.col("r.o").alias(order), F.col("r.c").alias(cost))


def diverse_budget(df: DataFrame, group: str, order: str, kind: str, cost: str, budget: int, most: int) -> DataFrame:
    """(group, order, kind, cost) chosen in order while they fit, at most ``most`` of a kind; others are skipped.

    Kinds are counted by what has been taken of them, in the same fold.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k"), F.col(cost).cast("long").alias("c"))))
    held = df.groupBy(group).agg(rows.alias("rows"))
    shape = held.schema["rows"].dataType.simpleString()
    fold = F.expr(f"""aggregate(rows, struct(0L AS used, cast(array() AS {shape}) AS taken),
        (acc, r) -> if(acc.used + r.c <= {budget} and size(filter(acc.taken, t -> t.k <=> r.k)) < {most}, struct(acc.used + r.c AS used, array_append(acc.taken, r) AS taken), acc), acc -> acc.taken)""")
    return held.select(group, F.explode(fold).alias("r")).select(group, F.col("r.o").alias(order), F.col("r.k").alias(kind), F.col("r.c").alias(cost))


def pressure(messages: DataFrame, group: str, text: str, window: int, share: float = 0.4) -> DataFrame:
    """(group, tokens, pressed): estimated tokens of a conversation against a share of the window."""
    tokens = F.sum(F.floor(F.length(text) / 4)).cast("long")
    return messages.groupBy(group).agg(tokens.alias("tokens")).withColumn("pressed", F.col("tokens") >= share * window)
