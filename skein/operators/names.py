"""Near names by an index of q-grams: all names meet all near ones without a scan for each.

A name within ``most`` edits of another keeps all but ``most * Q`` of its q-grams, so of the rarest ``most * Q + 1`` grams
(places counted apart) one at least is among those of the other: only these travel. Names that share such a gram and
differ little enough in length are compared. Names too short to be sure of a common gram meet those of like length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialise

Q = 2


def near_names(names: DataFrame, most: int = 2, name: str = "name") -> DataFrame:
    """(a, b, distance) with a < b of the distinct names within ``most`` edits. Null names are near nothing."""
    distinct = names.select(F.col(name).alias("name")).filter("name is not null").distinct()
    size = F.length("name")
    # Repeats of a gram are told apart by their number, so that common grams count as often as they stand in both.
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - Q + 1, F.lit(1))), lambda i: F.substring("name", i, F.lit(Q)))
    each = distinct.select("name", F.explode(grams).alias("gram")).groupBy("name", "gram").agg(F.count("*").alias("n"))
    each = each.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat(F.col("gram"), F.lit("\x00"), k.cast("string")))).alias("gram"))
    each = materialise(each, "grams")
    often = each.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = each.join(often, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("grams"))  # a name's own grams
    prefix = ranked.select("name", F.explode(F.slice("grams", 1, most * Q + 1)).alias("g")).select("name", F.length("name").alias("size"), F.col("g.gram").alias("gram"))
    # A name of this length or less may lose every gram; it meets all names that are as short, or longer by ``most``.
    short = most * Q + Q - 1
    brief = distinct.filter(F.length("name") <= short + most).select("name", F.length("name").alias("size"), F.lit("").alias("gram"))
    lists = materialise(prefix.unionByName(brief), "lists")
    a, b = lists.select(F.col("name").alias("a"), F.col("size").alias("s1"), "gram"), lists.select(F.col("name").alias("b"), F.col("size").alias("s2"), "gram")
    met = a.join(b, "gram").filter((F.col("a") < F.col("b")) & (F.abs(F.col("s1") - F.col("s2")) <= most)).select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b").cast("long")).filter(F.col("distance") <= most)
