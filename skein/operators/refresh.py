"""Refreshing an index: what changed, which layers follow, and what storage it takes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import text as T
from ..functions import vectors as V
from ..lineage import discard, materialise, shared_dir
from .graph import fans
from .keyed import KeyedTable
from .retrieval import hashed_embedding


def hashed(files: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return files.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"))


def refresh(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, status): added, changed, removed or unchanged, by hash."""
    both = old.select(key, F.col("hash").alias("before")).join(new.select(key, F.col("hash").alias("after")), key, "full")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"))


def names(text: Column) -> Column:
    """The distinct identifiers of a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(T.IDENTIFIER), F.lit(0)))


def index_schema(files: DataFrame, key: str = "id") -> StructType:
    return StructType([files.schema[key]]).add("hash", "string").add("names", ArrayType(StringType()))


def refresh_table(table: KeyedTable, files: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Bring an index of files (key, hash, names) up to date; (key, status) of every file.

    Statuses come from hashes alone; only new and changed texts are parsed, and only their folders are written, with
    tombstones for files that are gone. The names of all others stay as they were stored.
    """
    status = materialise(refresh(table.read(columns=[key, "hash"]), hashed(files, key, text), key), "status")
    fresh = files.join(status.filter("status in ('added', 'changed')").select(key), key, "left_semi")
    rows = fresh.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"), names(F.col(text)).alias("names"), F.lit(False).alias("lost"))
    lost = status.filter("status = 'removed'").select(key, F.lit(None).cast("string").alias("hash"), F.lit(None).cast("array<string>").alias("names"), F.lit(True).alias("lost"))
    table.merge(rows.unionByName(lost), gone=F.col("lost"))
    return status


def layers(table: KeyedTable) -> dict[str, DataFrame]:
    """The layers over an index of files: symbols (id, name), edges to the smallest id that holds a name, and metrics;
    ``parsed``: the files that the last refresh parsed, as its delta holds them."""
    files = table.read(columns=["id"])
    symbols = materialise(table.read().select("id", F.explode("names").alias("name")), "symbols")
    # One row a name, dealt by a hash of it: held by name, so that the symbols, which are many more, need no sort.
    owner = symbols.groupBy("name").agg(F.min("id").alias("dst"))
    edges = materialise(symbols.join(owner.hint("shuffle_hash"), "name").select(F.col("id").alias("src"), "dst").filter("src <> dst").distinct(), "edges")
    return {"files": files, "parsed": table.changed(), "symbols": symbols, "edges": edges, "metrics": materialise(fans(edges), "metrics")}


def reindex(table: KeyedTable, old: DataFrame, new: DataFrame) -> DataFrame:
    """(layer, n): rows of each layer of an index of ``old`` (id, text) after a refresh to ``new``."""
    refresh_table(table, old)
    refresh_table(table, new)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in layers(table).items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def embedded(docs: DataFrame, dim: int, key: str = "id", text: str = "text") -> DataFrame:
    """(key, dim, norm) of the stored vectors; texts without a word are skipped."""
    rows = docs.filter(F.coalesce(text, F.lit("")).rlike(T.TOKEN)).select(key, hashed_embedding(F.col(text), dim).alias("embedding"))
    stored = materialise(rows, "vectors")
    return stored.select(key, F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


def locate(texts: DataFrame, wanted: list[str], tail: str = "", key: str = "id", text: str = "text") -> DataFrame:
    """(name, first_id, places): the first text that holds each name (and what must follow it), and how many do."""
    held = [F.coalesce(F.contains(F.col(text), F.lit(w + tail)), F.lit(False)) for w in wanted]
    sums = texts.agg(*(F.min(F.when(h, F.col(key))).alias(f"m{i}") for i, h in enumerate(held)), *(F.count_if(h).alias(f"n{i}") for i, h in enumerate(held)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(w).alias("name"), F.col(f"m{i}").alias("first_id"), F.col(f"n{i}").alias("places")) for i, w in enumerate(wanted)))).alias("x")).select("x.*")


def summary(modules: DataFrame, most: int) -> DataFrame:
    """(project, symbols, modules, shown, more) of modules (project, kind, n): the first ``most`` names are shown."""
    from pyspark.sql import Window as W

    placed = modules.withColumn("place", F.row_number().over(W.partitionBy("project").orderBy("kind")))
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col("kind"))))  # nulls are not collected
    return placed.groupBy("project").agg(F.sum("n").alias("symbols"), F.count("*").alias("modules"), shown.alias("shown"), (F.count("*") > most).alias("more"))


def vacuum(rows: DataFrame, target_bytes: int) -> DataFrame:
    """(rows, files_after, fewer, freed): a table written as it comes, then again in files of about ``target_bytes``."""
    spark, at = rows.sparkSession, [f"{shared_dir(rows.sparkSession)}/vacuum-{uuid.uuid4().hex}" for _ in range(2)]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path

    def size(path: str) -> tuple[int, int]:
        where = fs_path(path)
        parts = [s for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where) if s.getPath().getName().startswith("part-")]
        return len(parts), sum(s.getLen() for s in parts)

    rows.write.option("maxRecordsPerFile", 0).parquet(at[0])
    before = size(at[0])
    spark.read.parquet(at[0]).coalesce(max(1, -(-before[1] // target_bytes))).write.parquet(at[1])
    after = size(at[1])
    discard(spark, at[0])
    return spark.read.parquet(at[1]).agg(F.count("*").alias("rows"), F.lit(after[0]).alias("files_after"), F.lit(after[0] < before[0]).alias("fewer"), F.lit(after[1] < before[1]).alias("freed"))
