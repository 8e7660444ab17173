"""The logical relations (symbols, edges, commits, ...) as views of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread, table


#: Changes that a task holds.
TASK_ROWS = 1 << 19


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: kind is the type, the file is brand/type."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.concat_ws("/", "p_brand", "p_type").alias("file_path"),
        F.col("p_size").alias("start_line"), F.col("p_retailprice").alias("weight"),
    )


def consecutive(events: DataFrame) -> DataFrame:
    """(src, dst, edge_type, value, ts): each event's user and the next event's, in order of (ts, event_id).

    The order is total over the table, but no task sorts it all: each minute is ordered by itself and its
    last event is stitched to the first of the next minute that has any. Tasks are dealt by minutes, and so
    grow with the events of a minute; only the one row that each minute has in ``nxt`` is put in order as a whole.
    """
    parts = events.select("ts", "event_id", F.col("user_id").alias("src"), F.col("event_type").alias("edge_type"), "value", F.date_trunc("minute", "ts").alias("minute"))
    first = parts.groupBy("minute").agg(F.min_by("src", F.struct("ts", "event_id")).alias("first"))
    nxt = first.select("minute", F.lead("first").over(W.orderBy("minute")).alias("next"))
    inner = parts.withColumn("dst", F.lead("src").over(W.partitionBy("minute").orderBy("ts", "event_id")))
    return inner.join(nxt, "minute").select("src", F.coalesce("dst", "next").alias("dst"), "edge_type", "value", "ts")


def edges(spark: SparkSession, d: str) -> DataFrame:
    e = consecutive(table(spark, d, "events"))
    return e.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select("src", "dst", "edge_type").distinct()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """The edges without their kinds."""
    return edges(spark, d).select("src", "dst").distinct()


def commit_tasks(spark: SparkSession, d: str) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, d, "lineitem").count() // TASK_ROWS))


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as file changes: an order is a commit, a file is brand/type, the customer is the author."""
    line, part, orders = (table(spark, d, t) for t in ("lineitem", "part", "orders"))
    # Tasks by the number of rows, so that what one of them holds does not grow with the table; a count reads footers alone.
    tasks = commit_tasks(spark, d)
    files = part.select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("file"))
    heads = orders.select("o_orderkey", F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
    placed = line.select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber").repartition(tasks, "l_partkey").join(files.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    return placed.drop("l_partkey", "p_partkey").repartition(tasks, "l_orderkey").join(heads.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("commit"), "ts", "author", "file", F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted")
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Daily figures of each event type as snapshots of a codebase."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("codebase_id"), F.to_date("ts").alias("day")).agg(
        F.count("*").alias("files"), F.round(F.sum("value"), 4).alias("loc"), F.count_distinct("user_id").alias("functions")
    )


def usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("tool"), "ts", F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("ok"))


def documents(spark: SparkSession, d: str, heavy: bool = False) -> DataFrame:
    """``heavy``: for work on the texts that should use all cores, however few files hold them."""
    docs = table(spark, d, "documents")
    return (spread(docs) if heavy else docs).select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("file_path"), "n_chars")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


#: The same relations in DuckDB's SQL, for the oracles.
SQL = {
    "symbols": "symbols AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand || '/' || p_type AS file_path, p_size AS start_line, p_retailprice AS weight FROM part)",
    "steps": "steps AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_type AS edge_type, value, ts FROM events)",
    "edges": "edges AS (SELECT DISTINCT src, dst, edge_type FROM steps WHERE dst IS NOT NULL AND src <> dst)",
    "graph": "graph AS (SELECT DISTINCT src, dst FROM steps WHERE dst IS NOT NULL AND src <> dst)",
    "commits": "commits AS (SELECT l_orderkey AS commit, o_orderdate AS ts, o_custkey AS author, p_brand || '/' || p_type AS file, CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)",
    "changes": "changes AS (SELECT commit, file, any_value(ts) AS ts FROM commits GROUP BY commit, file)",
    "pairs": "pairs AS (SELECT a.file AS file1, b.file AS file2, count(*) AS frequency, min(a.ts) AS first_ts, max(a.ts) AS last_ts FROM changes a JOIN changes b ON a.commit = b.commit AND a.file < b.file GROUP BY 1, 2)",
    "per_file": "per_file AS (SELECT file, count(*) AS n FROM changes GROUP BY file)",
    "snapshots": "snapshots AS (SELECT event_type AS codebase_id, CAST(ts AS DATE) AS day, count(*) AS files, round(sum(value), 4) AS loc, count(DISTINCT user_id) AS functions FROM events GROUP BY 1, 2)",
}


def with_views(*names: str) -> str:
    """``WITH`` clause of the named relations, in their order."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
