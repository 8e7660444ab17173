"""Session defaults and table access shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app: str = "skein", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than there are: for work that is heavy
    a row. Inputs of any size to speak of have more partitions and are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over at least all cores: for small rows that grow into heavy work, such as sources to parse, where
    the bytes of the files say little about it and one row group may hold them all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, df.rdd.getNumPartitions()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. The path is handed to Spark's reader untouched, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
