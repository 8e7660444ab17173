"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, html_text, license, mixing, omh, oracles, pii, pq, quality, repair, suffix_dedup, toxicity, warc
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_omh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Documents as files of a tree, source / language / part / document; in every tenth part of them a licence file stands.
    i = F.col("doc_id")
    part, name = F.concat(F.lit("p"), (i % 7).cast("string")), i.cast("string")
    licence = F.concat(F.lit("LICENSE-"), name)
    path = F.when(i % 10 == 0, F.concat_ws("/", "source", "lang", licence)).when(i % 10 == 5, F.concat_ws("/", "source", "lang", part, licence)).otherwise(F.concat_ws("/", "source", "lang", part, name))
    files = table(spark, sf_dir, "documents").withColumn("path", path)
    return license.scan(files)


def op11_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_toxicity": op2_toxicity, "op3_omh": op3_omh, "op4_warc": op4_warc, "op5_mixing": op5_mixing, "op6_quality": op6_quality, "op7_pq": op7_pq, "op8_bpe": op8_bpe, "op9_pii": op9_pii, "op10_license": op10_license, "op11_site_tree": op11_site_tree, "op12_align": op12_align, "op13_repair": op13_repair}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
