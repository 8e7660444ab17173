"""Audits, rule checks, snapshots and usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T


def latest(df: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("place") <= n)


def deltas(df: DataFrame, key: str, order: str, metrics: list[str]) -> DataFrame:
    """(key, d_<metric>): newest minus previous value; null with fewer than two rows."""
    w = W.partitionBy(key).orderBy(order)
    stepped = df.select(key, F.row_number().over(W.partitionBy(key).orderBy(F.desc(order))).alias("place"), *((F.col(m) - F.lag(m).over(w)).alias(f"d_{m}") for m in metrics))
    return stepped.filter("place = 1").drop("place")


def usage_stats(calls: DataFrame) -> DataFrame:
    """(tool, calls, errors, success_rate, avg_latency, boost) of calls (tool, ts, latency_ms, ok), as of the last of all."""
    per = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.avg("latency_ms").alias("latency"), F.max("ts").alias("last"))
    per = per.join(F.broadcast(per.agg(F.max("last").alias("as_of"))))  # one row
    days = (F.unix_timestamp("as_of") - F.unix_timestamp("last")) / 86400
    return per.select(
        "tool", "calls", "errors", F.round((F.col("calls") - F.col("errors")) / F.col("calls"), 4).alias("success_rate"), F.round("latency", 4).alias("avg_latency"),
        S.usage_boost(F.col("calls"), F.col("errors"), days).alias("boost"),
    )


def pii_findings(docs: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """(key, pattern, n, first): number of matches of each pattern and the first few."""
    found = F.array(*(F.struct(F.lit(n).alias("pattern"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("m")) for n, p in T.PII_PATTERNS.items()))
    return docs.select(key, F.explode(F.filter(found, lambda x: F.size(x["m"]) > 0)).alias("x")).select(key, "x.pattern", F.size("x.m").alias("n"), F.slice("x.m", 1, most).alias("first"))


def contradictions(symbols: DataFrame, name: str, signature: str) -> DataFrame:
    """Names that carry different signatures."""
    return symbols.groupBy(name).agg(F.count_distinct(signature).alias("signatures"), F.count("*").alias("n")).filter("signatures > 1")


def violations(imports: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Imports (src, dst) whose layers (node, layer) are not an allowed pair (from_layer, to_layer)."""
    a, b = layers.select(F.col("node").alias("src"), F.col("layer").alias("from_layer")), layers.select(F.col("node").alias("dst"), F.col("layer").alias("to_layer"))
    return imports.join(a, "src").join(b, "dst").join(allowed, ["from_layer", "to_layer"], "left_anti").select("src", "dst", "from_layer", "to_layer")


def rule_violations(imports: DataFrame, layers: DataFrame, rules: list[dict]) -> DataFrame:
    """(src, dst, from_layer, to_layer, rule) of imports (src, dst) that a rule forbids, or that the rules of a layer do not
    allow: ``rules`` say {from, allowed: [...]} or {from, forbidden: [...]}. A layer without ``allowed`` may use all that is
    not forbidden; nodes without a layer are bound by nothing."""
    a, b = layers.select(F.col("node").alias("src"), F.col("layer").alias("from_layer")), layers.select(F.col("node").alias("dst"), F.col("layer").alias("to_layer"))
    rule = F.lit(None).cast("string")
    for r in rules:
        if "allowed" in r:
            rule = F.when((F.col("from_layer") == r["from"]) & ~F.col("to_layer").isin(*r["allowed"]), "not_allowed").otherwise(rule)
    for r in rules:
        if "forbidden" in r:
            rule = F.when((F.col("from_layer") == r["from"]) & F.col("to_layer").isin(*r["forbidden"]), "forbidden").otherwise(rule)
    return imports.join(a, "src").join(b, "dst").select("src", "dst", "from_layer", "to_layer", rule.alias("rule")).filter("rule is not null")


def pii_dry_run(docs: DataFrame, text: str, group: str) -> DataFrame:
    """(group, mode, kept, touched): how many texts each way of treating personal data keeps, and how many it touches."""
    hit = F.lit(False)
    for pattern in T.PII_PATTERNS.values():
        hit = hit | F.coalesce(F.col(text).rlike(pattern), F.lit(False))
    counts = docs.groupBy(group).agg(F.count("*").alias("n"), F.count_if(hit).alias("touched"))
    each = counts.withColumn("mode", F.explode(F.array(*map(F.lit, ("flag", "redact", "remove")))))
    return each.select(group, "mode", F.when(F.col("mode") == "remove", F.col("n") - F.col("touched")).otherwise(F.col("n")).alias("kept"), "touched")


def first_match(paths: DataFrame, patterns: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """Adds ``layer``: that of the first shell pattern (pattern, layer) that the path matches, or null."""
    layer = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        layer = F.when(F.col(path).rlike(S.glob_regex(pattern)), name).otherwise(layer)
    return paths.withColumn("layer", layer)


def dead_confidence(signals: dict[str, Column]) -> tuple[Column, Column]:
    """(confidence, signal): the first signal of life in order of precedence decides."""
    order = (("referenced", "low"), ("decorator", "low"), ("override", "low"), ("abstract", "medium"), ("exported", "medium"), ("entry_reachable", "low"), ("interface", "low"))
    confidence, signal = F.lit("high"), F.lit(None).cast("string")
    for name, level in reversed(order):
        if name in signals:
            confidence, signal = F.when(signals[name], level).otherwise(confidence), F.when(signals[name], name).otherwise(signal)
    return confidence, signal


def doctor_score(checks: dict[str, Column]) -> Column:
    """Weighted sum of passed checks."""
    weights = dict(zip(checks, (30, 20, 10, 15, 10, 10, 5), strict=False))
    return sum((F.when(c, weights[n]).otherwise(0) for n, c in checks.items()), F.lit(0))


def expired(files: DataFrame, modified: str, size: str, as_of: Column, days: int) -> DataFrame:
    """(files, bytes) older than ``days``."""
    return files.filter(F.datediff(as_of, F.col(modified)) > days).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
