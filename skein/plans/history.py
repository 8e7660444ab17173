"""Co-change mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cochange as C
from ..sources import views as V
from .catalogue import query

PAIRS = V.with_views("commits", "changes", "pairs", "per_file") + """, mined AS (SELECT file1, file2, frequency, round(frequency / least(a.n, b.n), 4) AS coupling,
CASE WHEN frequency > 1 THEN round((epoch(last_ts) - epoch(first_ts)) / (frequency - 1), 2) ELSE 0.0 END AS avg_gap, last_ts AS last_co_change, a.n AS n1, b.n AS n2
FROM pairs JOIN per_file a ON file1 = a.file JOIN per_file b ON file2 = b.file), churn AS (SELECT file, count(DISTINCT commit) AS commit_count, CAST(sum(added) AS BIGINT) AS lines_added,
CAST(sum(deleted) AS BIGINT) AS lines_deleted, count(DISTINCT author) AS authors_count, max(ts) AS last_modified, round(sum(deleted) / sum(added + deleted), 4) AS instability FROM commits GROUP BY file),
ends AS (SELECT file1 AS file, file2 AS partner, frequency, coupling, avg_gap FROM mined UNION ALL SELECT file2, file1, frequency, coupling, avg_gap FROM mined)
"""


@query(PAIRS + "SELECT * FROM churn")
def churn(spark, d):
    return C.churn(V.commits(spark, d), V.commit_tasks(spark, d))


@query(PAIRS + "SELECT * EXCLUDE (n1, n2) FROM mined")
def co_change_pairs(spark, d):
    return C.pairs(V.commits(spark, d)).drop("n1", "n2")


@query(PAIRS + "SELECT partner, coupling, frequency FROM ends WHERE file = 'Brand#11/PROMO' ORDER BY coupling DESC, frequency DESC, partner LIMIT 10")
def co_change_predict(spark, d):
    return C.predict(C.pairs(V.commits(spark, d)), "Brand#11/PROMO", 10).select("partner", "coupling", "frequency")


@query(PAIRS + "SELECT file, partner, frequency, avg_gap FROM ends WHERE frequency >= 3")
def co_change_history(spark, d):
    return C.both_ends(C.pairs(V.commits(spark, d))).filter("frequency >= 3").select("file", "partner", "frequency", "avg_gap")


@query(PAIRS + "SELECT file1, file2, round(frequency / (n1 + n2 - frequency), 6) AS jaccard FROM mined WHERE round(frequency / (n1 + n2 - frequency), 6) > 0.02")
def co_change_jaccard(spark, d):
    return C.jaccard(C.pairs(V.commits(spark, d)), 0.02)


@query(
    PAIRS
    + """SELECT file, commit_count, lines_added, lines_deleted, instability, coalesce(m, 0) AS coupled_files, round(coalesce(a, 0), 6) AS avg_coupling, round(instability * coalesce(a, 0), 4) AS hotspot_score
    FROM churn LEFT JOIN (SELECT file, avg(coupling) AS a, count(*) AS m FROM ends GROUP BY file) USING (file) ORDER BY hotspot_score DESC, file LIMIT 20"""
)
def hotspots(spark, d):
    c = V.commits(spark, d)
    return C.hotspots(C.churn(c, V.commit_tasks(spark, d)), C.pairs(c), 20).withColumn("avg_coupling", F.round("avg_coupling", 6))


@query(PAIRS + ", recent AS (SELECT * FROM mined WHERE last_co_change >= TIMESTAMP '1997-01-01') SELECT file1, file2, frequency FROM recent WHERE coupling >= 0.05")
def co_change_diff(spark, d):
    """Pairs still changing together since a date."""
    return C.pairs(V.commits(spark, d)).filter((F.col("last_co_change") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("coupling") >= 0.05)).select("file1", "file2", "frequency")
