"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import lists as L
from ..operators import retrieval as R
from ..operators import textindex as I
from ..session import spread, table
from ..sources import views as V
from .catalogue import query

TERMS = ["the", "und", "tion"]
LIST = "['the', 'und', 'tion']"
WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"

BM25 = f"""words AS (SELECT doc_id AS id, {WORDS} AS ws FROM documents),
tf AS (SELECT id, len(ws) AS dl, t AS term, len(list_filter(ws, lambda w: w = t)) AS tf FROM words, (SELECT unnest({LIST}) AS t)),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM words),
dfs AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
bm25 AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tf JOIN dfs USING (term), stats WHERE tf > 0 GROUP BY id)"""


def index(spark, d):
    """The inverted index of the documents: built by the first search in the shared folder, then only read."""
    return I.of_table(V.documents(spark, d, heavy=True), "documents")


@query(f"SELECT id FROM (SELECT doc_id AS id, {WORDS} AS ws FROM documents) WHERE list_contains(ws, 'the') AND list_contains(ws, 'tion')")
def keyword_search_and(spark, d):
    return index(spark, d).holding(["the", "tion"])


@query(f"SELECT id FROM (SELECT doc_id AS id, {WORDS} AS ws FROM documents) WHERE list_contains(ws, 'und') OR list_contains(ws, 'tion')")
def keyword_search_or(spark, d):
    return index(spark, d).holding(["und", "tion"], every=False)


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return index(spark, d).top(TERMS, 20).select("id", F.round("score", 6).alias("score"))


QUERY_VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
VECTOR_SQL = "CAST([" + ", ".join(map(str, QUERY_VECTOR)) + "] AS DOUBLE[])"
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


@query(f"WITH {E} SELECT id, round({COS.format(a='v', b=VECTOR_SQL)}, 6) AS similarity FROM e ORDER BY similarity DESC, id LIMIT 10")
def knn_topk(spark, d):
    return R.knn(V.vectors(spark, d), QUERY_VECTOR, 10).select("id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {E}, s AS (SELECT a.id, b.id AS neighbor, round({COS.format(a="a.v", b="b.v")}, 9) AS sim FROM e a, e b WHERE a.id % 20 = 0 AND a.id <> b.id)
    SELECT id, neighbor, rank, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbor) AS rank FROM s) WHERE rank <= 10"""
)
def knn_graph(spark, d):
    """Ten nearest neighbours of every twentieth vector among all vectors."""
    v = V.vectors(spark, d)
    return L.knn_graph(v, v.filter("id % 20 = 0"), 10).select("id", "neighbor", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {E} SELECT a.id AS id_1, b.id AS id_2, round({COS.format(a='a.v', b='b.v')}, 6) AS similarity FROM e a JOIN e b ON a.id < b.id WHERE {COS.format(a='a.v', b='b.v')} >= 0.5")
def similarity_join(spark, d):
    return L.similarity_join(V.vectors(spark, d), 0.5).select("id_1", "id_2", F.round("similarity", 6).alias("similarity"))


@query(
    V.with_views("symbols")
    + """, a AS (SELECT id, row_number() OVER (ORDER BY start_line DESC, id) AS rn FROM symbols QUALIFY rn <= 30),
    b AS (SELECT id, row_number() OVER (ORDER BY weight DESC, id) AS rn FROM symbols QUALIFY rn <= 30)
    SELECT id, round(sum(1.0 / (rn + 60)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id"""
)
def rrf_fusion(spark, d):
    s = V.symbols(spark, d)
    lists = [R.ranked(s, [F.desc("start_line")], 30, "line"), R.ranked(s, [F.desc("weight")], 30, "weight")]
    return R.rrf(lists).select("id", F.round("score", 6).alias("score"))


PRIOR = "CASE edge_type WHEN 'click' THEN 5.0 WHEN 'view' THEN 4.0 WHEN 'purchase' THEN 3.0 WHEN 'error' THEN 2.0 ELSE 0.0 END"


@query(V.with_views("steps", "edges") + f"SELECT edge_type, {PRIOR} AS prior, count(*) AS n FROM edges GROUP BY 1, 2")
def kind_prior_rank(spark, d):
    prior = S.lookup({"click": 5.0, "view": 4.0, "purchase": 3.0, "error": 2.0}, F.col("edge_type"), 0.0)
    return V.edges(spark, d).groupBy("edge_type", prior.alias("prior")).agg(F.count("*").alias("n"))


HYBRID = f"""WITH {BM25}, {E}, {V.SQL["steps"]}, {V.SQL["edges"]},
deg AS (SELECT id, count(*) AS degree FROM (SELECT DISTINCT src AS id, dst AS o, 0 AS way FROM edges UNION ALL SELECT DISTINCT dst, src, 1 FROM edges) GROUP BY id),
cand AS (SELECT 'vector' AS factor, id, {COS.format(a="v", b=VECTOR_SQL)} AS s FROM e
  UNION ALL SELECT 'keyword', id, score FROM bm25 UNION ALL SELECT 'recency', doc_id, doc_id FROM documents UNION ALL SELECT 'size', doc_id, n_chars FROM documents
  UNION ALL SELECT 'quality', doc_id, quality FROM labels UNION ALL SELECT 'degree', id, degree FROM deg),
ranked AS (SELECT factor, id, row_number() OVER (PARTITION BY factor ORDER BY s DESC, id) AS rn FROM cand QUALIFY rn <= 40)
SELECT id, round(score, 6) AS score, text_head FROM (SELECT id, sum(1.0 / (rn + 60)) AS score FROM ranked GROUP BY id ORDER BY score DESC, id LIMIT 20)
LEFT JOIN (SELECT doc_id AS id, substr(text, 1, 40) AS text_head FROM documents) USING (id)"""


@query(HYBRID)
def hybrid_search(spark, d):
    """Vectors, keywords and four priors, each cut to 2k, fused by reciprocal ranks."""
    plain, v = V.documents(spark, d), V.vectors(spark, d)
    similar = R.knn(v, QUERY_VECTOR, 40).select("id", F.col("similarity").alias("score"))
    pairs = V.edges(spark, d)
    degree = G.degrees(pairs).select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    priors = [
        ("recency", plain.select("id"), "id"),
        ("size", plain.select("id", "n_chars"), "n_chars"),
        ("quality", table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "quality"),
        ("degree", degree, "degree"),
    ]
    top = R.hybrid(similar, index(spark, d).top(TERMS, 40), priors, 20)
    heads = plain.select("id", F.substring("text", 1, 40).alias("text_head"))
    return heads.join(F.broadcast(top), "id", "right").select("id", F.round("score", 6).alias("score"), "text_head")  # k rows


@query(
    """WITH s AS (SELECT user_id, list(value / 100 ORDER BY value DESC) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id)
    SELECT user_id, round(1 / (1 + exp(-(0.4 * v[1] + 0.3 * list_avg(v[1:3]) + 0.3 * v[CAST(floor(len(v) / 2) AS INTEGER) + 1]))), 6) AS confidence FROM s"""
)
def rerank_confidence(spark, d):
    scores = table(spark, d, "events").select("user_id", (F.col("value") / 100).alias("v"))
    return R.rerank_confidence(scores, "user_id", "v").select("user_id", F.round("confidence", 6).alias("confidence"))


@query(
    """WITH t AS (SELECT source, doc_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda w: NOT list_contains(["""
    + ", ".join(f"'{w}'" for w in sorted(R.T.STOP_WORDS))
    + """], w))) AS term FROM documents),
    tf AS (SELECT source, doc_id, term, count(*) AS c FROM t GROUP BY ALL), tot AS (SELECT source, doc_id, sum(c) AS total FROM tf GROUP BY ALL),
    df AS (SELECT source, term, count(*) AS df, avg(c / total) AS tf FROM tf JOIN tot USING (source, doc_id) GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    s AS (SELECT source, term, round(tf * (ln((n + 1) / (df + 1)) + 1), 9) AS score FROM df JOIN n USING (source))
    SELECT source, term, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 3"""
)
def tfidf_keywords(spark, d):
    return R.tfidf_keywords(spread(table(spark, d, "documents").select("source", "doc_id", "text")), 3, "source", "doc_id").select("source", "term", "rank", F.round("score", 6).alias("score"))
