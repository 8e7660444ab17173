"""Further operators of the store, the graph, naming, registries and housekeeping."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..functions import vectors as X
from ..operators import graph as G
from ..operators import quality as Q
from ..operators import retrieval as R
from ..session import table
from ..sources import files as SRC
from ..sources import views as V
from .catalogue import query

WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"


@query(V.with_views("steps", "edges") + "SELECT 'caller' AS role, src AS other FROM edges WHERE dst = 11 AND edge_type = 'click' UNION SELECT 'callee', dst FROM edges WHERE src = 11 AND edge_type = 'click'")
def callers_callees(spark, d):
    e = V.edges(spark, d).filter("edge_type = 'click'")
    one = e.filter("dst = 11").select(F.lit("caller").alias("role"), F.col("src").alias("other"))
    return one.unionByName(e.filter("src = 11").select(F.lit("callee").alias("role"), F.col("dst").alias("other"))).distinct()


@query(V.with_views("steps", "edges") + "SELECT dst AS base, list_sort(list(DISTINCT src)) AS subclasses FROM edges WHERE edge_type = 'purchase' GROUP BY dst")
def subclasses(spark, d):
    """Direct subclasses of each class."""
    e = V.edges(spark, d).filter("edge_type = 'purchase'")
    return e.groupBy(F.col("dst").alias("base")).agg(F.array_sort(F.collect_set("src")).alias("subclasses"))


@query(f"WITH w AS (SELECT doc_id AS id, {WORDS} AS ws FROM documents), hits AS (SELECT id FROM w WHERE list_contains(ws, 'the') AND list_contains(ws, 'qqqq')) SELECT id FROM hits UNION ALL SELECT id FROM w WHERE NOT EXISTS (FROM hits) AND (list_contains(ws, 'the') OR list_contains(ws, 'qqqq'))")
def search_and_then_or(spark, d):
    """Documents with every term, or with any where none has all."""
    docs = V.documents(spark, d)
    every = R.keyword_search(docs, ["the", "qqqq"]).select("id")
    found = every.limit(1).agg(F.count("*").alias("n"))  # one row
    some = R.keyword_search(docs, ["the", "qqqq"], every=False).select("id").join(F.broadcast(found)).filter("n = 0").select("id")
    return every.unionByName(some)


@query(
    """WITH t AS (SELECT doc_id AS id, source, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda w: w = 'trash' OR w = 'idiot') AS ws FROM documents)
    SELECT source, CAST(sum(len(ws)) AS BIGINT) AS hits FROM t GROUP BY source HAVING sum(len(ws)) > 0"""
)
def identifier_hits(spark, d):
    t = table(spark, d, "documents").select("source", F.size(F.filter(T.identifiers(F.col("text")), lambda w: w.isin("trash", "idiot"))).alias("n"))
    return t.groupBy("source").agg(F.sum("n").alias("hits")).filter("hits > 0")


@query("SELECT vec_id AS id, round((list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) + 1) / 2, 5) AS smoothed FROM embeddings")
def similarity_smoothed(spark, d):
    v = V.vectors(spark, d)
    return v.select("id", F.round(X.smoothed(X.dot(F.col("embedding"), F.col("embedding"))), 5).alias("smoothed"))


@query("SELECT label, count(*) AS vectors, count(*) FILTER (vec_id % 10 = 0) AS stale FROM embeddings GROUP BY label")
def embedding_counts(spark, d):
    """Vectors per model version, and those built by another model than the active one."""
    return V.vectors(spark, d).groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(F.col("id") % 10 == 0).alias("stale"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def delete_vectors_of_file(spark, d):
    gone = V.documents(spark, d).filter("file_path = 'src3'").select("id")
    return V.vectors(spark, d).select("id").join(gone, "id", "left_anti")


@query("SELECT doc_id AS id, text FROM documents WHERE source = 'src5' ORDER BY doc_id LIMIT 15")
def rerank_default(spark, d):
    """Without a model the order of the candidates stays."""
    docs = V.documents(spark, d).filter("file_path = 'src5'")
    candidates = docs.orderBy("id").limit(60).select(F.lit("q").alias("query"), "id", F.row_number().over(W.orderBy("id")).alias("rn"), "text")  # at most 60 rows
    return R.rerank(candidates).select("id", "text")


@query("SELECT user_id, round(0.8 * exp(-date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-15') / 30.0), 6) AS modifier FROM events GROUP BY user_id HAVING count(*) >= 3 AND max(ts) < TIMESTAMP '2024-02-15'")
def history_modifier(spark, d):
    """Damping of what was injected before: often, and how long ago."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).filter((F.col("n") >= 3) & (F.col("last") < F.lit("2024-02-15").cast("timestamp")))
    return u.select("user_id", F.round(S.history_modifier(F.col("n"), F.datediff(F.lit("2024-02-15").cast("date"), "last")), 6).alias("modifier"))


@query("SELECT user_id AS id, count(*) AS injected, max(ts) AS last, count(*) >= 3 AS decays FROM events GROUP BY user_id")
def injection_history(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("injected"), F.max("ts").alias("last")).withColumn("decays", F.col("injected") >= 3)


@query("SELECT doc_id, (length(text) - length(replace(text, '(', ''))) = (length(text) - length(replace(text, ')', ''))) AS balanced FROM documents")
def paren_balance(spark, d):
    return table(spark, d, "documents").select("doc_id", T.balanced(F.col("text")).alias("balanced"))


@query("SELECT DISTINCT p_name AS name, levenshtein(p_name, 'furiously red') AS distance FROM part ORDER BY distance, name LIMIT 5")
def similar_names(spark, d):
    """Closest names by edit distance."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return names.withColumn("distance", F.levenshtein("name", F.lit("furiously red")).cast("long")).orderBy("distance", "name").limit(5)


@query(
    """WITH m AS (SELECT p_brand AS cluster, p_brand || '.' || p_type AS module FROM part), s AS (SELECT cluster, list(DISTINCT string_split(module, '.')) AS parts FROM m GROUP BY cluster)
    SELECT cluster, CASE WHEN length(parts[1][1]) > 3 AND len(list_filter(parts, lambda p: p[1] <> parts[1][1])) = 0 THEN parts[1][1] ELSE cluster END AS name FROM s"""
)
def cluster_names(spark, d):
    """A cluster is named by the longest common prefix of its dotted modules."""
    m = table(spark, d, "part").select(F.col("p_brand").alias("cluster"), F.split(F.concat_ws(".", "p_brand", "p_type"), r"\.").alias("p"))
    g = m.groupBy("cluster").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    # All share what the least and the greatest share.
    same = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i)), lambda x: x))
    prefix = F.array_join(F.slice("a", F.lit(1), same), ".")
    return g.select("cluster", F.when(F.length(prefix) > 3, prefix).otherwise(F.col("cluster")).alias("name"))


@query("SELECT c_custkey AS id, c_nationkey AS cluster, CASE WHEN k > 1 THEN CAST(c_nationkey AS VARCHAR) || '_' || CAST(k AS VARCHAR) ELSE CAST(c_nationkey AS VARCHAR) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)")
def name_disambiguation(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster"))
    k = F.row_number().over(W.partitionBy("cluster").orderBy("id"))
    base = F.col("cluster").cast("string")
    return c.withColumn("k", k).select("id", "cluster", F.when(F.col("k") > 1, F.concat(base, F.lit("_"), F.col("k").cast("string"))).otherwise(base).alias("name"))


@query(
    "SELECT s_nationkey AS project, count(*) AS files, round(sum(s_acctbal), 2) AS bytes, 30 * CAST(count(*) > 2 AS INT) + 20 * CAST(max(s_acctbal) > 5000 AS INT) + 10 * CAST(min(s_acctbal) < 0 AS INT) AS score FROM supplier GROUP BY s_nationkey"
)
def project_registry(spark, d):
    """Figures and a weighted check score of each project."""
    g = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("project")).agg(F.count("*").alias("files"), F.round(F.sum("s_acctbal"), 2).alias("bytes"), F.max("s_acctbal").alias("hi"), F.min("s_acctbal").alias("lo"))
    return g.select("project", "files", "bytes", Q.doctor_score({"files": F.col("files") > 2, "size": F.col("hi") > 5000, "debt": F.col("lo") < 0}).alias("score"))


@query("SELECT count(*) AS files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM documents JOIN orders ON doc_id = o_orderkey WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 730")
def cleanup_expired(spark, d):
    files = V.documents(spark, d).join(table(spark, d, "orders"), F.col("id") == F.col("o_orderkey"))
    return Q.expired(files, "o_orderdate", "n_chars", F.lit("1998-08-02").cast("date"), 730)


@query("SELECT conv_id, role, min(turn) AS first_turn, count(*) AS turns FROM conversations GROUP BY conv_id, role")
def session_mutations(spark, d):
    """What a session touched, and when first."""
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g') AS plain FROM pages")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ").alias("plain"))


@query("SELECT source AS dir, list_sort(list(DISTINCT lang)) AS deps, count(*) AS files FROM documents GROUP BY source")
def skeleton(spark, d):
    """Directories with what they contain."""
    return table(spark, d, "documents").groupBy(F.col("source").alias("dir")).agg(F.array_sort(F.collect_set("lang")).alias("deps"), F.count("*").alias("files"))


@query("SELECT p_name AS symbol, arg_max(p_brand || '/' || p_type || ':' || CAST(p_size AS VARCHAR), p_partkey) AS place FROM part GROUP BY p_name")
def symbol_manifest(spark, d):
    """Where each name is defined; the last definition counts."""
    s = V.symbols(spark, d)
    return s.groupBy(F.col("name").alias("symbol")).agg(F.max_by(F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string")), "id").alias("place"))


GRAPH = V.with_views("steps", "graph").replace("WITH ", "WITH RECURSIVE ", 1)
NODES = "(SELECT src AS id FROM graph UNION SELECT dst FROM graph)"


@query(GRAPH + f", r(a, b, level) AS (SELECT id, id, 0 FROM {NODES} UNION SELECT a, dst, level + 1 FROM r JOIN graph ON b = src WHERE level < 2) SELECT a AS root, b AS id, min(level) AS depth FROM r GROUP BY a, b")
def dependency_chain(spark, d):
    """Dependencies of every node to a depth."""
    e = V.pairs(spark, d)
    return G.within(e, G.nodes(e), 2).select("root", "id", F.col("level").alias("depth"))


@query(GRAPH + ", r(a, b) AS (SELECT src, dst FROM graph UNION SELECT a, dst FROM r JOIN graph ON b = src) SELECT a AS root, count(*) AS reached FROM r GROUP BY a")
def transitive_closure(spark, d):
    return G.closure_sizes(V.pairs(spark, d))


@query("SELECT n_nationkey AS id, CASE WHEN n_name LIKE 'A%' THEN 'api' WHEN n_name LIKE '%IA' THEN 'core' END AS layer FROM nation")
def layer_of_path(spark, d):
    """The layer of the first shell pattern that a path matches."""
    return Q.first_match(table(spark, d, "nation"), [("A*", "api"), ("*IA", "core")], "n_name").select(F.col("n_nationkey").alias("id"), "layer")


@query("SELECT event_type, CASE WHEN sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) >= 10 THEN 'high' WHEN sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) >= 3 THEN 'medium' WHEN sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) >= 1 THEN 'low' ELSE 'none' END AS risk FROM events GROUP BY event_type")
def risk_classes(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(S.risk_class(F.count_if(F.col("value") > 150)).alias("risk"))
