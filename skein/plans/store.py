"""Symbol store: lookups, filters, reference joins and index figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..session import table
from ..sources import views as V
from .catalogue import query


@query("SELECT p_type AS kind, count(*) AS n FROM part GROUP BY p_type")
def symbols_by_kind(spark, d):
    return V.symbols(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(V.with_views("symbols") + "SELECT * FROM symbols WHERE id = 42")
def symbol_lookup(spark, d):
    return V.symbols(spark, d).filter(F.col("id") == 42)


@query(V.with_views("symbols") + "SELECT * FROM symbols WHERE kind = 'PROMO' AND file_path LIKE 'Brand#1%' ORDER BY file_path, start_line, id LIMIT 50")
def symbol_list(spark, d):
    s = V.symbols(spark, d)
    return s.filter((F.col("kind") == "PROMO") & F.col("file_path").startswith("Brand#1")).orderBy("file_path", "start_line", "id").limit(50)


@query(V.with_views("symbols") + "SELECT id, name, kind FROM symbols WHERE kind IN ('PROMO', 'SMALL', 'ECONOMY')")
def symbols_in_kinds(spark, d):
    return V.symbols(spark, d).filter(F.col("kind").isin("PROMO", "SMALL", "ECONOMY")).select("id", "name", "kind")


@query(V.with_views("symbols") + "SELECT id, file_path FROM symbols WHERE file_path = 'PROMO' OR file_path LIKE '%/PROMO'")
def symbol_path_suffix(spark, d):
    return V.symbols(spark, d).filter((F.col("file_path") == "PROMO") | F.col("file_path").endswith("/PROMO")).select("id", "file_path")


@query(V.with_views("symbols") + "SELECT count(*) AS symbols, count(DISTINCT file_path) AS files, count(DISTINCT name) AS names, max(start_line) AS last_line, count(*) FILTER (kind = 'PROMO') AS promos FROM symbols")
def index_stats(spark, d):
    return V.symbols(spark, d).agg(
        F.count("*").alias("symbols"), F.count_distinct("file_path").alias("files"), F.count_distinct("name").alias("names"), F.max("start_line").alias("last_line"), F.count_if(F.col("kind") == "PROMO").alias("promos")
    )


@query(V.with_views("steps", "edges") + "SELECT e.edge_type, e.src, e.dst, s.c_name AS source_name FROM edges e LEFT JOIN customer s ON e.src = s.c_custkey WHERE e.dst = 7")
def find_references(spark, d):
    """References to a node with the names of their sources, where known."""
    e, c = V.edges(spark, d).filter("dst = 7"), table(spark, d, "customer")
    return e.join(c, e.src == c.c_custkey, "left").select("edge_type", "src", "dst", F.col("c_name").alias("source_name"))


@query(V.with_views("steps", "edges") + "SELECT * FROM edges WHERE src = 7")
def outgoing_edges(spark, d):
    return V.edges(spark, d).filter("src = 7").orderBy("edge_type", "dst")


@query("SELECT doc_id AS id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def missing_embeddings(spark, d):
    return V.documents(spark, d).select("id").join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("SELECT source AS file_path, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source")
def files_without_vectors_semi(spark, d):
    held = V.documents(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return held.groupBy("file_path").agg(F.count("*").alias("n"))


@query(
    V.with_views("symbols")
    + """SELECT r.s_suppkey AS ref, min(s.id) FILTER (same) AS near, min(s.id) AS any_id, count(*) AS candidates
    FROM (SELECT s_suppkey, p_name AS name, p_brand || '/' || p_type AS file FROM supplier JOIN part ON s_suppkey = p_partkey) r
    JOIN LATERAL (SELECT id, file_path = r.file AS same FROM symbols WHERE symbols.name = r.name) s ON true GROUP BY r.s_suppkey"""
)
def name_resolution(spark, d):
    """What a name refers to: a symbol of the same file first, then the smallest id."""
    s = V.symbols(spark, d)
    refs = table(spark, d, "supplier").join(s, F.col("s_suppkey") == s.id).select(F.col("s_suppkey").alias("ref"), "name", F.col("file_path").alias("file"))
    # A reference meets one row of its name and one of its name in its file, however many symbols share them.
    names = s.groupBy("name").agg(F.min("id").alias("any_id"), F.count("*").alias("candidates"))
    places = s.groupBy("name", F.col("file_path").alias("file")).agg(F.min("id").alias("near"))
    met = refs.join(names.hint("merge"), "name").join(places.hint("merge"), ["name", "file"], "left")
    return met.groupBy("ref").agg(F.min("near").alias("near"), F.min("any_id").alias("any_id"), F.sum("candidates").alias("candidates"))


@query("SELECT page_id, substr(html, 1, 200) || CASE WHEN length(html) > 200 THEN '...' ELSE '' END AS head FROM pages")
def truncated_docs(spark, d):
    return table(spark, d, "pages").select("page_id", T.truncated(F.col("html"), 200).alias("head"))


@query(
    """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(substr(url, 1, 500), '"', '""'), '\\b(OR|AND|NOT|NEAR)\\b', ' ', 'gi'),
    '[\\\\"()+\\-*:<>^@]', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM pages"""
)
def query_sanitizer(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_query(F.col("url")).alias("q"))


@query("SELECT page_id, regexp_replace(regexp_replace(replace(regexp_replace(path, '\\.[A-Za-z]+$', ''), '/', '.'), '^src\\.', ''), '\\.?__init__$', '') AS module FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)")
def path_to_module(spark, d):
    return table(spark, d, "pages").select("page_id", S.module_of(F.regexp_replace("url", "^https?://", "")).alias("module"))


INTENT_SQL = "SELECT conv_id, turn, CASE WHEN b.hits > 0 THEN b.name ELSE 'unknown' END AS intent FROM (SELECT conv_id, turn, list_max(["
INTENT_SQL += ", ".join(
    "{'hits': len(list_filter(["
    + ", ".join(f"'{w}'" for w in words)
    + "], lambda w: contains(lower(text), w)))"
    + (" + CASE WHEN len(list_filter([" + ", ".join(f"'{w}'" for w in T.SYMBOL_WORDS) + "], lambda w: contains(lower(text), w))) > 0 AND (contains(lower(text), 'find') OR contains(lower(text), 'where')) THEN 2 ELSE 0 END" if name == "find_symbol" else "")
    + f", 'rank': {-i}, 'name': '{name}'}}"
    for i, (name, words) in enumerate(T.INTENTS.items())
)
INTENT_SQL += "]) AS b FROM conversations)"


@query(INTENT_SQL)
def intent_router(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))
