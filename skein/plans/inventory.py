"""Queries over source trees, reports and whole refreshes. A tree of files is drawn from ``part``: file p of four
languages imports the file 4 * p_size places before it, if there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import shared_dir
from ..operators import cluster as K
from ..operators import code as C
from ..operators import context as X
from ..operators import graph as G
from ..operators import lists as L
from ..operators import refresh as R
from ..operators.keyed import KeyedTable
from ..operators import spectral as Z
from ..session import dealt, table
from ..sources import views as V
from .catalogue import query

PATHS = "CASE {0} % 4 WHEN 0 THEN 'src/pkg' || ({0} % 7) || '/m' || {0} || '.py' WHEN 1 THEN 'web/c' || ({0} % 5) || '/m' || {0} || '.ts' WHEN 2 THEN 'src/m' || {0} || '.rs' ELSE 'lib/d' || ({0} % 3) || '/m' || {0} || '.c' END"
TREE = f"tree AS (SELECT p_partkey AS p, p_partkey - 4 * p_size AS t, {PATHS.format('p_partkey')} AS path, ['python', 'typescript', 'rust', 'c'][p_partkey % 4 + 1] AS lang FROM part)"
MODULE = "CASE lang WHEN 'python' THEN 'pkg' || (t % 7) || '.m' || t WHEN 'typescript' THEN '../c' || (t % 5) || '/m' || t WHEN 'rust' THEN 'crate::m' || t ELSE '\"../d' || (t % 3) || '/m' || t || '.c\"' END"


def path_of(p):
    text = lambda x: x.cast("string")
    return (
        F.when(p % 4 == 0, F.concat(F.lit("src/pkg"), text(p % 7), F.lit("/m"), text(p), F.lit(".py"))).when(p % 4 == 1, F.concat(F.lit("web/c"), text(p % 5), F.lit("/m"), text(p), F.lit(".ts")))
        .when(p % 4 == 2, F.concat(F.lit("src/m"), text(p), F.lit(".rs"))).otherwise(F.concat(F.lit("lib/d"), text(p % 3), F.lit("/m"), text(p), F.lit(".c")))
    )


def tree(spark, d):
    """(path, lang, text) of the files."""
    p, t = F.col("p_partkey"), F.col("p_partkey") - 4 * F.col("p_size")
    lang = F.element_at(F.array(*map(F.lit, ("python", "typescript", "rust", "c"))), (p % 4 + 1).cast("int"))
    text = (
        F.when(p % 4 == 0, F.format_string("import os\nfrom pkg%d.m%d import x\n", t % 7, t)).when(p % 4 == 1, F.format_string('import React from "react";\nimport {x} from "../c%d/m%d";\n', t % 5, t))
        .when(p % 4 == 2, F.format_string("use std::fmt;\nuse crate::m%d;\n", t)).otherwise(F.format_string('#include <stdio.h>\n#include "../d%d/m%d.c"\n', t % 3, t))
    )
    return dealt(table(spark, d, "part").select("p_partkey", "p_size")).select(path_of(p).alias("path"), lang.alias("lang"), F.when(t >= 0, text).otherwise(F.regexp_extract(text, r"^[^\n]*\n", 0)).alias("text"))


@query(f"""WITH {TREE} SELECT path, lang, {MODULE} AS module FROM tree WHERE t >= 0 UNION ALL SELECT path, lang, CASE lang WHEN 'python' THEN 'os' WHEN 'typescript' THEN 'react' WHEN 'rust' THEN 'std::fmt' ELSE '<stdio.h>' END FROM tree""")
def import_extraction(spark, d):
    return C.imports(tree(spark, d))


@query(f"WITH {TREE} SELECT path, {MODULE} AS module, {PATHS.format('t')} AS target FROM tree WHERE t >= 0 AND t IN (SELECT p_partkey FROM part) AND t <> p")
def import_resolution(spark, d):
    files = tree(spark, d)
    return C.resolve(C.imports(files), files)


@query(f"WITH {TREE} SELECT {PATHS.format('t')} AS target, count(*) AS importers, min(path) AS first FROM tree WHERE t >= 0 AND t IN (SELECT p_partkey FROM part) AND t <> p GROUP BY t")
def related_importers(spark, d):
    """Who imports each file, by the resolved imports."""
    files = tree(spark, d)
    return C.resolve(C.imports(files), files).groupBy("target").agg(F.count("*").alias("importers"), F.min("path").alias("first"))


@query(
    "WITH p AS (SELECT p_partkey AS p, p_partkey // 2 AS i FROM part), f AS (SELECT p, i, CASE WHEN p % 2 = 0 THEN 'src/m' || i || '.py' ELSE 'tests/test_m' || i || '.py' END AS path FROM p)"
    " SELECT a.path, b.path AS other, 'test_file' AS reason, CASE WHEN a.p % 2 = 0 THEN 0.95 ELSE 0.9 END AS confidence FROM f a JOIN f b ON a.i = b.i AND a.p <> b.p"
)
def related_tests(spark, d):
    p = F.col("p_partkey")
    i = F.expr("p_partkey div 2").cast("string")
    return C.test_pairs(table(spark, d, "part").select(F.when(p % 2 == 0, F.concat(F.lit("src/m"), i, F.lit(".py"))).otherwise(F.concat(F.lit("tests/test_m"), i, F.lit(".py"))).alias("path")))


@query("SELECT p_brand AS project, count(*) AS symbols, count(DISTINCT p_type) AS modules, (list_sort(list(DISTINCT p_type)))[1:3] AS shown, count(DISTINCT p_type) > 3 AS more FROM part GROUP BY p_brand")
def manifest_summary(spark, d):
    """Counts of each project and its first modules, marked where there are more."""
    modules = V.symbols(spark, d).groupBy(F.substring_index("file_path", "/", 1).alias("project"), "kind").agg(F.count("*").alias("n"))
    return R.summary(modules, 3)


@query("SELECT id, lines, flush FROM (SELECT doc_id AS id, len(x) AS lines, len(list_filter(x, lambda s: s <> '' AND NOT regexp_matches(s, '^[ \\t]'))) AS flush FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))")
def top_level_lines(spark, d):
    """Lines that start in the first column."""
    lines = V.documents(spark, d).select("id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("x"))
    return lines.select("id", F.size("x").alias("lines"), F.size(F.filter("x", lambda s: (s != "") & ~s.rlike("^[ \\t]"))).alias("flush"))


@query("SELECT p_partkey AS id, greatest(1, least(20, p_size - 10)) AS clamped FROM part")
def parameter_clamp(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.clamp(F.col("p_size") - 10, 1, 20, 50).alias("clamped"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_fields(spark, d):
    """Fields of JSON texts, parsed by a schema; broken texts give null."""
    return table(spark, d, "events").groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS line FROM region")
def json_sink(spark, d):
    return table(spark, d, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


@query(V.with_views("steps", "graph") + "SELECT '  \"' || src || '\" -> \"' || dst || '\";' AS line FROM graph")
def dot_sink(spark, d):
    return C.dot_lines(V.pairs(spark, d))


@query("SELECT '<tr><td>' || s_suppkey || '</td><td>' || s_name || '</td></tr>' AS line FROM supplier")
def html_sink(spark, d):
    return C.html_rows(table(spark, d, "supplier").select("s_suppkey", "s_name"))


@query(V.with_views("steps", "edges") + "SELECT src, dst, edge_type, total, total > 20 AS truncated FROM (SELECT *, (SELECT count(*) FROM edges WHERE dst = 9) AS total FROM edges WHERE dst = 9 ORDER BY src, edge_type LIMIT 20)")
def references_page(spark, d):
    """The first references of a target, how many there are, and whether some are left out."""
    return C.page(V.edges(spark, d).filter("dst = 9"), ["src", "edge_type"], 20)


RULES = [("user", "the", "Ask shorter."), ("user", "a", "Ask again."), ("system", "zzzz", "Never.")]


@query(
    "SELECT conv_id, turn, advice FROM (SELECT conv_id, turn, CASE WHEN role = 'user' AND contains(lower(t), 'the') THEN 'Ask shorter.' WHEN role = 'user' AND contains(lower(t), 'a') THEN 'Ask again.' WHEN role = 'system' AND contains(lower(t), 'zzzz') THEN 'Never.'"
    " WHEN role IN ('user', 'system') THEN 'Check docs for ' || role || '.' END AS advice FROM (SELECT *, 'Error: ' || text AS t FROM conversations)) WHERE advice IS NOT NULL"
)
def error_guidance(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", C.guidance(F.col("role"), F.concat(F.lit("Error: "), "text"), RULES).alias("advice")).filter("advice is not null")


@query(
    """WITH RECURSIVE c AS (SELECT conv_id, turn, role, least(150 + length(text) // 4, 1000) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    f(conv_id, i, used, u, a, s, took) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 0, 0, false FROM c UNION ALL
      SELECT conv_id, i, CASE WHEN ok THEN used + cost ELSE used END, u + CAST(ok AND role = 'user' AS INT), a + CAST(ok AND role = 'assistant' AS INT), s + CAST(ok AND role = 'system' AS INT), ok
      FROM (SELECT c.*, used, u, a, s, used + cost <= 600 AND CASE role WHEN 'user' THEN u WHEN 'assistant' THEN a ELSE s END < 2 AS ok FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1))
    SELECT c.conv_id, c.turn, c.role, c.cost FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i WHERE took"""
)
def budget_diversity(spark, d):
    """Turns that fit a budget, at most two of a role."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", S.token_estimate(F.col("text"), F.lit(None).cast("string")).alias("cost"))
    return X.diverse_budget(c, "conv_id", "turn", "role", "cost", 600, 2)


CLASSES = "m AS (SELECT o_custkey AS class, o_orderpriority AS name, bool_or(o_orderstatus = 'F') AS abstract FROM orders GROUP BY ALL), up(class, ancestor) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 1 UNION ALL SELECT class, ancestor // 2 FROM up WHERE ancestor > 1)"


@query(
    f"""WITH RECURSIVE {CLASSES}, per AS (SELECT m.*, EXISTS (SELECT 1 FROM up JOIN m n ON n.class = up.ancestor WHERE up.class = m.class AND n.name = m.name) AS again FROM m)
    SELECT c_custkey AS class, (SELECT count(*) FROM up WHERE class = c_custkey) AS depth, CAST(c_custkey > 1 AS BIGINT) AS num_bases, count(per.class) FILTER (NOT again) AS num_methods, count(per.class) FILTER (again) AS num_overrides,
    coalesce(bool_or(abstract), false) AS is_abstract, NOT coalesce(bool_or(abstract), false) AND count(per.class) FILTER (NOT again) > 0 AS has_concrete_methods
    FROM customer LEFT JOIN per ON per.class = c_custkey WHERE c_custkey > 1 OR per.class IS NOT NULL GROUP BY c_custkey"""
)
def class_metrics(spark, d):
    """Customers as classes of a heap-shaped hierarchy, their orders' priorities as methods."""
    c = table(spark, d, "customer").filter("c_custkey > 1").select(F.col("c_custkey").alias("class"), F.expr("c_custkey div 2").alias("base"))
    methods = table(spark, d, "orders").select(F.col("o_custkey").alias("class"), F.col("o_orderpriority").alias("name"), (F.col("o_orderstatus") == "F").alias("abstract"))
    edges = c.select(F.col("class").alias("src"), F.col("base").alias("dst"))
    up = G.bfs(edges, G.nodes(edges)).filter("level > 0").select(F.col("root").alias("class"), F.col("id").alias("ancestor"))
    return C.class_metrics(c, methods, up)


@query(
    "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS x FROM e a JOIN e b ON a.id < b.id)"
    " SELECT src, dst, round(0.5 * x, 6) AS w FROM s WHERE x > 0.5 UNION ALL SELECT dst, src, round(0.5 * x, 6) FROM s WHERE x > 0.5"
)
def semantic_adjacency(spark, d):
    near = L.similarity_join(V.vectors(spark, d), 0.5).filter("similarity > 0.5").select(F.col("id_1").alias("src"), F.col("id_2").alias("dst"), F.col("similarity").alias("w"))
    return K.mirrored(near, 0.5).withColumn("w", F.round("w", 6))


@query()
def merged_clusters(spark, d):
    """The clusters of a tree merged until four are left; tests hold it against plain Python."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("r"), F.substring(F.bin(64 + F.pmod("c_nationkey", F.lit(25))), 2, 6)).alias("cluster"))
    return K.merge_small(c, 4)


NOW = "SELECT src, dst FROM (SELECT src, dst FROM graph UNION ALL SELECT dst, src FROM graph)"


@query(
    V.with_views("steps", "graph") + f", adj AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM ({NOW}) GROUP BY src, dst), deg AS (SELECT src AS id, sum(w) AS d FROM adj GROUP BY src)"
    " SELECT src, dst, round(-w / sqrt(a.d * b.d), 9) AS value FROM adj JOIN deg a ON src = a.id JOIN deg b ON dst = b.id UNION ALL SELECT id, id, 1.0 FROM deg"
)
def incremental_laplacian(spark, d):
    """The Laplacian after edges of low ids have come, from the one before and the touched rows alone."""
    pairs = V.pairs(spark, d).withColumn("w", F.lit(1.0))
    old, new = K.fuse([(pairs.filter("src > 3"), 1.0)]), K.fuse([(pairs, 1.0)])
    touched = pairs.filter("src <= 3").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return K.update_laplacian(K.laplacian(old), new, touched).withColumn("value", F.round("value", 9))


@query("SELECT p_partkey AS id FROM part ORDER BY md5(p_partkey || ':42'), p_partkey LIMIT (SELECT least(count(*), CAST(floor(sqrt(count(*))) AS BIGINT) + 100) FROM part)")
def nystrom_sample(spark, d):
    return K.nystrom_sample(table(spark, d, "part").select(F.col("p_partkey").alias("id")), 42)


@query()
def suggest_modules(spark, d):
    """Clusters of the graph with their sizes and first members; no SQL (an eigenvector)."""
    found = Z.bipartition(K.fuse([(V.pairs(spark, d).withColumn("w", F.lit(1.0)), 1.0)]), min_size=5)
    return found.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("first"))


@query("SELECT t AS name, (SELECT min(doc_id) FROM documents WHERE contains(text, t || ' ')) AS first_id, (SELECT count(*) FROM documents WHERE contains(text, t || ' ')) AS places FROM (SELECT unnest(['the', 'und', 'zzzz']) AS t)")
def locate_by_text(spark, d):
    """The first text that holds each name, and how many do: one pass for all names."""
    return R.locate(V.documents(spark, d), ["the", "und", "zzzz"], " ")


@query(
    V.with_views("steps", "graph").replace("WITH ", "WITH RECURSIVE ", 1)
    + ", hit AS (SELECT min(p_partkey) AS id FROM part WHERE contains(p_name, 'ring') AND p_partkey IN (SELECT src FROM graph)), lv(id, level) AS (SELECT id, 0 FROM hit UNION SELECT dst, level + 1 FROM lv JOIN graph ON lv.id = src WHERE level < 1) SELECT id, min(level) AS level FROM lv GROUP BY id"
)
def graph_query_by_name(spark, d):
    """A name found among symbols, then what its node reaches."""
    pairs = V.pairs(spark, d)
    known = V.symbols(spark, d).filter(F.col("name").contains("ring")).join(pairs.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    return G.bfs(pairs, known.agg(F.min("id").alias("id")), 1).select("id", "level")


OLD = "o AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents WHERE doc_id % 7 <> 0)"


def both_versions(spark, d):
    docs = V.documents(spark, d).select("id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.filter("id % 10 <> 0").withColumn("text", F.when(F.col("id") % 3 == 0, "old").otherwise(F.col("text"))), docs.filter("id % 7 <> 0")


def index_table(spark, files):
    """An empty index of files in the shared folder."""
    return KeyedTable(spark, f"{shared_dir(spark)}/file-index-{uuid.uuid4().hex}", R.index_schema(files), ["id"])


@query(f"WITH {OLD} SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN sha256(o.t) = sha256(n.t) THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.id = n.id) GROUP BY status")
def refresh_index(spark, d):
    """Files that a refresh of an index adds, changes, removes and skips."""
    old, new = both_versions(spark, d)
    table = index_table(spark, old)
    R.refresh_table(table, old)
    return R.refresh_table(table, new).groupBy("status").agg(F.count("*").alias("n"))


LINES = "regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]{{2,}}')"


@query(
    f"""WITH {OLD}, s AS (SELECT DISTINCT id, unnest({LINES.format("n.t")}) AS name FROM n), first AS (SELECT name, min(id) AS id FROM s GROUP BY name), e AS (SELECT DISTINCT s.id AS src, first.id AS dst FROM s JOIN first USING (name) WHERE s.id <> first.id)
    SELECT 'files' AS layer, count(*) AS n FROM n UNION ALL SELECT 'symbols', count(*) FROM s UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'metrics', count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e) UNION ALL SELECT 'parsed', count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = n.id AND o.t = n.t)"""
)
def reindex_all(spark, d):
    """Every layer of an index after a refresh: only new and changed texts are parsed, the rest is carried over."""
    old, new = both_versions(spark, d)
    return R.reindex(index_table(spark, old), old, new)


@query(f"SELECT doc_id AS id, 32 AS dim, 1.0 AS norm FROM documents WHERE regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]')")
def embed_and_store(spark, d):
    """Vectors of the texts that have a word; others are skipped."""
    return R.embedded(V.documents(spark, d, heavy=True), 32)


FOUND = "v AS (SELECT p_partkey AS id, p_brand || '/' || p_type AS file, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'warn' WHEN p_type LIKE '%A%' THEN 'ignore' ELSE 'error' END AS severity FROM part WHERE p_size > 40)"


def found_violations(spark, d):
    return C.exceptions(V.symbols(spark, d).filter("start_line > 40").select("id", F.col("file_path").alias("file")), [("Brand#1*/*", "warn"), ("*/*A*", "ignore")])


@query(f"WITH {FOUND} SELECT id, file, severity FROM v")
def rule_exceptions(spark, d):
    return found_violations(spark, d)


@query(f"WITH {FOUND} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings FROM v")
def violation_counts(spark, d):
    return C.counted(found_violations(spark, d), "warn")


@query("SELECT user_id AS key, max(ts) AS last, count(*) AS uses FROM events GROUP BY user_id ORDER BY last DESC, key LIMIT 512")
def embedding_lru(spark, d):
    """The 512 entries of a cache that were used last."""
    used = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last"), F.count("*").alias("uses"))
    return used.orderBy(F.desc("last"), "key").limit(512)


@query("SELECT count(*) AS rows, 1 AS files_after, true AS fewer, true AS freed FROM nation")
def vacuum_report(spark, d):
    """A table of many small files rewritten into few; what that frees."""
    return R.vacuum(table(spark, d, "nation").repartition(16, "n_nationkey", F.rand(1)), 1 << 20)
