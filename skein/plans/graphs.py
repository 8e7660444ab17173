"""Graph analytics and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import graph as G
from ..operators import spectral as Z
from ..session import table
from ..sources import views as V
from .catalogue import query

GRAPH = V.with_views("steps", "graph")
RECURSIVE = GRAPH.replace("WITH ", "WITH RECURSIVE ", 1)
ROOT = "(SELECT min(src) FROM graph)"
BOTH = "both_ways AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph)"
REACH = "reach(a, b) AS (SELECT src, dst FROM graph UNION SELECT a, dst FROM reach JOIN graph ON b = src)"


def root(edges):
    return edges.agg(F.min("src").alias("id"))


@query(
    V.with_views("steps", "edges")
    + """, p AS (SELECT DISTINCT src, dst FROM edges) SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out
    FROM (SELECT src AS id, 0 AS i, 1 AS o FROM p UNION ALL SELECT dst, 1, 0 FROM p) GROUP BY id"""
)
def fan_in_out(spark, d):
    return G.degrees(V.edges(spark, d))


def pagerank_sql(rounds: int = G.ROUNDS) -> str:
    out = GRAPH + ", nodes AS (SELECT src AS id FROM graph UNION SELECT dst FROM graph), n AS (SELECT count(*) AS n FROM nodes), deg AS (SELECT src, count(*) AS o FROM graph GROUP BY src), r0 AS (SELECT id, 1.0 / n AS r FROM nodes, n)"
    for i in range(1, rounds + 1):
        out += f", r{i} AS MATERIALIZED (SELECT nodes.id, 0.15 / n + 0.85 * coalesce(g, 0) AS r FROM nodes CROSS JOIN n LEFT JOIN (SELECT dst, sum(r / o) AS g FROM graph JOIN r{i - 1} ON src = id JOIN deg USING (src) GROUP BY dst) ON id = dst)"
    return out + f", pr AS (SELECT id, r / (SELECT max(r) FROM r{rounds}) AS centrality FROM r{rounds})\n"


@query(pagerank_sql() + "SELECT id, round(centrality, 6) AS centrality FROM pr")
def pagerank(spark, d):
    return G.pagerank(V.pairs(spark, d)).select("id", F.round("centrality", 6).alias("centrality"))


@query(
    pagerank_sql()
    + """SELECT id, i AS fan_in, o AS fan_out, round(o / (i + o), 4) AS instability, round(least(1, ln(1 + i) * (1 - o / (i + o)) / ln(100)), 4) AS spof_score, round(centrality, 4) AS centrality
    FROM (SELECT id, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o FROM (SELECT src AS id, 0 AS i, 1 AS o FROM graph UNION ALL SELECT dst, 1, 0 FROM graph) GROUP BY id) JOIN pr USING (id)"""
)
def dependency_metrics(spark, d):
    return G.dependency_metrics(V.pairs(spark, d))


@query(pagerank_sql() + "SELECT id, round(centrality, 6) AS centrality FROM pr ORDER BY pr.centrality DESC, id LIMIT 10")
def centrality_hotspots(spark, d):
    return G.pagerank(V.pairs(spark, d)).orderBy(F.desc("centrality"), "id").limit(10).select("id", F.round("centrality", 6).alias("centrality"))


LEVELS = "lv(id, level) AS (SELECT {root}, 0 UNION SELECT dst, level + 1 FROM lv JOIN {edges} ON id = src WHERE level < {depth})"


@query(RECURSIVE + ", " + LEVELS.format(root=ROOT, edges="graph", depth=6) + " SELECT id, min(level) AS level FROM lv GROUP BY id")
def bfs_levels(spark, d):
    e = V.pairs(spark, d)
    return G.bfs(e, root(e), 6).select("id", "level")


@query(RECURSIVE + ", " + LEVELS.format(root=ROOT, edges="graph", depth=3) + " SELECT id, min(level) AS level FROM lv GROUP BY id ORDER BY level, id LIMIT 20")
def neighborhood(spark, d):
    e = V.pairs(spark, d)
    return G.neighbourhood(e, root(e), 3, 20).select("id", "level")


@query(
    RECURSIVE
    + f""", {BOTH}, {LEVELS.format(root="(SELECT max(dst) FROM graph)", edges="both_ways", depth=12)}, far AS (SELECT id, min(level) AS level FROM lv GROUP BY id),
    ends AS (SELECT min(src) AS a, max(dst) AS b FROM graph),
    nearer AS (SELECT src, min(dst) AS dst FROM both_ways JOIN far f ON f.id = src JOIN far t ON t.id = dst WHERE t.level = f.level - 1 GROUP BY src),
    walk(place, path, level) AS (SELECT a, [a], far.level FROM ends JOIN far ON id = a UNION ALL SELECT dst, list_append(path, dst), level - 1 FROM walk JOIN nearer ON src = place WHERE level > 0)
    SELECT a, b, len(path) - 1 AS distance, path FROM ends LEFT JOIN walk ON level = 0"""
)
def shortest_path(spark, d):
    e = V.pairs(spark, d)
    return G.shortest_paths(e, e.agg(F.min("src").alias("a"), F.max("dst").alias("b"))).select("a", "b", "distance", "path")


@query(
    RECURSIVE + f", {BOTH}, r(a, b) AS (SELECT src, dst FROM both_ways UNION SELECT a, dst FROM r JOIN both_ways ON b = src), c AS (SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a)"
    " SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM c"
)
def wcc(spark, d):
    return G.weak_components(V.pairs(spark, d))


@query(RECURSIVE + f", {REACH} SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a")
def scc(spark, d):
    return G.strong_components(V.pairs(spark, d))


@query(V.with_views("steps", "edges") + ", p AS (SELECT DISTINCT src, dst FROM edges) SELECT p.src AS a, p.dst AS b FROM p JOIN p q ON p.src = q.dst AND p.dst = q.src WHERE p.src < p.dst")
def two_cycles(spark, d):
    return G.two_cycles(V.edges(spark, d))


REV = "rev AS (SELECT dst AS src, src AS dst FROM graph)"


@query(RECURSIVE + f", {REV}, " + LEVELS.format(root="(SELECT min(dst) FROM graph)", edges="rev", depth=5) + " SELECT id, min(level) AS level FROM lv GROUP BY id HAVING min(level) > 0")
def transitive_dependents(spark, d):
    e = V.pairs(spark, d)
    return G.bfs(G.reverse(e), e.agg(F.min("dst").alias("id")), 5).filter("level > 0").select("id", "level")


@query(
    RECURSIVE
    + f""", {REV}, lv(root, id, level) AS (SELECT id, id, 0 FROM (SELECT src AS id FROM graph UNION SELECT dst FROM graph) UNION SELECT root, dst, level + 1 FROM lv JOIN rev ON id = src WHERE level < 1),
    {REACH}, up AS (SELECT b AS root, count(*) FILTER (a <> b) AS every FROM reach GROUP BY b), one AS (SELECT root, count(DISTINCT id) FILTER (level = 1) AS direct FROM lv GROUP BY root)
    SELECT root, direct, coalesce(every, 0) - direct AS transitive, (SELECT count(*) FROM graph WHERE src = root) AS fan_out, CASE WHEN direct >= 10 THEN 'high' WHEN direct >= 3 THEN 'medium' WHEN direct >= 1 THEN 'low' ELSE 'none' END AS risk FROM one LEFT JOIN up USING (root)"""
)
def impact_analysis(spark, d):
    return G.impact(V.pairs(spark, d))


AXIS = V.with_views("steps", "edges").replace("WITH ", "WITH RECURSIVE ", 1)
AXES = {"call_graph": ("purchase", 0.75), "class_hierarchy": ("view", 0.9), "import_graph": ("error", 0.95)}


def blast_sql(depth: int = 5) -> str:
    """One recursion for each axis, then the rules of the summary."""
    out, rows = AXIS, []
    for i, (name, (kind, c)) in enumerate(sorted(AXES.items())):
        out += f", e{i} AS (SELECT DISTINCT dst AS src, src AS dst FROM edges WHERE edge_type = '{kind}'), l{i}(id, level) AS (SELECT 5, 0 UNION SELECT dst, level + 1 FROM l{i} JOIN e{i} ON id = src WHERE level < {depth}), m{i} AS (SELECT id FROM l{i} GROUP BY id HAVING min(level) > 0)"
        rows.append(f"SELECT '{name}' AS axis, {c} AS c, (SELECT count(*) FROM m{i}) AS n")
    return (
        out
        + f", a AS ({' UNION ALL '.join(rows)}), r AS (SELECT *, CASE WHEN n >= 10 THEN 3 WHEN n >= 3 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END AS r FROM a) SELECT 5 AS root, (SELECT count(*) FROM ({' UNION '.join(f'SELECT id FROM m{i}' for i in range(len(rows)))})) AS affected,"
        " round(sum((n + 1) * c) / sum(n + 1), 2) AS confidence, CASE CASE WHEN max(r) = 1 AND count(*) FILTER (r = 1) >= 2 THEN 2 ELSE max(r) END WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS risk,"
        " coalesce(list(axis ORDER BY axis) FILTER (n > 0), []) AS reasons FROM r"
    )


@query(blast_sql())
def blast_radius(spark, d):
    """What three kinds of edges reach backwards from one node."""
    e = V.edges(spark, d)
    axes = {name: (e.filter(F.col("edge_type") == kind).select("src", "dst"), c) for name, (kind, c) in AXES.items()}
    return G.blast_radius(axes, spark.createDataFrame([(5,)], "id long"))


@query(
    blast_sql().split(", a AS (")[0]
    + ", f AS (" + " UNION ALL ".join(f"SELECT id, '{name}' AS axis FROM m{i}" for i, name in enumerate(sorted(AXES))) + ") SELECT 5 AS root, id, list(axis ORDER BY axis) AS reasons FROM f GROUP BY id"
)
def blast_reasons(spark, d):
    """Each thing that the root affects, with the kinds of edges that reach it."""
    e = V.edges(spark, d)
    axes = {name: (e.filter(F.col("edge_type") == kind).select("src", "dst"), c) for name, (kind, c) in AXES.items()}
    return G.reached_by(axes, spark.createDataFrame([(5,)], "id long"), 5).groupBy("root", "id").agg(F.array_sort(F.collect_set("axis")).alias("reasons"))


@query(V.with_views("steps", "edges") + "SELECT 'in' AS way, src AS other, count(*) AS n FROM edges WHERE dst = 9 GROUP BY src UNION ALL SELECT 'out', dst, count(*) FROM edges WHERE src = 9 GROUP BY dst")
def module_fan_listing(spark, d):
    e = V.edges(spark, d)
    one = e.filter("dst = 9").groupBy(F.lit("in").alias("way"), F.col("src").alias("other")).agg(F.count("*").alias("n"))
    return one.unionByName(e.filter("src = 9").groupBy(F.lit("out").alias("way"), F.col("dst").alias("other")).agg(F.count("*").alias("n")))


@query(V.with_views("steps", "edges") + "SELECT src, list_sort(list(DISTINCT dst)) AS external FROM edges WHERE dst NOT IN (SELECT s_suppkey FROM supplier) AND dst NOT IN (SELECT n_nationkey FROM nation) GROUP BY src")
def external_deps(spark, d):
    """Targets that are neither known symbols nor of the standard set, listed per source."""
    e = V.edges(spark, d).select("src", "dst")
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"))
    standard = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("dst"))
    return e.join(own, "dst", "left_anti").join(standard, "dst", "left_anti").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("external"))


ADJ = (
    V.with_views("steps", "edges")
    + """, typed AS (SELECT src, dst, max(CASE edge_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.7 ELSE 0.5 END) AS w FROM edges GROUP BY src, dst),
    adj AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM typed UNION ALL SELECT dst, src, w FROM typed) GROUP BY src, dst),
    deg AS (SELECT src AS id, sum(w) AS d FROM adj GROUP BY src), lab AS (SELECT id, id % 5 AS cluster FROM deg)
"""
)


def adjacency(spark, d):
    weight = F.when(F.col("edge_type") == "click", 1.0).when(F.col("edge_type") == "view", 0.7).otherwise(0.5)
    typed = V.edges(spark, d).groupBy("src", "dst").agg(F.max(weight).alias("w"))
    return K.fuse([(typed, 1.0)])


def labels(spark, d):
    return adjacency(spark, d).select(F.col("src").alias("id")).distinct().withColumn("cluster", F.col("id") % 5)


@query(ADJ + "SELECT src, dst, round(w, 6) AS w FROM adj")
def adjacency_fused(spark, d):
    return adjacency(spark, d).withColumn("w", F.round("w", 6))


@query(ADJ + "SELECT src, dst, round(-w / sqrt(a.d * b.d), 9) AS value FROM adj JOIN deg a ON src = a.id JOIN deg b ON dst = b.id UNION ALL SELECT id, id, 1.0 FROM deg")
def normalized_laplacian(spark, d):
    return K.laplacian(adjacency(spark, d)).withColumn("value", F.round("value", 9))


@query(
    ADJ
    + """, m AS (SELECT sum(w) / 2 AS m FROM adj), c AS (SELECT a.cluster, sum(w) AS d, sum(CASE WHEN a.cluster = b.cluster THEN w ELSE 0 END) AS i FROM adj JOIN lab a ON src = a.id JOIN lab b ON dst = b.id GROUP BY a.cluster)
    SELECT round(sum((i / 2 - d * d / (4 * m)) / m), 6) AS q FROM c, m"""
)
def modularity(spark, d):
    return K.modularity(adjacency(spark, d), labels(spark, d)).select(F.round("q", 6).alias("q"))


@query(
    ADJ
    + "SELECT round(avg(w) FILTER (a.cluster = b.cluster), 6) AS cohesion, round(avg(w) FILTER (a.cluster <> b.cluster), 6) AS coupling FROM adj JOIN lab a ON src = a.id JOIN lab b ON dst = b.id WHERE src < dst"
)
def cohesion_coupling(spark, d):
    return K.cohesion_coupling(adjacency(spark, d), labels(spark, d)).select(F.round("cohesion", 6).alias("cohesion"), F.round("coupling", 6).alias("coupling"))


@query(GRAPH + "SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT src FROM graph UNION SELECT dst FROM graph)")
def isolated_nodes(spark, d):
    nodes = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return K.isolated(nodes, K.fuse([(V.pairs(spark, d).withColumn("w", F.lit(1.0)), 1.0)]))


@query("SELECT a.p_partkey AS src, b.p_partkey AS dst, 0.15 AS w FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def proximity_pairs(spark, d):
    s = V.symbols(spark, d).select("id", F.concat("file_path", F.lit("/x")).alias("path"))
    return K.proximity_edges(s)


@query("SELECT p_brand || '.' || p_type AS src, p_brand AS dst, 0.3 AS w FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def containment_edges(spark, d):
    p = table(spark, d, "part")
    modules = p.select(F.concat_ws(".", "p_brand", "p_type").alias("id")).unionByName(p.select(F.col("p_brand").alias("id"))).distinct()
    return K.containment_edges(modules)


@query()
def fiedler_partition(spark, d):
    """Spectral bipartition of the graph; no SQL (an eigenvector)."""
    return Z.bipartition(K.fuse([(V.pairs(spark, d).withColumn("w", F.lit(1.0)), 1.0)]), min_size=5)
