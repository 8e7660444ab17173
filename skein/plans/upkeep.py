"""Incremental maintenance, context selection, audits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import context as X
from ..operators import diff as D
from ..operators import quality as Q
from ..session import spread, table
from ..sources import views as V
from ..streaming import debounce as B
from .catalogue import query

OLD_NEW = "WITH o AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)\n"


def versions(spark, d):
    """Two states of the documents: some gone, some new, some altered."""
    docs = V.documents(spark, d).select("id", "text")
    return docs.filter("id % 10 <> 0"), docs.filter("id % 11 <> 0").withColumn("text", F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query(OLD_NEW + "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.text IS NOT DISTINCT FROM n.text THEN 'unchanged' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.id = n.id")
def diff_classes(spark, d):
    old, new = versions(spark, d)
    return D.classify(old, new, ["id"], ["text"])


@query(OLD_NEW + ", u AS (SELECT id, text, 1 AS v FROM o UNION ALL SELECT id, text, 2 FROM n) SELECT id, arg_max(length(text), v) AS n_chars, max(v) AS v FROM u GROUP BY id")
def upsert_latest(spark, d):
    old, new = versions(spark, d)
    merged = D.upsert(old.withColumn("v", F.lit(1)), new.withColumn("v", F.lit(2)), ["id"], "v")
    return merged.select("id", F.length("text").cast("long").alias("n_chars"), "v")


@query(V.with_views("steps", "edges") + "SELECT * FROM edges WHERE src % 10 <> 0 AND dst % 10 <> 0")
def cascade_delete(spark, d):
    e = V.edges(spark, d)
    removed = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).filter("id % 10 = 0").distinct()
    return D.cascade(removed, {"edges": (e, ["src", "dst"])})["edges"].select("src", "dst", "edge_type")


@query(OLD_NEW + "SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = n.id AND sha256(o.text) = sha256(n.text))")
def hash_skip(spark, d):
    old, new = versions(spark, d)
    hashed = lambda df: df.select(F.col("id").alias("path"), F.sha2("text", 256).alias("hash"))
    return D.changed_files(hashed(new), hashed(old)).select(F.col("path").alias("id"))


BURSTS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, burst"""


@query(BURSTS)
def debounce_batch(spark, d):
    return B.debounce(table(spark, d, "events"), "user_id")


@query(BURSTS)
def debounce_stream(spark, d):
    """The same bursts from a file stream that runs until its input ends; those still open then are closed."""
    import uuid

    from ..lineage import shared_dir

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{d}/events.parquet")
    events = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    bursts = B.debounce(events, "user_id", watermark="10 minutes")
    bursts.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(bursts.schema).parquet(f"{path}/out")
    return out.unionByName(B.still_open(source, out, "user_id"))


@query(
    """WITH m AS (SELECT max(ts) AS as_of FROM events), u AS (SELECT user_id, count(*) AS refs, max(ts) AS last FROM events GROUP BY user_id), x AS (SELECT *, date_diff('day', CAST(last AS DATE), CAST(as_of AS DATE)) AS days FROM u, m)
    SELECT user_id, round(least(1, greatest(0, 0.4 * 0 + 0.15 * CASE WHEN days <= 0 THEN 1 ELSE greatest(0.01, least(1, exp(-days / 30.0))) END + 0.15 * ln(1 + refs) / ln(101)
    + 0.1 * 0.8 + 0.1 * CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.2 END + 0.1 * 0.5)), 6) AS relevance FROM x"""
)
def relevance_score(spark, d):
    e = table(spark, d, "events")
    u = e.groupBy("user_id").agg(F.count("*").alias("refs"), F.max("ts").alias("last")).join(F.broadcast(e.agg(F.max("ts").alias("as_of"))))  # one row
    path = F.when(F.col("user_id") % 2 == 0, "a/x.py").otherwise("b/y.py")
    parts = {
        "semantic": F.lit(0.0), "recency": S.recency(F.datediff("as_of", "last")), "usage": S.usage(F.col("refs")), "kind": S.kind_boost(F.lit("method")),
        "proximity": S.proximity(path, F.lit("a/x.py")), "callgraph": F.lit(0.5),
    }
    return u.select("user_id", F.round(S.relevance(parts), 6).alias("relevance"))


@query("SELECT doc_id AS id, source AS file_path, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 3")
def diversity_topk(spark, d):
    return X.diversity(V.documents(spark, d), "file_path", "n_chars", "id", 3).select("id", "file_path", "place")


@query(
    """WITH RECURSIVE c AS (SELECT conv_id, turn, least(150 + length(text) // 4, 1000) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    f(conv_id, i, used, took) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM c UNION ALL
      SELECT c.conv_id, c.i, CASE WHEN used + cost <= 600 THEN used + cost ELSE used END, used + cost <= 600 FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
    SELECT c.conv_id, c.turn, c.cost FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i WHERE took"""
)
def budget_select(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", S.token_estimate(F.col("text"), F.lit(None).cast("string")).alias("cost"))
    return X.budget_select(c, "conv_id", "turn", "cost", 600)


@query("SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, sum(length(text) // 4) >= 0.4 * 1000 AS pressed FROM conversations GROUP BY conv_id")
def context_pressure(spark, d):
    return X.pressure(table(spark, d, "conversations"), "conv_id", "text", 1000)


@query("SELECT conv_id, turn, role, length(text) // 4 AS tokens FROM conversations WHERE length(text) // 4 > CASE role WHEN 'user' THEN 20 WHEN 'assistant' THEN 60 ELSE 40 END")
def token_overbudget(spark, d):
    tokens = F.floor(F.length("text") / 4).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", tokens.alias("tokens")).filter(F.col("tokens") > S.lookup({"user": 20.0, "assistant": 60.0}, F.col("role"), 40.0))


SNAP = V.with_views("snapshots")


@query(SNAP + "SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY codebase_id ORDER BY day DESC) = 1")
def snapshot_latest(spark, d):
    return Q.latest(V.snapshots(spark, d), "codebase_id", "day").drop("place")


@query(SNAP + "SELECT *, row_number() OVER (PARTITION BY codebase_id ORDER BY day DESC) AS place FROM snapshots QUALIFY place <= 5")
def snapshot_history(spark, d):
    return Q.latest(V.snapshots(spark, d), "codebase_id", "day", 5)


@query(SNAP + "SELECT codebase_id, files - lag(files) OVER w AS d_files, round(loc - lag(loc) OVER w, 4) AS d_loc, functions - lag(functions) OVER w AS d_functions FROM snapshots WINDOW w AS (PARTITION BY codebase_id ORDER BY day) QUALIFY row_number() OVER (PARTITION BY codebase_id ORDER BY day DESC) = 1")
def snapshot_delta(spark, d):
    return Q.deltas(V.snapshots(spark, d), "codebase_id", "day", ["files", "loc", "functions"]).withColumn("d_loc", F.round("d_loc", 4))


@query(
    """WITH m AS (SELECT max(ts) AS as_of FROM events), u AS (SELECT user_id AS tool, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, avg(value) AS latency, max(ts) AS last FROM events GROUP BY user_id)
    SELECT tool, calls, errors, round((calls - errors) / calls, 4) AS success_rate, round(latency, 4) AS avg_latency,
    round((calls - errors) / calls * 0.15 + CASE WHEN calls > 50 THEN 0.03 ELSE 0 END + CASE WHEN calls > 200 THEN 0.02 ELSE 0 END - CASE WHEN (floor(epoch(as_of)) - floor(epoch(last))) / 86400 > 7 THEN 0.05 ELSE 0 END, 3) AS boost FROM u, m"""
)
def usage_stats(spark, d):
    calls = V.usage(spark, d)
    return Q.usage_stats(calls)


@query(
    """WITH t AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing,
    (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 6)) AS contradictions, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)) AS dead)
    SELECT *, greatest(0, least(100, round(100 - 50.0 * missing / greatest(total, 1) - least(2 * contradictions, 30) - least(5 * dead, 20), 1))) AS health FROM t"""
)
def audit_report(spark, d):
    docs, known = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    one = lambda df, n: df.agg(F.count("*").alias(n))
    part = table(spark, d, "part").groupBy("p_name").agg(F.count_distinct("p_type").alias("n")).filter("n > 6")
    dead = table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey"), "left_anti")
    # Four one-row aggregates side by side.
    t = one(docs, "total").join(F.broadcast(one(docs.join(known, "doc_id", "left_anti"), "missing"))).join(F.broadcast(one(part, "contradictions"))).join(F.broadcast(one(dead, "dead")))
    return t.withColumn("health", S.health(*(F.col(c) for c in ("total", "missing", "contradictions", "dead"))))


@query("SELECT o_custkey AS file_path, max(o_orderdate) AS last FROM orders GROUP BY o_custkey HAVING date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1998-08-02') > 365")
def stale_files(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file_path")).agg(F.max("o_orderdate").alias("last"))
    return last.filter(F.datediff(F.lit("1998-08-02").cast("date"), "last") > 365)


@query("SELECT p_name AS name, count(DISTINCT p_brand) AS signatures, count(*) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def contradictions(spark, d):
    return Q.contradictions(table(spark, d, "part").withColumnRenamed("p_name", "name"), "name", "p_brand")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def dead_symbols(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("id"))
    return V.symbols(spark, d).select("id").join(used, "id", "left_anti")


@query("SELECT DISTINCT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def dead_code(spark, d):
    """Definitions that no reference names."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'low' WHEN c_mktsegment = 'BUILDING' THEN 'low' WHEN c_acctbal < 0 THEN 'medium' WHEN c_nationkey = 3 THEN 'low' ELSE 'high' END AS confidence,
    CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'referenced' WHEN c_mktsegment = 'BUILDING' THEN 'decorator' WHEN c_acctbal < 0 THEN 'exported' WHEN c_nationkey = 3 THEN 'entry_reachable' END AS signal FROM customer"""
)
def dead_code_confidence(spark, d):
    referenced = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("ref")).distinct()
    c = table(spark, d, "customer").join(referenced, "c_custkey", "left")
    confidence, signal = Q.dead_confidence(
        {"referenced": F.coalesce("ref", F.lit(False)), "decorator": F.col("c_mktsegment") == "BUILDING", "exported": F.col("c_acctbal") < 0, "entry_reachable": F.col("c_nationkey") == 3}
    )
    return c.select(F.col("c_custkey").alias("id"), confidence.alias("confidence"), signal.alias("signal"))


def pii_sql() -> str:
    parts = [f"SELECT doc_id, '{n}' AS pattern, len(m) AS n, m[1:3] AS first FROM (SELECT doc_id, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}') AS m FROM documents) WHERE len(m) > 0" for n, p in T.PII_PATTERNS.items()]
    return " UNION ALL ".join(parts)


@query(pii_sql())
def pii_scan(spark, d):
    return Q.pii_findings(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


REDACT = "text"
for _p in T.AUDIT_SECRETS:
    REDACT = f"regexp_replace({REDACT}, '{_p.replace(chr(39), chr(39) * 2)}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, CASE WHEN length(r) > 500 THEN substr(r, 1, 500) || '...' ELSE r END AS safe FROM (SELECT doc_id, {REDACT} AS r FROM documents)")
def pii_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redacted(F.col("text")).alias("safe"))


TRADE = "imports AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
LAYERED = f"WITH {TRADE}, v AS (SELECT src, dst, a.n_regionkey AS from_layer, b.n_regionkey AS to_layer FROM imports JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE abs(a.n_regionkey - b.n_regionkey) > 1)\n"


def trade(spark, d):
    """Nations that deliver to nations, as imports between modules; the region is the layer."""
    line, supp, orders, cust = (table(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer"))
    met = line.join(supp, line.l_suppkey == supp.s_suppkey).join(orders, line.l_orderkey == orders.o_orderkey).join(cust, orders.o_custkey == cust.c_custkey)
    imports = met.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()
    layers = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("layer"))
    allowed = spark.createDataFrame([(i, j) for i in range(5) for j in range(5) if abs(i - j) <= 1], "from_layer int, to_layer int")
    return imports, layers, allowed


@query(LAYERED + "SELECT * FROM v")
def layer_violations(spark, d):
    return Q.violations(*trade(spark, d))


@query(LAYERED + "SELECT src, dst, 'new' AS change FROM v WHERE src % 3 <> 0 AND src % 4 = 0 UNION ALL SELECT src, dst, 'fixed' FROM v WHERE src % 3 = 0 AND src % 4 <> 0")
def violation_diff(spark, d):
    """Violations new on a branch and fixed there, by two anti-joins."""
    v = Q.violations(*trade(spark, d)).select("src", "dst")
    before, after = v.filter("src % 4 <> 0"), v.filter("src % 3 <> 0")
    new = after.join(before, ["src", "dst"], "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(before.join(after, ["src", "dst"], "left_anti").withColumn("change", F.lit("fixed")))


@query(
    """WITH o AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size % 5 <> 0), n AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size % 7 <> 0)
    SELECT p_brand AS file, p_name AS symbol, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT p_brand, p_name, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)"""
)
def api_surface_diff(spark, d):
    p = table(spark, d, "part")
    side = lambda m: p.filter(F.col("p_size") % m != 0).select(F.col("p_brand").alias("file"), F.col("p_name").alias("symbol")).distinct()
    return D.classify(side(5), side(7), ["file", "symbol"], []).filter("change <> 'unchanged'")


@query(
    V.with_views("commits", "changes", "pairs")
    + """, c AS (SELECT file2 AS file, 'imports' AS reason, 0.75 AS score FROM pairs WHERE file1 = 'Brand#11/PROMO' UNION ALL SELECT file1, 'imported_by', 0.80 FROM pairs WHERE file2 = 'Brand#11/PROMO'
      UNION ALL SELECT DISTINCT p_brand || '/' || p_type, 'sibling', 0.55 FROM part WHERE p_brand = 'Brand#11' AND p_type <> 'PROMO' UNION ALL SELECT DISTINCT p_brand || '/' || p_type, 'same_stem', 0.45 FROM part WHERE p_type = 'PROMO' AND p_brand <> 'Brand#11')
    SELECT file, arg_max(reason, score) AS reason, max(score) AS score FROM c GROUP BY file ORDER BY score DESC, file LIMIT 15"""
)
def related_files(spark, d):
    """Files related to one, by the strongest reason."""
    from ..operators import cochange as C

    me, pairs = "Brand#11/PROMO", C.pairs(V.commits(spark, d))
    files = V.symbols(spark, d).select(F.col("file_path").alias("file")).distinct().filter(F.col("file") != me)
    reason = lambda df, name, score: df.select("file", F.lit(name).alias("reason"), F.lit(score).alias("score"))
    found = reason(pairs.filter(F.col("file1") == me).select(F.col("file2").alias("file")), "imports", 0.75)
    found = found.unionByName(reason(pairs.filter(F.col("file2") == me).select(F.col("file1").alias("file")), "imported_by", 0.80))
    found = found.unionByName(reason(files.filter(S.parent_dir(F.col("file")) == "Brand#11"), "sibling", 0.55))
    found = found.unionByName(reason(files.filter(F.col("file").endswith("/PROMO")), "same_stem", 0.45))
    return found.groupBy("file").agg(F.max_by("reason", "score").alias("reason"), F.max("score").alias("score")).orderBy(F.desc("score"), "file").limit(15)


@query("SELECT lang, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang")
def language_counts(spark, d):
    return V.documents(spark, d).groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"))


@query(V.with_views("steps", "edges") + "SELECT dst AS module, count(*) AS importers FROM (SELECT DISTINCT src, dst FROM edges) GROUP BY dst ORDER BY importers DESC, module LIMIT 10")
def import_popularity(spark, d):
    return V.edges(spark, d).select("src", F.col("dst").alias("module")).distinct().groupBy("module").agg(F.count("*").alias("importers")).orderBy(F.desc("importers"), "module").limit(10)


@query(
    """WITH s AS (SELECT s_nationkey AS root, 'big' AS type, 3 AS w FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey UNION ALL SELECT s_nationkey, 'big', 1 FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey
      UNION ALL SELECT s_nationkey, 'small', 2 FROM supplier WHERE s_acctbal < 1000 GROUP BY s_nationkey),
    t AS (SELECT root, type, sum(w) AS score FROM s GROUP BY root, type)
    SELECT root, arg_max(type, score * 10 + CASE type WHEN 'big' THEN 1 ELSE 0 END) AS type, least(1.0, max(score) / 5) AS confidence FROM t GROUP BY root"""
)
def project_type_score(spark, d):
    """Type of each project by weighted indicators; the first type wins ties."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("root"), "s_acctbal", "s_suppkey")
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    each = s.groupBy("root").agg((3 * has(F.col("s_acctbal") > 5000) + has(F.col("s_suppkey") % 2 == 0)).alias("big"), (2 * has(F.col("s_acctbal") < 1000)).alias("small"))
    each = each.filter("big > 0 or small > 0")
    return each.select("root", F.when(F.col("big") >= F.col("small"), "big").otherwise("small").alias("type"), F.least(F.lit(1.0), F.greatest("big", "small") / 5).alias("confidence"))
