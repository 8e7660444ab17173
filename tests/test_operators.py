"""Operators on hand-made frames, with results worked out by hand or by plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import cluster, cochange, context, diff, graph, lists, quality, retrieval, spectral
from skein.sources import files
from skein.streaming import debounce as B


def value(spark, column, **cols):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())) if cols else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([("s1", "s2"), ("s2", "s3"), ("s2", "s4"), ("s5", "s5")], "src string, dst string")


def test_hotspot_score(spark):
    churned = spark.createDataFrame([("app.py", 3, 10, 5, 0.3333), ("config.py", 1, 1, 0, 0.0)], "file string, commit_count long, lines_added long, lines_deleted long, instability double")
    mined = spark.createDataFrame([("app.py", "db.py", 2, 0.8), ("app.py", "ui.py", 2, 0.6)], "file1 string, file2 string, frequency long, coupling double")
    rows = {r.file: r for r in cochange.hotspots(churned, mined, 10).collect()}
    assert rows["app.py"].hotspot_score == 0.2333 and rows["app.py"].coupled_files == 2 and rows["config.py"].hotspot_score == 0


def test_pairs_gap_and_churn(spark):
    rows = [(1, "a", 0, "x", 1, 1), (1, "b", 0, "x", 2, 0), (2, "a", 100, "y", 3, 1), (2, "b", 100, "y", 0, 0), (3, "a", 400, "x", 1, 0), (3, "a", 400, "x", 1, 0), (3, "b", 400, "x", 1, 1)]
    c = spark.createDataFrame(rows, "commit long, file string, t long, author string, added long, deleted long").withColumn("ts", F.timestamp_seconds("t"))
    p = cochange.pairs(c).first()
    assert (p.file1, p.file2, p.frequency, p.coupling, p.avg_gap) == ("a", "b", 3, 1.0, 200.0)
    a = cochange.churn(c).filter("file = 'a'").first()
    assert (a.commit_count, a.lines_added, a.lines_deleted, a.authors_count, a.instability) == (3, 6, 2, 2, 0.25)


def test_rrf(spark):
    one = spark.createDataFrame([("f", "x", 1), ("f", "y", 2)], "factor string, id string, rn int")
    score = {r.id: r.score for r in retrieval.rrf([one, one, one.filter("id = 'x'"), one.limit(0)]).collect()}
    assert score["x"] == pytest.approx(3 / 61) and score["y"] == pytest.approx(2 / 62)


def test_graph_neighbourhood_and_paths(spark, chain):
    start = spark.createDataFrame([("s1",)], "id string")
    assert {r.id for r in graph.neighbourhood(chain, start, 1).collect()} == {"s1", "s2"}
    pairs = spark.createDataFrame([("s1", "s3"), ("s1", "s1"), ("s1", "zz"), ("s3", "s4")], "a string, b string")
    got = {(r.a, r.b): (r.distance, r.path) for r in graph.shortest_paths(chain, pairs).collect()}
    assert got[("s1", "s3")] == (2, ["s1", "s2", "s3"]) and got[("s1", "s1")] == (0, ["s1"]) and got[("s1", "zz")] == (None, None) and got[("s3", "s4")][0] == 2
    assert {r.id for r in graph.bfs(chain, start).filter("level > 0").collect()} == {"s2", "s3", "s4"}
    assert {(r.root, r.reached) for r in graph.closure_sizes(chain).collect()} == {("s1", 3), ("s2", 2), ("s5", 1)}


def reach_of(edges, root):
    seen, front, depth = {root: 0}, {root}, 0
    while front:
        depth += 1
        front = {b for a, b in edges if a in front and b not in seen}
        seen |= dict.fromkeys(front, depth)
    return seen


def test_graphs_against_plain_python(spark):
    rng = np.random.default_rng(6)
    e = [(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, 60, (75, 2))] + [("n01", None), (None, "n02"), ("n03", "n03")]
    df = spark.createDataFrame(e, "src string, dst string")
    edges = {x for x in e if None not in x}
    nodes = {x for p in edges for x in p}
    start = spark.createDataFrame([("n01",), ("n02",), ("gone",), ("n02",)], "id string")
    for most in (None, 2):
        want = {(r, x, n) for r in ("n01", "n02", "gone") for x, n in reach_of(edges, r).items() if most is None or n <= most}
        assert {tuple(r) for r in graph.bfs(df, start, most).collect()} == want
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(graph.ROUNDS):
        given = dict.fromkeys(nodes, 0.0)
        for a, b in edges:
            given[b] += rank[a] / sum(x == a for x, _ in edges)
        rank = {v: 0.15 / len(nodes) + 0.85 * given[v] for v in nodes}
    got = {r.id: r.centrality for r in graph.pagerank(df).collect()}
    assert got == pytest.approx({v: x / max(rank.values()) for v, x in rank.items()})
    every = {v: reach_of(edges, v) for v in nodes}
    sizes = {v: len(every[v]) - 1 + any((x, v) in edges for x in every[v]) for v in nodes}
    assert {r.root: r.reached for r in graph.closure_sizes(df).collect()} == {v: n for v, n in sizes.items() if n}
    nothing = df.limit(0)
    assert graph.pagerank(nothing).count() == graph.strong_components(nothing).count() == graph.closure_sizes(nothing).count() == graph.impact(nothing).count() == 0
    assert sorted(tuple(r) for r in graph.bfs(nothing, start).collect()) == [("gone", "gone", 0), ("n01", "n01", 0), ("n02", "n02", 0)]


def test_shortest_paths_against_plain_python(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2))] + [(100, 101)]
    both = {x for a, b in e for x in ((a, b), (b, a))}
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 42, (40, 2))] + [(0, 100), (100, 101)]
    got = {(r.a, r.b): (r.distance, r.path) for r in graph.shortest_paths(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    for a, b in set(pairs):
        far, path = reach_of(both, b), [a]
        if a not in far:
            assert got[a, b] == (None, None)
            continue
        while path[-1] != b:
            path.append(min(y for x, y in both if x == path[-1] and far.get(y) == far[path[-1]] - 1))
        assert got[a, b] == (far[a], path)


def test_a_long_path_is_found_whole(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(25)], "src long, dst long")
    got = graph.shortest_paths(path, spark.createDataFrame([(0, 25)], "a long, b long")).first()
    assert got.distance == 25 and got.path == list(range(26))


def test_components(spark):
    rng = np.random.default_rng(1)
    e = rng.integers(0, 80, (70, 2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in e], "src long, dst long")
    label = {int(v): int(v) for v in e.ravel()}
    for _ in range(80):
        for a, b in e.tolist():
            label[a] = label[b] = min(label[a], label[b])
    want = {v: x for v, x in label.items() if any(a != b and v in (a, b) for a, b in e.tolist())}
    assert {r.id: r.component for r in graph.weak_components(df).collect()} == want
    reach = {v: {v} for v in label}
    for _ in range(80):
        for a, b in e.tolist():
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    strong = {v: min(w for w in reach[v] if v in reach[w]) for v in label if sum(v in reach[w] for w in reach[v]) > 1}
    assert {r.id: r.component for r in graph.strong_components(df).collect()} == strong


def test_metrics_formulas(spark):
    assert value(spark, S.spof(F.lit(99), F.lit(0.0))) == 1.0 and value(spark, S.instability(F.lit(0), F.lit(0))) == 0.0
    assert value(spark, S.recency(F.lit(0))) == 1.0 and value(spark, S.recency(F.lit(30))) == pytest.approx(np.exp(-1)) and value(spark, S.recency(F.lit(9999))) == 0.01
    assert value(spark, S.usage(F.lit(100))) == 1.0 and value(spark, S.token_estimate(F.lit("x" * 41), F.lit(None))) == 160
    assert value(spark, S.usage_boost(F.lit(0), F.lit(0), F.lit(0))) == -0.02 and value(spark, S.usage_boost(F.lit(300), F.lit(0), F.lit(9))) == 0.15
    assert value(spark, S.health(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 100.0 and value(spark, S.health(F.lit(10), F.lit(5), F.lit(2), F.lit(1))) == 66.0
    assert value(spark, S.module_of(F.lit("src/a/b/__init__.py"))) == "a.b" and value(spark, S.module_of(F.lit("a/c.py"))) == "a.c"
    assert value(spark, S.proximity(F.lit("src/a/x.py"), F.lit("src/b/y.py"))) == 0.5 and value(spark, S.proximity(F.lit("q/a/x.py"), F.lit("q/a/y.py"))) == 0.7
    assert value(spark, S.human_size(F.lit(1536))) == "1.5 KB"
    assert value(spark, S.module_prefixes(F.lit("a.b.c"))) == ["a", "a.b", "a.b.c"]
    with pytest.raises(ValueError):
        S.relevance({}, weights={"semantic": 0.5})


def test_text_functions(spark):
    assert value(spark, T.clean_query(F.lit('find (a OR b) NOT "c*"'))) == "find a b c"
    assert value(spark, T.intent(F.lit("where is the function foo"))) == "find_symbol" and value(spark, T.intent(F.lit("zzz"))) == "unknown" and value(spark, T.intent(F.lit("rename callers"))) == "find_usage"
    assert value(spark, T.redacted(F.lit("token = 'abc' " + "A" * 40))) == "[REDACTED] [REDACTED]"
    assert value(spark, T.identifiers(F.lit("def foo_bar(self): return foo_bar + xy"))) == ["foo_bar", "foo_bar"]
    assert value(spark, T.balanced(F.lit("f(g(x))"))) and not value(spark, T.balanced(F.lit("f((x)")))
    assert value(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert value(spark, V.norm(retrieval.hashed_embedding(F.lit("a b c a"), 16))) == pytest.approx(1, abs=1e-6)


def test_rerank_confidence(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 3.0, 2.0, 0.0, None)] + [("b", 5.0)], "k string, s double")
    got = {r.k: r.confidence for r in retrieval.rerank_confidence(df, "k", "s").collect()}
    want = lambda z: pytest.approx(1 / (1 + np.exp(-z)))
    assert got == {"a": want(0.4 * 3 + 0.3 * 2 + 0.3 * 1), "b": want(5.0)}


def test_hashed_embedding_counts_slots(spark):
    text, dim = "a b c a b_9 b", 16
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    slots = [r.h for r in spark.createDataFrame([(w,) for w in text.split()], "w string").select(F.pmod(F.xxhash64("w"), F.lit(dim)).alias("h")).collect()]
    counts = np.bincount(slots, minlength=dim)
    got = [r.e for r in df.select(retrieval.hashed_embedding(F.col("t"), dim).alias("e")).collect()]
    assert np.allclose(got[0], counts / np.linalg.norm(counts), atol=1e-6) and got[1] == [0.0] * dim and got[2] == [0.0] * dim


def test_knn_graph_and_join_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lists, "LIST_ROWS", 6)  # ten lists, small blocks and chunks
    monkeypatch.setattr(lists, "BLOCK", 4)
    monkeypatch.setattr(lists, "CHUNK", 3)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((40, 8)), np.repeat(rng.standard_normal((2, 8)), 10, 0) + 0.1 * rng.standard_normal((20, 8))])
    odd = [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] * 8), (104, [1.0, 2.0]), (105, [2.0, 4.1]), (None, x[0].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, embedding array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    found = lists.knn_graph(df, df.filter("id < 10 or id >= 100"), 3).collect()
    got = {(r.id, r["rank"]): r.neighbor for r in found}
    assert len(found) == len(got) == 32
    for i in range(10):
        order = [j for j in np.argsort(-np.round(sim[i], 9), kind="stable") if j != i][:3]
        assert [got[i, k + 1] for k in range(3)] == order
    assert got[104, 1] == 105 and got[105, 1] == 104
    pairs = [(r.id_1, r.id_2) for r in lists.similarity_join(df, 0.5).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i in range(60) for j in range(i + 1, 60) if sim[i, j] >= 0.5} | {(104, 105)}
    plan = lists.similarity_join(df, 0.5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert lists.knn_graph(df.limit(0), df.limit(0), 3).count() == 0 and lists.similarity_join(df.limit(0), 0.5).count() == 0


def test_cluster_maths(spark):
    edges = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 0.1)]
    adj = cluster.fuse([(spark.createDataFrame(edges, "src long, dst long, w double"), 1.0)])
    ids = sorted({v for a, b, _ in edges for v in (a, b)})
    at = {v: i for i, v in enumerate(ids)}
    dense = np.zeros((10, 10))
    for a, b, w in edges:
        dense[at[a], at[b]] = dense[at[b], at[a]] = w
    d = dense.sum(1)
    want = np.eye(10) - dense / np.sqrt(d[:, None] * d[None, :])
    for r in cluster.laplacian(adj).collect():
        assert r.value == pytest.approx(want[at[r.src], at[r.dst]])
    sides = {}
    for r in spectral.bipartition(adj, 2, 1).collect():
        sides.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(sorted, sides.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]
    labels = spark.createDataFrame([(v, int(v >= 10)) for v in ids], "id long, cluster int")
    m = dense.sum() / 2
    q = sum((dense[np.ix_(c, c)].sum() / 2 - d[c].sum() ** 2 / (4 * m)) / m for c in (np.arange(5), np.arange(5, 10)))
    assert cluster.modularity(adj, labels).first().q == pytest.approx(q)
    both = cluster.cohesion_coupling(adj, labels).first()
    assert (both.cohesion, both.coupling) == (1.0, pytest.approx(0.1))


def test_diff_upsert_and_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id long, v string")
    assert {r.id: r.change for r in diff.classify(old, new, ["id"], ["v"]).collect()} == {1: "removed", 2: "modified", 3: "unchanged", 4: "added"}
    up = diff.upsert(old.withColumn("t", F.lit(1)), new.withColumn("t", F.lit(1)), ["id"], "t")
    assert {r.id: r.v for r in up.collect()} == {1: "a", 2: "c", 3: None, 4: "d"}
    assert {r.id: r.v for r in diff.merge_fields(old, new, ["id"], ["v"]).collect()} == {1: "a", 2: "c", 3: None}
    removed = spark.createDataFrame([(2,)], "id long")
    assert {r.id for r in diff.cascade(removed, {"x": (old, ["id"])})["x"].collect()} == {1, 3}


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", 1, 50), ("g", 2, 70), ("g", 3, 40), ("g", 4, 10), ("h", 1, 200)], "k string, i long, cost long")
    got = {(r.k, r.i) for r in context.budget_select(df, "k", "i", "cost", 100).collect()}
    assert got == {("g", 1), ("g", 3), ("g", 4)}
    ties = spark.createDataFrame([("g", 1, 500), ("g", 1, 400), ("g", 2, 50)], "k string, i long, cost long")
    assert sorted(tuple(r) for r in context.budget_select(ties, "k", "i", "cost", 600).collect()) == [("g", 1, 400), ("g", 2, 50)]
    kinds = spark.createDataFrame([("g", 1, "a", 10), ("g", 2, "a", 10), ("g", 3, "b", 95), ("g", 4, None, 20), ("g", 5, None, 20)], "k string, i long, kind string, cost long")
    assert {r.i for r in context.diverse_budget(kinds, "k", "i", "kind", "cost", 100, 1).collect()} == {1, 4}
    assert context.diversity(df, "k", "cost", "i", 2).count() == 3


def test_quality_rules(spark):
    paths = spark.createDataFrame([("src/api/x.py",), ("src/db/y.py",), ("z",)], "path string")
    layers = {r.path: r.layer for r in quality.first_match(paths, [("src/api/*", "api"), ("src/*", "core")]).collect()}
    assert layers == {"src/api/x.py": "api", "src/db/y.py": "core", "z": None}
    snaps = spark.createDataFrame([("a", 1, 10), ("a", 2, 15), ("b", 1, 7)], "k string, t int, m long")
    assert {r.k: r.d_m for r in quality.deltas(snaps, "k", "t", ["m"]).collect()} == {"a": 5, "b": None}
    conf, signal = quality.dead_confidence({"referenced": F.lit(False), "abstract": F.lit(True)})
    assert (value(spark, conf), value(spark, signal)) == ("medium", "abstract")


def test_git_log_source(spark, tmp_path):
    sep = "\x1e"
    log = tmp_path / "log.txt"
    log.write_text(f"{'a' * 40}{sep}1700000000{sep}first{sep}x@y.z\n\n5\t1\tquery.py\n-\t-\timg.png\n{'b' * 40}{sep}1700000100{sep}second{sep}q@y.z\n\n0\t0\tquery.py\n3\t0\tb.txt\n")
    rows = files.git_changes(spark, f"file://{log}").collect()
    assert sorted((r.commit[0], r.file, r.added, r.deleted, r.author) for r in rows) == [("a", "query.py", 5, 1, "x@y.z"), ("b", "b.txt", 3, 0, "q@y.z"), ("b", "query.py", 0, 0, "q@y.z")]


def test_source_parsing_and_hierarchy(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "core.py").write_text('import os\nMAX = 1\nclass Base(ABC):\n    """Doc."""\n    def run(self, n: int) -> int:\n        return helper(n)\n\nclass _Child(Base):\n    def run(self):\n        return Base()\n\ndef helper(x):\n    return x\n')
    (tmp_path / "pkg" / "bad.py").write_text("def broken(:\n")
    (tmp_path / "__pycache__").mkdir()
    (tmp_path / "__pycache__" / "c.py").write_text("x = 1\n")
    found = files.parse_python(files.project_files(spark, f"file://{tmp_path}", "*.py")).cache()
    symbols = {r.qualified_name: (r.kind, r.is_public) for r in found.filter("record = 'symbol'").collect()}
    assert symbols == {"MAX": ("constant", True), "Base": ("class", True), "Base.run": ("method", True), "_Child": ("class", False), "_Child.run": ("method", True), "helper": ("function", True)}
    edges = {(r.dst, r.edge_type) for r in found.filter("record = 'edge'").collect()}
    assert edges == {("os", "imports"), ("ABC", "implements"), ("helper", "calls"), ("Base", "inherits"), ("Base", "instantiates")}
    assert found.filter("record = 'failed'").count() == 1
    resolved = files.resolve_names(found.filter("record = 'edge'"), found.filter("record = 'symbol'"))
    assert {r.dst: r.resolution_state for r in resolved.collect()}["helper"] == 1
    classes = spark.createDataFrame([("f", "O", []), ("f", "A", ["O"]), ("f", "B", ["O"]), ("f", "C", ["A", "B"]), ("g", "X", ["Y", "Z"]), ("g", "Y", ["Z"]), ("g", "Z", []), ("g", "W", ["Z", "Y"])], "family string, name string, bases array<string>")
    mro = files.linearise(classes)
    assert {r.name: r.mro for r in mro.collect()} == {"O": ["O"], "A": ["A", "O"], "B": ["B", "O"], "C": ["C", "A", "B", "O"], "X": ["X", "Y", "Z"], "Y": ["Y", "Z"], "Z": ["Z"], "W": None}
    methods = spark.createDataFrame([("O", "m"), ("A", "m"), ("O", "k"), ("C", "own")], "cls string, method string")
    cats = {(r.name, r.method): (r.owner, r.category) for r in files.method_categories(mro, methods).collect()}
    assert cats[("C", "m")] == ("A", "inherited") and cats[("A", "m")] == ("A", "overrides") and cats[("C", "own")] == ("C", "own")


def test_manifests_and_sinks(spark, tmp_path):
    assert files.manifest_dependencies("pyproject.toml", '[project]\ndependencies = ["numpy>=1", "duckdb"]\n') == ["duckdb", "numpy"]
    assert files.manifest_dependencies("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}') == ["a", "b"]
    assert files.manifest_dependencies("requirements.txt", "x==1\n# c\n-r y\nz\n") == ["x", "z"]
    with pytest.raises(ValueError):
        files.load_rules('{"layers": {"a": {}}, "mappings": [{"pattern": "*", "layer": "b"}]}')
    files.append_audit(spark.createDataFrame([("token = 'abcd'", 1)], "params string, n int"), f"file://{tmp_path}/audit", ["params"])
    assert spark.read.schema("params string, n int").json(f"file://{tmp_path}/audit").first().params == "[REDACTED]"
    cache = spark.createDataFrame([("a", 50, 1), ("b", 50, 7200), ("c", 50, 7300)], "key string, size long, t long").withColumn("used", F.timestamp_seconds("t")).drop("t")
    assert {r.key for r in files.lru_evict(cache, 130).collect()} == {"b", "c"} and files.lru_evict(cache, 150).count() == 3
    with pytest.raises(Exception, match="wrong dimension"):
        files.vector_sink(spark.createDataFrame([("x", [1.0])], "id string, embedding array<double>"), 2).collect()


def test_debounce(spark, tmp_path):
    rows = [("a", 0, "created", None), ("a", 100, "modified", None), ("a", 1000, "modified", None), ("b", 0, "created", None), ("b", 10, "deleted", None), ("c", 0, "moved", "d")]
    events = spark.createDataFrame(rows, "path string, t long, op string, dest string").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted((r.path, r.n) for r in B.debounce(events, "path").collect()) == [("a", 1), ("a", 2), ("b", 2), ("c", 1)]
    assert sorted((r.path, r.n) for r in B.debounce_with_cancel(events).collect()) == [("a", 1), ("a", 2), ("d", 1)]
    assert B.filtered(events.withColumn("path", F.concat("path", F.lit(".py"))), (".py",), ("a*",)).count() == 3


def test_streams(spark, tmp_path):
    rows = [("a", 0), ("a", 100), ("b", 5000), ("z", 99_999)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "path string, t long").withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.parquet(f"file://{source}")
    stream = spark.readStream.schema("path string, t long, ts timestamp").parquet(f"file://{source}")
    seen = []
    q = B.for_each_batch(B.debounce(stream, "path", watermark="1 minute"), lambda df, i: seen.extend(map(tuple, df.select("path", "n").collect())), f"file://{tmp_path}/cp", {"availableNow": True})
    q.awaitTermination()
    assert sorted(seen) == [("a", 2), ("b", 1)]  # the last burst is still open: the watermark has not passed it
