"""Cycles, module graphs, near names, approximate neighbours, landmarks, logs and dead code against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import cluster, deadcode, descent, graph, modules, names
from skein.sources import gitlog


def test_cycles_against_trying_every_walk(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(g, g + 9), rng.randrange(g, g + 9)) for g in (0, 20, 40) for _ in range(14)} | {(i, i + 1) for i in range(60, 70)} | {(70, 60), (3, 25), (80, 80)}
    got = {r.component: (r.length, r.severity, r.cycle) for r in graph.cycles(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    plain = {(a, b) for a, b in edges if a != b}
    reach = {v: {v} for e in plain for v in e}
    for _ in reach:
        for a, b in plain:
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    want = {}
    for v in reach:
        comp = {w for w in reach[v] if v in reach[w]}
        if len(comp) > 1 and v == min(comp):
            walks = [[v]]
            while v not in (ends := {w[-1] for w in walks if len(w) > 1}):
                walks = [[*w, b] for w in walks for a, b in sorted(plain) if a == w[-1] and b in comp]
                ends = {w[-1] for w in walks}
                walks = walks if v in ends else list({w[-1]: w for w in reversed(walks)}.values())
                walks.sort()
            best = min(w for w in walks if w[-1] == v)[:-1]
            want[v] = (len(best), "high" if len(best) <= 3 else "medium", best)
    assert got == want and want[60][0] == 11
    assert graph.cycles(spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_near_names_lose_none(spark, most):
    rng = random.Random(most)
    words = ["", "a", "ab", "ba", "abc", "aaaa", "aaaaa", *("".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(40))]
    words += ["".join(rng.choice("abcdefg") for _ in range(12)) for _ in range(30)]
    words += [w[:3] + "x" + w[4:] for w in words if len(w) > 8]
    df = spark.createDataFrame([(w,) for w in words] + [(None,), (words[-1],)], "name string")
    want = {(a, b, edits(a, b)) for a, b in itertools.combinations(sorted(set(words)), 2) if edits(a, b) <= most}
    assert {tuple(r) for r in names.near_names(df, most).collect()} == want


def test_descent_finds_nine_of_ten_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 1500)] + 0.6 * rng.normal(size=(1500, 16)), rng.normal(size=(300, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16)], "id long, embedding array<double>")
    got = {}
    for r in descent.nearest(df, 10).collect():
        got.setdefault(r.id, {})[r.neighbor] = r.similarity
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    exact = np.argsort(-sim, axis=1)[:, :10]
    hits = sum(len(set(exact[i]) & got[i].keys()) for i in range(len(x)))
    assert set(got) == set(range(len(x))) and all(len(v) == 10 for v in got.values())
    assert hits / (10 * len(x)) >= 0.9
    assert all(s == pytest.approx(sim[i, j], abs=1e-6) for i, v in list(got.items())[:50] for j, s in v.items())
    few = descent.nearest(df.filter("id < 4"), 10).collect()
    assert {(r.id, r.neighbor) for r in few} == {(a, b) for a in range(4) for b in range(4) if a != b}
    assert descent.nearest(df.limit(0), 3).count() == descent.nearest(df.filter("id = 1"), 3).count() == 0


def test_nystrom_signs_agree_with_the_exact_vector(spark):
    rng = np.random.default_rng(3)
    n, side = 900, np.arange(900) < 400
    w = np.where(side[:, None] == side, 0.9, 0.1) * (0.5 + rng.random((n, n)))
    w = np.triu(w * (rng.random((n, n)) < 0.15), 1)
    a, b = np.nonzero(w)
    df = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(a, b, strict=True)], "src long, dst long, w double")
    got = {r.id: r.value for r in cluster.nystrom_vector(cluster.fuse([(df, 1.0)])).collect()}
    full = w + w.T
    d = full.sum(1)
    exact = np.linalg.eigh(np.eye(n) - full / np.sqrt(d[:, None] * d))[1][:, 1]
    same = np.mean([(got[i] > 0) == (exact[i] > 0) for i in range(n)])
    assert max(same, 1 - same) >= 0.9 and len(got) == n
    assert cluster.nystrom_vector(cluster.fuse([(df.limit(0), 1.0)])).count() == 0


def test_longest_suffixes_and_fused_graph(spark):
    ids = ["a", "a.b", "a.b.c", "x.b.c", "y.d", "y.e"]
    mods = spark.createDataFrame([(i,) for i in ids], "id string")
    imports = spark.createDataFrame([("a", "q.b.c"), ("a", "x.b.c"), ("y.d", "b"), ("y.d", "none.at.all"), ("y.e", "a.b.zzz"), ("y.e", "y.q"), ("x.b.c", "os.path")], "src string, name string")
    got = {(r.src, r.name): (r.target, r.matched) for r in modules.longest_suffix(imports, mods).collect()}
    assert got == {("a", "q.b.c"): ("a.b.c", 2), ("a", "x.b.c"): ("x.b.c", 3), ("y.d", "b"): ("a.b", 1)}
    w = {(r.src, r.dst): round(r.w, 6) for r in modules.fused_graph(imports, mods, known=("os",)).collect()}
    assert w["y.e", "a"] == w["a", "y.e"] == 1.0 and w["y.d", "y.e"] == pytest.approx(0.3 + 0.3)  # of one directory, and imported in part
    assert w["a", "x.b.c"] == 0.3 and w["a.b", "a.b.c"] == w["a", "a.b"] == 0.6 and ("x.b.c", "y.d") not in w


def test_logs_in_ranges_of_any_size(spark, tmp_path):
    mark, want, text = "\x1e", [], ""
    rng = random.Random(2)
    for i in range(60):
        key = f"{rng.getrandbits(160):040x}"
        text += f"{key}{mark}{1000 + i}{mark}Subject\t with tab {i}{mark}who{i % 3}@x\n\n"
        for j in range(rng.randint(0, 5)):
            name = f"dir {j}/é{i}.py" if j % 2 else f"b{j}.bin"
            binary = rng.random() < 0.2
            text += f"-\t-\t{name}\n" if binary else f"{i}\t{j}\t{name}\n"
            want += [] if binary else [(key, 1000 + i, f"who{i % 3}@x", name, i, j)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.txt").write_text(text)
    (tmp_path / "log" / "empty.txt").write_text("")
    gitlog.register(spark)
    rows = lambda df: sorted((r.commit, int(r.ts.timestamp()), r.author, r.file, r.added, r.deleted) for r in df.collect())
    for size in (1 << 20, 100, 37):
        assert rows(spark.read.format("gitlog").option("rangebytes", size).load(f"{tmp_path}/log")) == sorted(want)
    only = spark.read.format("gitlog").option("suffix", ".py").load(f"file://{tmp_path}/log")
    assert rows(only) == sorted(w for w in want if w[3].endswith(".py"))

    def run():
        stream = spark.readStream.format("gitlog").load(f"{tmp_path}/log")
        stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(f"file://{tmp_path}/out"))

    assert run() == sorted(want)
    with open(tmp_path / "log" / "one.txt", "a") as f:
        f.write(f"{'0' * 40}{mark}5{mark}s{mark}new\n\n1\t2\tlast.py\n")
    assert run() == sorted([*want, ("0" * 40, 5, "new", "last.py", 1, 2)])


def test_dead_code_signals(spark):
    files = [
        ("src/main.py", "import lib\ndef run():\n    obj.used_far()\nrun()\nlib.top()\n"),
        ("src/lib.py", "__all__ = ['shown']\ndef shown(): pass\ndef top():\n    def inner(): pass\n    return deeper.chained()\nclass K:\n    def used_far(self): pass\n    def chained(self): pass\n    @app.get('/x')\n    def web(self): pass\n    def lost(self): pass\n"),
        ("src/test_main.py", "def test_it(): pass\n"),
        ("src/broken.py", "def broken(:\n"),
        ("src/none.py", None),
    ]
    got = {(r.owner, r.name): (r.confidence, r.signal) for r in deadcode.dead_code(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        ("", "run"): ("low", "referenced"), ("", "shown"): ("medium", "exported"), ("", "top"): ("low", "entry_reachable"), ("", "inner"): ("high", None), ("", "K"): ("high", None),
        ("K", "used_far"): ("low", "entry_reachable"), ("K", "chained"): ("low", "entry_reachable"), ("K", "web"): ("low", "decorator"), ("K", "lost"): ("high", None), ("", "test_it"): ("high", None),
    }
    assert deadcode.dead_code(spark.createDataFrame(files, "path string, text string").limit(0)).count() == 0


def test_two_million_edges(spark):
    """Known answers on a graph that no single task should hold: rings of six that point at the ring before them."""
    rings = 285_000
    ring, place = F.expr("id div 7"), F.expr("id % 7")
    e = spark.range(rings * 7).select((ring * 10 + F.when(place == 6, 0).otherwise(place)).alias("src"), F.when(place == 6, F.when(ring % 1000 == 0, ring * 10 + 3).otherwise((ring - 1) * 10)).otherwise(ring * 10 + (place + 1) % 6).alias("dst"))
    found = graph.weak_components(e).groupBy("component").agg(F.max("size").alias("size"))
    assert found.count() == 285 and found.filter("size <> 6000").count() == 0
    start = spark.createDataFrame([(9990,)], "id long")
    levels = graph.bfs(e, start, 3)
    assert levels.count() == 1 + 2 + 3 + 4  # each step along the ring, and to the ring before
    rank = graph.pagerank(e.repartition(8), rounds=2)
    assert rank.count() == rings * 6 and rank.agg(F.max("centrality")).first()[0] == 1.0


def test_descent_moves_each_vector_few_times(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))[rng.integers(0, 60, 3000)] + 0.5 * rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    changed, rounds = [], descent.written
    monkeypatch.setattr(descent, "written", lambda rows, label: changed.append(out := rounds(rows, label)) or out)
    assert descent.nearest(df, 10).count() == 30000
    new = [now.filter("new").count() for now, _, _ in changed]
    assert len(new) <= 6 and all(b < a / 2 for a, b in zip(new, new[1:], strict=False))  # a start by chance leaves most to change
