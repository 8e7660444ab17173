"""What reviews found: one small test each."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skein import registry
from skein.functions import scalars as S
from skein.operators import cluster as K
from skein.operators import cochange as C
from skein.operators import graph as G
from skein.operators import lists as L
from skein.plans import deeper
from skein.sources import files as SRC
from skein.sources import views
from skein.streaming import debounce as B


def test_sizes_are_plain_and_round_half_to_even(spark):
    n = [0, 5, 1023, 1031885, 1024**2, 1280, 1792, 1024**2 - 1, 1024**4]
    shown = lambda most: [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(S.human_size(F.col("n"), most)).collect()]
    assert shown("TB") == ["0.0 B", "5.0 B", "1023.0 B", "1007.7 KB", "1.0 MB", "1.2 KB", "1.8 KB", "1024.0 KB", "1.0 TB"]
    assert shown("MB")[-1] == "1048576.0 MB"


def join_rows(df):
    """The most rows that a join of ``df`` makes."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from walk(p.executedPlan())
        elif name.endswith("QueryStage"):
            yield from walk(p.plan())
        else:
            if "Join" in name:
                yield p.metrics().get("numOutputRows").get().value()
            for i in range(p.children().size()):
                yield from walk(p.children().apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def parts(spark, folder, n):
    """A table of ``n`` parts of one name and one file, and as many suppliers."""
    row = [F.lit("x").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")]
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), *row).write.parquet(f"{folder}/part.parquet")
    spark.range(1, n + 1).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")


def test_names_of_many_symbols_do_not_meet_pairwise(spark, tmp_path):
    parts(spark, tmp_path, 500)
    found = registry.queries()["name_resolution"](spark, str(tmp_path))
    assert {tuple(r)[1:] for r in found.collect()} == {(1, 1, 500)} and join_rows(found) == 500


def plan(df):
    return df._jdf.queryExecution().toString()


def test_paths_of_imports_are_not_broadcast(spark):
    for name in ("import_resolution", "related_importers"):
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)


def test_parsed_names_are_not_broadcast_and_do_not_meet_pairwise(spark):
    rows = spark.range(300).select(F.format_string("f%d.py", "id").alias("path"), F.format_string("f%d.py:x", "id").alias("id"), F.lit("x").alias("name"))
    edges = rows.select(F.concat("path", F.when(F.col("id") < "f2", F.lit("")).otherwise(F.lit("z"))).alias("path"), F.col("id").alias("src"), F.lit("x").alias("dst"), F.lit("calls").alias("edge_type"))
    found = SRC.resolve_names(edges, rows)
    assert "BroadcastHashJoin" not in plan(found) and join_rows(found) == 300
    for r in found.collect():
        assert r.target_id == (r.src if r.src < "f2" else "f0.py:x")


def test_sources_are_parsed_by_all_cores(spark):
    for name in ("parsed_symbols", "parsed_edges"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
    assert deeper.python_tree(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_files_of_commits_meet_once_and_nameless_ones_do_not(spark):
    rows = [(1, "a", 1), (1, "b", 1), (1, "b", 1), (1, None, 1), (2, "a", 2), (2, "b", 2), (2, "c", None), (None, "a", 3), (None, "b", 3)]
    log = spark.createDataFrame(rows, "commit long, file string, author long").select("*", F.timestamp_seconds("commit").alias("ts"), F.lit(1).cast("long").alias("added"), F.lit(1).cast("long").alias("deleted"))
    found = C.pairs(log)
    assert {(r.file1, r.file2): (r.frequency, r.n1, r.n2) for r in found.collect()} == {("a", "b"): (2, 3, 3), ("a", "c"): (1, 3, 1), ("b", "c"): (1, 3, 1)}
    for tasks in (None, 3):
        per = {r.file: tuple(r)[1:5] for r in C.churn(log, tasks).collect()}
        assert per == {"a": (2, 3, 3, 3), "b": (2, 4, 4, 3), "c": (1, 1, 1, 0), None: (1, 1, 1, 1)}


def test_tasks_of_commits_grow_with_the_changes(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    log = views.commits(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert log.rdd.getNumPartitions() >= n / 100 > 8 and "BroadcastHashJoin" not in plan(log)


def test_batches_of_vectors_stay_small(spark):
    rows = spark.range(1, 3001).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k)).alias("embedding"))
    used = L.usable(rows, "id", "embedding").coalesce(1)
    lists = L.Lists(used)
    dealt = lists.dealt(used)
    whole = used.toArrow().combine_chunks().to_batches()[0]
    assert whole.num_rows == 3000 and [len(at) for _, at, _ in lists.parts(whole)] == [L.STEP] * (3000 // L.STEP) + [3000 % L.STEP]
    lists.measured(dealt)
    asked = lists.asked(used.withColumn("least", F.lit(-1.0)))
    assert asked.count() == 3000 * len(lists.radius)


def test_lists_are_visited_onward_and_nothing_is_lost(spark):
    v = np.random.default_rng(5).normal(size=(1500, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sim = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(sim >= 0.9), strict=True) if i < j}
    assert {(r.id_1, r.id_2) for r in L.similarity_join(df, 0.9).collect()} == want and len(want) > 500
    rows = L.usable(df, "id", "embedding").withColumn("least", F.lit(0.5))
    lists = L.Lists(rows)
    lists.measured(lists.dealt(rows))
    assert lists.asked(rows, onward=True).count() < 0.7 * lists.asked(rows).count()


def test_pairs_of_one_directory_fill_many_tasks(spark):
    found = K.proximity_edges(spark.range(200).select("id", F.lit("d/x").alias("path")))
    assert found.count() == 200 * 199 // 2 and "salt" in plan(found) and "BroadcastHashJoin" not in plan(found)


def test_symbols_of_two_files_fill_many_tasks(spark):
    symbols = spark.range(60).select(F.when(F.col("id") < 20, "a").otherwise("b").alias("file_path"), "id")
    found = C.symbol_pairs(spark.createDataFrame([("a", "b", 7)], "file1 string, file2 string, frequency long"), symbols)
    assert found.count() == found.distinct().count() == 20 * 40
    assert "SortMergeJoin [file2" in plan(found) and "salt" in plan(found).split("SortMergeJoin [file2", 1)[1][:60]


def test_the_last_step_from_all_nodes_travels_as_lists(spark, monkeypatch):
    monkeypatch.setattr(G, "LIST", 7)
    rng = np.random.default_rng(8)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 60, (400, 2))}
    frame = spark.createDataFrame(sorted(edges) + [(3, None), (None, 4)], "src long, dst long").filter("src is not null and dst is not null")
    for depth in (1, 2, 3):
        found, want = G.within(frame, G.nodes(frame), depth), G.bfs(frame, G.nodes(frame), depth)
        assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in want.collect())
    chain = registry.queries()["dependency_chain"](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in plan(chain) and "LeftAnti" not in plan(chain)


class Handle:
    """One state's store that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, *_):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_many_paths_share_one_state_of_a_cancelling_stream():
    bursts, held = B.Bursts(60), Handle()
    bursts.init(held)
    second = 1_000_000
    rows = [(f"p{i}", (i % 7) * second, False) for i in range(1000)] + [(f"p{i}", 30 * second, i % 2 == 0) for i in range(1000)] + [("late", 500 * second, False), ("same", 5 * second, False), ("same", 5 * second, True)]
    list(bursts.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key", "at", "deleted"])]), Clock(0)))
    assert held.calls <= 3 and held.timers == [65_000]
    out = pd.concat(bursts.handleExpiredTimer((0,), Clock(90_000), None))
    got = {(r.key, r.last // second, r.n) for r in out.itertuples()}
    assert got == {(f"p{i}", 30, 2) for i in range(1, 1000, 2)} | {("same", 5, 1)}
    assert held.timers == [560_000] and held.calls <= 6
    assert list(bursts.handleExpiredTimer((0,), Clock(560_000), None))[0].values.tolist() == [["late", 500 * second, 1]] and held.value is None and not held.timers


def test_vectors_of_a_join_travel_once_a_block_and_pairs_not_at_all(spark, monkeypatch):
    v = np.random.default_rng(6).normal(size=(2000, 6))
    v[500:1300] = v[500] + 0.01 * v[500:1300]  # one long list
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sim = unit @ unit.T
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(3000 + i, [1.0, float(i)]) for i in range(40)], "id long, embedding array<double>")
    monkeypatch.setattr(L, "BLOCK", 50)
    monkeypatch.setattr(L, "JOIN_ROWS", 150)
    for threshold in (0.5, 0.95):
        want = {(i, j) for i, j in zip(*np.nonzero(sim >= threshold), strict=True) if i < j}
        found = L.similarity_join(df, threshold)
        got = [(r.id_1, r.id_2) for r in found.collect()]
        assert {p for p in got if p[1] < 3000} == want and len(got) == len(set(got))
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FlatMapGroupsInArrow") == 1 and "Aggregate" not in plan
    twice = df.unionByName(df.filter("id in (3, 700)").withColumn("id", F.lit(3)))
    got = [(r.id_1, r.id_2) for r in L.similarity_join(twice, 0.5).collect()]
    assert len(got) == len(set(got))


def test_mirrored_pairs_are_fused_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.7), (4, 4, 1.0)], "src long, dst long, w double")
    assert sorted(map(tuple, K.mirrored(pairs, 0.5).collect())) == sorted(map(tuple, K.fuse([(pairs, 0.5)]).collect()))


def test_modules_of_small_directories_travel_once(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 16)
    sizes = {"a": 1, "b": 5, "c": 16, "d": 90}
    rows = [(100 * k + i, f"{d}/x") for k, (d, n) in enumerate(sizes.items()) for i in range(n)]
    want = {(a, b) for a, p in rows for b, q in rows if p == q and a < b}
    found = K.proximity_edges(spark.createDataFrame([*rows, (None, "d/x")], "id long, path string"))
    got = [(r.src, r.dst) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r.w for r in found.collect()} == {0.15}
    assert "explode([0,1,2" not in plan(found).replace(" ", "")  # no copy a salt


def test_frequencies_leave_names_and_times_behind(spark):
    rng = np.random.default_rng(10)
    files = [(k, f"f{k % 9}") for k in range(40)] + [(None, "f1"), (50, None)]
    lines = [(int(a), int(b)) for a, b in rng.integers(0, 45, (400, 2))] + [(None, 1), (None, 2), (1, None)]
    name, known = dict(files), range(30)
    held = {}
    for c, k in lines:
        if c in known and k is not None and name.get(k):
            held.setdefault(c, set()).add(name[k])
    want = {}
    for f in held.values():
        for p in ((a, b) for a in f for b in f if a < b):
            want[p] = want.get(p, 0) + 1
    frames = [spark.createDataFrame(lines, "commit long, key long"), spark.createDataFrame(files, "key long, file string"), spark.createDataFrame([(c,) for c in known], "commit long")]
    found = C.frequencies(*frames, 4)
    assert {(r.file1, r.file2): r.frequency for r in found.collect()} == want and len(want) == 36


def test_cochange_symbol_pairs_counts_without_times(spark, monkeypatch):
    monkeypatch.setattr(C, "pairs", None)
    assert registry.queries()["cochange_symbol_pairs"](spark, "/root/testdata/sf0.001").count() > 0
