"""The inverted index against plain Python, and what a search reads."""

import math
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.lineage import shared_dir
from skein.operators import textindex as I


def fresh(spark):
    return I.TextIndex(spark, f"{shared_dir(spark)}/index-test-{uuid.uuid4().hex}")


def bm25(texts, terms):
    words = {i: (t or "").lower().split() for i, t in texts}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    out = Counter()
    for t in set(terms):
        df = sum(t in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(t):
                out[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    common = [f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(4000)]
    return [(i, None if i % 97 == 0 else " ".join(rng.choice(common) for _ in range(rng.randint(0, 60)))) for i in range(600)]


@pytest.mark.parametrize("chunk", [1024, 16])
def test_segments_find_what_a_scan_finds(spark, texts, chunk, monkeypatch):
    monkeypatch.setattr(I, "CHUNK", chunk)
    index = fresh(spark)
    for k in range(2):
        index.append(spark.createDataFrame(texts[k::2], "id long, text string"), f"part{k}")
    index.append(spark.createDataFrame(texts[1::2], "id long, text string"), "part1")  # written again
    held = {i: set((t or "").split()) for i, t in texts}
    for terms in (["w1", "w2"], ["w3", "w400", "w7"], ["w1"], ["absent", "w1"], ["W5", "w5"]):
        low = {t.lower() for t in terms}
        assert {r.id for r in index.holding(terms).collect()} == {i for i, w in held.items() if low <= w}
        assert {r.id for r in index.holding(terms, False).collect()} == {i for i, w in held.items() if low & w}
        want = sorted(((-round(s, 9), i) for i, s in bm25(texts, low).items()))
        for k in (1, 10, 10_000):
            got = [(r.id, r.score) for r in index.top(terms, k).collect()]
            assert [(i, pytest.approx(-s)) for s, i in want[:k]] == got
    assert index.merged(spark.createDataFrame(texts, "id long, text string")).segments()[0].endswith("part1") and len(index.segments()) == 1
    assert {r.id for r in index.holding(["w1", "w2"]).collect()} == {i for i, w in held.items() if {"w1", "w2"} <= w}


def test_a_search_reads_its_terms_alone(spark, texts):
    small, large = fresh(spark), fresh(spark)
    small.append(spark.createDataFrame(texts, "id long, text string"), "a")
    others = [(10_000 + i, " ".join(f"other{i % 50}x{j}" for j in range(40))) for i in range(2000)]
    large.append(spark.createDataFrame(texts + others, "id long, text string"), "a")
    terms = ["w9", "w17"]
    for index in (small, large):
        blocks = index.blocks(terms)
        assert {r.f.split("folder=")[1].split("/")[0] for r in blocks.select(F.input_file_name().alias("f")).collect()} <= {r.f for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(I.FOLDERS)).cast("string").alias("f")).collect()}
        assert sum(r.n for r in blocks.select("n").collect()) == sum("w9" in (t or "").split() for _, t in texts) + sum("w17" in (t or "").split() for _, t in texts)
    plan = large.blocks(terms)._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan
    assert "In(term, [w17,w9])" in plan or "In(term, [w9,w17])" in plan


def test_no_terms_and_no_texts(spark, texts):
    index = fresh(spark).append(spark.createDataFrame(texts[:5], "id long, text string"), "a")
    assert index.holding([]).count() == index.holding([], False).count() == index.top([], 3).count() == 0
    empty = fresh(spark).append(spark.createDataFrame([], "id long, text string"), "a")
    assert empty.holding(["a"]).count() == empty.top(["a"], 3).count() == 0 and empty.stats() == (0, 0)


def test_the_index_of_a_table_is_built_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string").write.parquet(str(tmp_path / "t"))
    one, two = (I.of_table(spark.read.parquet(str(tmp_path / "t")), "t") for _ in range(2))
    assert one.root == two.root and {r.id for r in two.holding(["b"]).collect()} == {1, 2}
    spark.createDataFrame([(3, "b")], "id long, text string").write.mode("append").parquet(str(tmp_path / "t"))
    assert {r.id for r in I.of_table(spark.read.parquet(str(tmp_path / "t")), "t").holding(["b"]).collect()} == {1, 2, 3}


def test_blocks_of_a_folder_are_dealt_over_tasks_when_every_task_has_one_chunk(spark, tmp_path):
    texts = spark.range(400).selectExpr("id", "concat('the w', id % 50, ' x', id) AS text").repartition(16, "id")
    found = I.TextIndex(spark, f"file://{tmp_path}/index").append(texts, "all")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "index/all/blocks").glob("folder=*")}
    assert max(n for name, n in files.items() if name != "folder=-1") > 1
    assert found.stats() == (400, 1200)
    assert {r.id for r in found.holding(["w7", "the"]).collect()} == {i for i in range(400) if i % 50 == 7}


def test_chunks_end_before_they_hold_too_many_words(monkeypatch):
    monkeypatch.setattr(I, "CHUNK_WORDS", 10)
    long = "a " * 25 + "b"
    rows = [(0, "a b c"), (1, long), (2, None), (3, "a a d"), (4, "a b e f g h"), (5, "")]

    class Here:
        @staticmethod
        def get():
            return Here

        @staticmethod
        def partitionId():
            return 1

    monkeypatch.setattr(I, "TaskContext", Here)
    import pyarrow as pa

    words = [(t or "").split() for _, t in rows]
    out = pa.Table.from_batches(list(I.inverted(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array(words, pa.list_(pa.string()))], names=["id", "ws"])])))).to_pylist()
    chunks = [(r["texts"], r["words"]) for r in out if r["term"] is None]
    assert chunks == [(1, 3), (1, 26), (4, 9)]
    got = {(r["term"], p["id"], p["tf"], p["dl"]) for r in out if r["term"] for p in r["postings"]}
    assert got == {(w, i, ws.count(w), len(ws)) for (i, _), ws in zip(rows, words) for w in ws}
    for r in out:
        if r["term"]:
            assert (r["n"], r["most_tf"], r["least_dl"]) == (len(r["postings"]), max(p["tf"] for p in r["postings"]), min(p["dl"] for p in r["postings"]))
