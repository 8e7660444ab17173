"""The pipeline on a small corpus against each stage's plain version, and the entry's registration."""

import random

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from skein.llm import bpe, toxicity
from skein.lineage import materialise

from .test_pii import brute as pii_spans
from .test_toxicity import corpus as toxic_corpus


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    rows, labels = [], []
    for i, text, y in toxic_corpus(240, seed=9):
        rows.append((i, text + (f" mail a{i}@b.example now" if i % 7 == 0 else ""), "en", "hot" if i % 3 else f"s{i % 5}"))
        labels.append((i, 1, y))
    rows += [(1000 + i, rows[i][1], "en", "copy") for i in range(0, 40, 2)]
    rows += [(2000, None, None, None), (2001, "", "en", "s1"), (2002, "x " * 20_000, "en", "s1"), rows[3], rows[3]]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{root}/labels.parquet")
    return f"file://{root}"


def test_stages_against_plain_versions(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "encoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], sf_dir), name))
    clean, single, safe, mixed, encoded = ([tuple(r) for r in k.collect()] for k in kept[1:])
    assert all(k.columns == columns for k in kept[1:5])
    # Toxicity: exactly the rows that the operator predicts clean.
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    predicted = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    assert {r[0] for r in clean} == predicted and 0 < len(clean) < docs.count()
    # Near-duplicates: one row of each text at most, none of the distinct prose lost.
    texts = {}
    for r in clean:
        texts.setdefault(r[1] or "", []).append(r[0])
    assert sorted(r[0] for r in single) == sorted(min(v) for v in texts.values())
    # Personal data: spans of the plain version are gone, other texts are untouched.
    before = {r[0]: r[1] for r in single}
    for i, text, _, _, n in safe:
        assert not pii_spans(text) and n == (len(text) if text is not None else None)
        if not pii_spans(before[i]):
            assert text == before[i]
    assert sorted(map(str, mixed)) == sorted(map(str, safe))
    library = Tokenizer.from_file(bpe.default_path())
    text_of = {r[0]: r[1] for r in safe}
    for i, n, ids, _ in encoded:
        assert ids == library.encode(text_of[i] or "", add_special_tokens=False).ids and n == len(ids)
    assert sorted((r[0], r[1]) for r in encoded) == sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect())


CLASHING = ("row", "key", "position", "node", "h", "bucket", "s", "spans", "root", "n", "score", "Predicted")


def test_near_copies_and_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, family = [], {}
    for i in range(40):
        base = [word() for _ in range(80)]
        for k in range(1 + i % 4):  # the last words of a copy differ in one place each
            text = list(base)
            if k:
                text[10 * k] = word()
            family[100 * k + i] = i
            rows.append((100 * k + i, " ".join(text), "en", f"s{i % 3}", 0, *(["x"] * len(CLASHING))))
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    docs = spark.createDataFrame(rows, kind)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialise(stage(spark, kept, f"file://{tmp_path}"), name)
        assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()} == set(range(40))


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_registered_queries():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
