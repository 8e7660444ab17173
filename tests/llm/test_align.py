"""Alignments against a plain two-pointer pass over each text's tokens."""

import bisect
import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import align as X
from skein.session import table


def plain(docs):
    """{key: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)} of (key, text) pairs."""
    a, b = map(X.side, X.default_paths())
    counts, each = Counter(), {}
    for key, text in docs:
        found = [s.encode(text) for s in (a, b)] if text else [[], []]
        whole = (" " + text).encode() if text else b""
        if any(b"".join(s.bytes[i] for i in ids) != whole for s, ids in zip((a, b), found, strict=True)):
            found = [[], []]
        spans = []
        for s, ids in zip((a, b), found, strict=True):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(s.bytes[i]), i))
                at = own[-1][1]
            spans.append(own)
        links, i, j = [], 0, 0
        while i < len(spans[0]) and j < len(spans[1]):
            x, y = spans[0][i], spans[1][j]
            if min(x[1], y[1]) > max(x[0], y[0]):
                links.append((x[2], y[2]))
            i, j = i + (x[1] <= y[1]), j + (y[1] <= x[1])
        common = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        ends, groups, at = [[s[1] for s in own] for own in spans], [], [0, 0]
        for c in common:
            to = [bisect.bisect_right(e, c) for e in ends]
            groups.append("|".join(",".join(str(s[2]) for s in own[lo:hi]) for own, lo, hi in zip(spans, at, to, strict=True)))
            at = to
        counts.update(links)
        each[key] = (len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return {k: (p, q, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), h) for k, (p, q, g, links, h) in each.items()}


def figures(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


ODD = [None, "", " ", "a", "▁ piece marks ▁", "naïve café 日本語テキスト 😀👍🏽 e\u0301", "<s> <|endoftext|> </s> <0x41>", "\n\t  \r\n indented   text ", "x" * 9000, "word " * 3000, "日本" * 2500, "\x00 zero \x7f", "😀" * 1500]


@pytest.mark.parametrize(("window", "chunk"), [(X.WINDOW, X.CHUNK_LINKS), (64, 100), (7, 1)])
def test_odd_texts_in_windows_and_chunks_of_any_size(spark, window, chunk):
    texts = ODD if window > 7 else [t for t in ODD if not t or len(t) < 100]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "chunk": F.lit("x"), "key": F.lit(2), "mark": F.lit(3)})
    got = X.align(df, window=window, chunk_links=chunk)
    assert {r.doc_id: figures(r) for r in got.collect()} == plain(rows)


def test_repeated_rows_and_ids_each_count(spark):
    rows = [(1, "one text here"), (1, "one text here"), (1, "another text"), (None, "one text here"), (2, None), (2, None)]
    want = plain(list(enumerate(t for _, t in rows)))
    got = X.align(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(figures, got.collect())) == sorted(want.values())
    assert X.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = X.align(docs, chunk_links=20_000)
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: figures(r) for r in got.collect()} == want


def test_fast_ids_are_the_librarys(spark):
    import random

    import tokenizers

    model = tokenizers.Tokenizer.from_file(X.default_paths()[0])
    model.encode_special_tokens = True
    rng = random.Random(1)
    pool = [chr(c) for c in range(0x250)] + [" "] * 200 + ["\n"] * 30 + list("'sdtmllvere") * 5 + ["日", "😀", "\u3000", "\u2028"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert [X.side(X.default_paths()[0]).encode(t) for t in texts] == [x.ids for x in model.encode_batch([" " + t for t in texts], add_special_tokens=False)]
