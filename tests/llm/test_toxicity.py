import random
import re
import zlib

import numpy as np
import pytest

from skein.llm import toxicity as tox

BAD = "grubnak vilestor hatemog slimefut".split()


def corpus(n=700, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ws = ["".join(rng.choice(["an", "er", "to", "li", "su"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(10, 200))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(3 + len(ws) // 30):
                ws[rng.randrange(len(ws))] = rng.choice(BAD)
        rows.append((i, " ".join(ws), y))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", 1.5) for i, t, _ in rows] + [(9000, None, None, None), (9001, "", "", 0.0), (None, "text", "s", 0.0), (5, rows[5][1], "s", 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(tables):
    rows, docs, labels = tables
    got = tox.score(docs, tox.train(docs, labels)).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if r.doc_id == 5}) == 1 and len({r.score for r in got if r.doc_id in (9000, 9001)}) == 1


def test_labels_of_held_out_rows_are_never_read(tables):
    rows, docs, labels = tables
    flipped = labels.withColumn("toxic", tox.F.when(tox.held_out("doc_id"), 1 - tox.F.col("toxic")).otherwise(tox.F.col("toxic")))
    few = docs.filter("doc_id < 200")
    assert tox.sample(few, labels, "doc_id", "text", "toxic") == tox.sample(few, flipped, "doc_id", "text", "toxic")


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = tox.Network(rng, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((7, 3, tox.WORD_DIM + tox.CHAR_DIM))
    mask = np.ones((7, 3), bool)
    mask[5:, 1] = False
    grad = rng.standard_normal(3)
    _, saved = net.forward(x, mask, keep=True)
    got, d_x = net.backward(grad, saved)
    for name in ("Wf", "Ub", "cf", "eb", "A", "v", "o"):
        p, flat = net.p[name], 3 % net.p[name].size
        at = np.unravel_index(flat, p.shape)
        old, eps = p[at], 1e-4
        p[at] = old + eps
        up = net.forward(x, mask)[0] @ grad
        p[at] = old - eps
        down = net.forward(x, mask)[0] @ grad
        p[at] = old
        assert abs((up - down) / (2 * eps) - got[name][at]) < 2e-2 * max(1, abs(got[name][at])), name


def test_every_word_is_in_a_window():
    for n in (0, 1, tox.WINDOW - 1, tox.WINDOW, tox.WINDOW + 1, 5 * tox.STRIDE, 1000):
        seen = set(tox.windows(np.arange(1, n + 1)).ravel().tolist()) - {0}
        assert seen == set(range(1, n + 1))


def test_no_labels_and_empty_table(tables):
    _, docs, labels = tables
    assert tox.train(docs, labels.limit(0)) is None
    assert {r.score for r in tox.score(docs, None).collect()} == {0.0}
    assert tox.keep_clean(docs, None).count() == docs.count()
    model = tox.fit([t for _, t, _ in corpus(60)], [y for *_, y in corpus(60)], epochs=1)
    assert tox.score(docs.limit(0), model).count() == 0 and tox.keep_clean(docs, model).columns == docs.columns


def plain_scores(model, texts):
    """Scores by the recurrences written out word by word, window by window, in double precision."""
    p = {k: v.astype(np.float64) for k, v in model.net.p.items()}
    h = tox.HIDDEN
    s = lambda x: 1 / (1 + np.exp(-x))
    out = []
    for text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        n, logits = len(words), []
        first = [*range(0, n - tox.WINDOW, tox.STRIDE), n - tox.WINDOW] if n > tox.WINDOW else [0]
        for lo in first:
            window = words[lo : lo + tox.WINDOW]
            xs = [model.inputs([w])[0].astype(np.float64) for w in window] + [np.zeros(tox.WORD_DIM + tox.CHAR_DIM)] * (tox.WINDOW - len(window))
            states = {}
            for side, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
                state = np.zeros(h)
                for t in order:
                    a, m = xs[t] @ p[f"W{side}"] + p[f"c{side}"], state @ p[f"U{side}"]
                    z, r = s(a[:h] + m[:h]), s(a[h : 2 * h] + m[h : 2 * h])
                    new = np.tanh(a[2 * h :] + r * (m[2 * h :] + p[f"e{side}"]))
                    state = (1 - z) * new + z * state
                    states[side, t] = state
            both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(xs))]
            weight = [np.exp(np.tanh(x @ p["A"] + p["a"]) @ p["v"]) if t < len(window) else np.exp(-30.0) for t, x in enumerate(both)]
            pooled = sum(w * x for w, x in zip(weight, both, strict=True)) / sum(weight)
            logits.append(pooled @ p["o"] + p["q"][0])
        a, b, c = model.line
        out.append(float(s(a * max(logits) + b * sum(logits) / len(logits) + c)))
    return out


def test_scores_equal_plain_recurrences(spark):
    rows = corpus(120, seed=4)
    model = tox.fit([t for _, t, _ in rows], [y for *_, y in rows], epochs=2)
    texts = [t for _, t, _ in rows[:12]] + [None, "", "!!", "one", "x " * 64, "y z " * 500, rows[0][1] * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.score for r in tox.score(docs, model).orderBy("doc_id").collect()]
    assert np.allclose(got, plain_scores(model, texts), atol=2e-4)
