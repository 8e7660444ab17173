"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a learned vector of the word (zero for words outside the training vocabulary)
and the
scaled sum of learned vectors of its beginnings and character n-grams (hashed). Windows of ``WINDOW`` words start
every ``STRIDE`` words over the whole text, the last one ending at its end; a forward and a backward
recurrent pass read each window, attention weighs their states into the window's logit, and the
document's logit is a fitted line over the largest and the mean of its windows' logits. Labels mark documents, so training alternates: the present network picks the
window that speaks most for toxicity, and that window learns the document's label (plus, for clean
documents, one drawn at random).

The network is fitted on the driver to a bounded sample: at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN``
clean labelled documents, the first by hash of the key. Scoring reads every row and every word.
Only the text is an input of a score.

Defined results: a null or wordless text is one window of padding; several labels of a document
count as toxic if one is; rows without a key are scored and not held out; without usable labels of
both classes every score is 0; equal texts get equal scores; an empty table gives an empty table;
columns other than those named are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim

WINDOW, STRIDE = 64, 48
MAX_TOXIC, MAX_CLEAN = 1000, 1600
VOCABULARY, MIN_DOCS = 20_000, 3
WORD_DIM, CHAR_DIM, HIDDEN, BUCKETS = 8, 8, 12, 1 << 14
#: Rounds of choosing windows and learning from them: at least EPOCHS, more where few documents make few steps.
EPOCHS, MAX_EPOCHS, STEPS, BATCH, RATE = 8, 30, 360, 96, 0.006
#: Words whose input a worker remembers.
CACHE_WORDS = 150_000
THRESHOLD = 0.3

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(word: str) -> list[int]:
    """Hashes of the word's beginnings of up to 8 characters and of its runs of 3 and 4 characters."""
    b, hash_of = f"^{word}$".encode("utf-8", "replace"), zlib.crc32
    n = len(b)
    return [hash_of(b[:i]) % BUCKETS for i in range(4, min(n, 11) + 1)] + [hash_of(b[i : i + k], k) % BUCKETS for k in (3, 4) for i in range(n - k + 1)]


def starts(n: int) -> list[int]:
    """First words of the windows of a text of n words."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0]


def windows(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) ids; texts shorter than a window are padded with id 0 at the end."""
    if len(ids) < WINDOW:
        ids = np.concatenate([ids, np.zeros(WINDOW - len(ids), ids.dtype)])
    return ids[np.asarray(starts(len(ids)))[:, None] + np.arange(WINDOW)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes. Inputs are time-major: (WINDOW, windows, dimensions)."""

    def __init__(self, rng: np.random.Generator, n_words: int) -> None:
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        make = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.p = {"word": 0.1 * rng.standard_normal((n_words, WORD_DIM)).astype(np.float32), "char": 0.1 * rng.standard_normal((BUCKETS, CHAR_DIM)).astype(np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": make(d, 3 * h), f"U{side}": make(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32), f"e{side}": np.zeros(h, np.float32)}
        self.p |= {"A": make(2 * h, h), "a": np.zeros(h, np.float32), "v": make(h), "o": make(2 * h), "q": np.full(1, -1, np.float32)}

    def recur(self, x: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction in text order, and what the backward pass needs."""
        p, h, steps = self.p, HIDDEN, len(x)
        u, extra = p[f"U{side}"], p[f"e{side}"]
        given = x @ p[f"W{side}"] + p[f"c{side}"]
        out = np.empty((steps, x.shape[1], h), np.float32)
        state, tape = np.zeros((x.shape[1], h), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            mixed = state @ u
            zr = sigmoid(given[t, :, : 2 * h] + mixed[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            m = mixed[:, 2 * h :] + extra
            n = np.tanh(given[t, :, 2 * h :] + r * m)
            new = n + z * (state - n)
            if keep:
                tape.append((t, state, zr, m, n))
            out[t] = state = new
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
        """Logits of the windows. mask (WINDOW, windows) is False at padding."""
        p = self.p
        f, tape_f = self.recur(x, "f", keep)
        b, tape_b = self.recur(x, "b", keep)
        states = np.concatenate([f, b], axis=2)
        act = np.tanh(states @ p["A"] + p["a"])
        weight = np.where(mask, act @ p["v"], -30.0)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbh->bh", weight, states, optimize=True)
        return pooled @ p["o"] + p["q"][0], (x, states, act, weight, pooled, tape_f, tape_b, mask) if keep else None

    def backward(self, grad: np.ndarray, saved: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the inputs, for gradients of the logits."""
        p, h = self.p, HIDDEN
        x, states, act, weight, pooled, tape_f, tape_b, mask = saved
        g = {"o": pooled.T @ grad, "q": np.array([grad.sum()], np.float32)}
        d_pooled = grad[:, None] * p["o"]
        d_states = weight[..., None] * d_pooled
        d_weight = np.einsum("tbh,bh->tb", states, d_pooled, optimize=True)
        d_score = weight * (d_weight - (weight * d_weight).sum(0)) * mask
        g["v"] = np.einsum("tb,tbh->h", d_score, act, optimize=True)
        d_act = d_score[..., None] * p["v"] * (1 - act**2)
        g["A"], g["a"] = np.einsum("tbi,tbj->ij", states, d_act, optimize=True), d_act.sum((0, 1))
        d_states = d_states + d_act @ p["A"].T
        d_x = np.zeros_like(x)
        for side, tape, d_out in (("f", tape_f, d_states[..., :h]), ("b", tape_b, d_states[..., h:])):
            u = p[f"U{side}"]
            g[f"U{side}"], g[f"e{side}"] = np.zeros_like(u), np.zeros(h, np.float32)
            d_given = np.zeros((*x.shape[:2], 3 * h), np.float32)
            d_state = np.zeros((x.shape[1], h), np.float32)
            for t, state, zr, m, n in reversed(tape):
                z, r = zr[:, :h], zr[:, h:]
                d_new = d_state + d_out[t]
                d_n = d_new * (1 - z) * (1 - n**2)
                d_zr = np.concatenate([d_new * (state - n), d_n * m], 1) * zr * (1 - zr)
                d_m = d_n * r
                d_mixed = np.concatenate([d_zr, d_m], 1)
                d_given[t] = np.concatenate([d_zr, d_n], 1)
                g[f"U{side}"] += state.T @ d_mixed
                g[f"e{side}"] += d_m.sum(0)
                d_state = d_new * z + d_mixed @ u.T
            g[f"W{side}"], g[f"c{side}"] = np.einsum("tbi,tbj->ij", x, d_given, optimize=True), d_given.sum((0, 1))
            d_x += d_given @ p[f"W{side}"].T
        return g, d_x


class Model:
    """A fitted network with its vocabulary; small enough to travel with a task."""

    def __init__(self, vocabulary: list[str], net: Network) -> None:
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.net = net
        self.line = (1.0, 0.0, 0.0)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of words."""
        p = self.net.p
        out = np.zeros((len(words), WORD_DIM + CHAR_DIM), np.float32)
        known = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        out[:, :WORD_DIM] = p["word"][known] * (known > 0)[:, None]
        grams = [grams_of(w) for w in words]
        sizes = np.fromiter(map(len, grams), np.int64, len(words))
        if len(words):
            flat = np.fromiter((g for gs in grams for g in gs), np.int64, int(sizes.sum()))
            out[:, WORD_DIM:] = np.add.reduceat(p["char"][flat], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / np.sqrt(sizes)[:, None]
        return out


class Scorer:
    """Scores batches of texts on a worker; remembers the inputs of words it has seen."""

    def __init__(self, model: Model, chunk: int = 1024) -> None:
        self.model, self.chunk = model, chunk
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.table, self.new = np.zeros((1, WORD_DIM + CHAR_DIM), np.float32), []

    def lookup(self, words: list[str]) -> np.ndarray:
        ids, new = self.ids, self.new
        get = ids.get
        out = [get(w, 0) for w in words]
        if 0 in out:
            for i, k in enumerate(out):
                if not k:
                    w = words[i]
                    if w not in ids:
                        ids[w] = len(ids) + 1
                        new.append(w)
                    out[i] = ids[w]
        return np.array(out, np.int32)

    def logits(self, texts: Iterable[str | None]) -> np.ndarray:
        if len(self.ids) > CACHE_WORDS:
            self.reset()
        rows = [windows(self.lookup(words_of(t))) for t in texts]
        if self.new:
            self.table = np.concatenate([self.table, self.model.inputs(self.new)])
            self.new = []
        counts = np.array([len(r) for r in rows])
        ids = np.concatenate(rows)
        out = np.empty(len(ids), np.float32)
        for at in range(0, len(ids), self.chunk):
            part = ids[at : at + self.chunk].T
            out[at : at + self.chunk] = self.model.net.forward(self.table[part], part > 0)[0]
        edge = np.concatenate([[0], np.cumsum(counts)[:-1]])
        a, b, c = self.model.line
        return a * np.maximum.reduceat(out, edge) + b * np.add.reduceat(out, edge) / counts + c


def z_scores(in_clean: np.ndarray, in_toxic: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """z-scores of log-odds of toxicity, from the numbers of clean and toxic documents that hold an item."""
    n = [max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))]
    a, b = in_toxic + 0.5, in_clean + 0.5
    odds = np.log(a / (n[1] + 1 - a)) - np.log(b / (n[0] + 1 - b))
    return (odds / np.sqrt(1 / a + 1 / b)).astype(np.float32)


def shrunk(z: np.ndarray) -> np.ndarray:
    """Start values from z-scores: chance associations vanish, clear ones stand out."""
    return np.sign(z) * np.clip(np.abs(z) - 2, 0, 4) / 3


def fit(texts: list[str | None], labels: list[int], seed: int = 7, epochs: int | None = None) -> Model | None:
    """A model of the given documents; None unless both classes occur."""
    toxic = np.asarray(labels, np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    # Words are numbered from 1 by sorted order; everything after works on numbers.
    distinct = sorted({w for t in texts for w in words_of(t)})
    number = {w: i + 1 for i, w in enumerate(distinct)}
    split = [np.array([number[w] for w in words_of(t)], np.int32) for t in texts]
    grams = [np.zeros(0, np.int32), *(np.array(grams_of(w), np.int32) for w in distinct)]
    seen = np.zeros((2, len(distinct) + 1), np.int32)
    seen_grams = np.zeros((2, BUCKETS), np.int32)
    for ws, y in zip(split, toxic, strict=True):
        own = np.unique(ws)
        seen[y, own] += 1
        if len(own):
            seen_grams[y, np.unique(np.concatenate([grams[w] for w in own]))] += 1
    df = seen.sum(0)
    frequent = np.argsort(-df, kind="stable")
    frequent = frequent[df[frequent] >= MIN_DOCS][:VOCABULARY]
    vocabulary, z = [distinct[i - 1] for i in frequent], z_scores(seen[0, frequent], seen[1, frequent], toxic)
    rng = np.random.default_rng(seed)
    net = Network(rng, len(vocabulary) + 1)
    model = Model(vocabulary, net)
    word_row = np.array([0, *(model.vocabulary.get(w, 0) for w in distinct)])
    size = np.sqrt([max(1, len(g)) for g in grams]).astype(np.float32)
    begin = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    flat = np.concatenate(grams)
    del grams
    rows = [windows(ws) for ws in split]
    edge = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids = np.concatenate(rows)

    # The first dimension of a word or n-gram starts from what the labels alone say about it.
    net.p["word"][1:, 0] = shrunk(z)
    net.p["char"][:, 0] = shrunk(z_scores(*seen_grams, toxic)) * (seen_grams.sum(0) >= MIN_DOCS)
    for side in "fb":
        net.p[f"W{side}"][0] = net.p[f"W{side}"][WORD_DIM] = np.abs(net.p[f"W{side}"][0])

    def table() -> np.ndarray:
        out = np.zeros((len(word_row), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = net.p["word"][word_row] * (word_row > 0)[:, None]
        for lo in range(1, len(out), 8192):
            hi = min(lo + 8192, len(out))
            own = net.p["char"][flat[begin[lo] : begin[hi]]]
            out[lo:hi, WORD_DIM:] = np.add.reduceat(own, begin[lo:hi] - begin[lo]) / size[lo:hi, None]
        return out

    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    per_epoch = -(-int(len(toxic) + (toxic == 0).sum()) // BATCH)
    epochs = epochs or min(MAX_EPOCHS, max(EPOCHS, -(-STEPS // per_epoch)))
    for epoch in range(epochs):
        inputs = table()
        logit = np.zeros(0) if epoch == 0 else np.concatenate([net.forward(inputs[ids[i : i + 1024].T], ids[i : i + 1024].T > 0)[0] for i in range(0, len(ids), 1024)])
        if epoch == 0:  # before any training the labels' own word scores choose
            logit = inputs[ids, 0].sum(1) + inputs[ids, WORD_DIM].sum(1)
        chosen, target = [], []
        for d, y in enumerate(toxic):
            lo, hi = edge[d], edge[d + 1]
            chosen.append(lo + int(logit[lo:hi].argmax()))
            target.append(y)
            if not y:
                chosen.append(int(rng.integers(lo, hi)))
                target.append(0)
        chosen, target = np.array(chosen), np.array(target, np.float32)
        # Both classes weigh alike.
        weigh = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum())).astype(np.float32) * len(target)
        order = rng.permutation(len(chosen))
        rate = RATE * (1 - 0.8 * epoch / epochs)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            part = ids[chosen[pick]].T
            used, back = np.unique(part, return_inverse=True)
            back = back.reshape(part.shape)
            small = np.zeros((len(used), WORD_DIM + CHAR_DIM), np.float32)
            known = word_row[used]
            drop = rng.random(len(used)) < 0.1  # some words are unknown, as in other texts
            small[:, :WORD_DIM] = net.p["word"][known] * ((known > 0) & ~drop)[:, None]
            gram_ids = np.concatenate([flat[begin[k] : begin[k + 1]] for k in used]) if len(used) else flat[:0]
            gram_of = np.repeat(np.arange(len(used)), begin[used + 1] - begin[used])
            np.add.at(small[:, WORD_DIM:], gram_of, net.p["char"][gram_ids] / size[used][gram_of][:, None])
            out, saved = net.forward(small[back], part > 0, keep=True)
            grad = (sigmoid(out) - target[pick]) * weigh[pick] / len(pick)
            g, d_x = net.backward(grad.astype(np.float32), saved)
            d_small = np.zeros_like(small)
            np.add.at(d_small, back, d_x)
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], known, d_small[:, :WORD_DIM] * ((known > 0) & ~drop)[:, None])
            np.add.at(g["char"], gram_ids, d_small[gram_of, WORD_DIM:] / size[used][gram_of][:, None])
            step += 1
            for k, v in net.p.items():
                gk = np.clip(g[k], -1, 1)
                if k in ("word", "char"):
                    gk = gk + 1e-4 * v
                m, s = moment[k]
                m += 0.1 * (gk - m)
                s += 0.01 * (gk * gk - s)
                v -= (0.3 * rate if k in ("word", "char") else rate) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    model.line = fit_line(model, texts, toxic)
    return model


def fit_line(model: Model, texts: list[str | None], toxic: np.ndarray, pull: float = 1.0) -> tuple[float, float, float]:
    """Weights of the largest and the mean window logit, and an offset, by regularised logistic regression."""
    scorer, sides = Scorer(model), []
    for line in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)):
        model.line = line
        sides.append(np.concatenate([scorer.logits(texts[i : i + 128]) for i in range(0, len(texts), 128)]))
    x = np.stack([*sides, np.ones(len(toxic))], 1).astype(np.float64)
    start = np.array([0.7, 0.3, 0.0])
    w = start.copy()
    for _ in range(50):  # Newton's method
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + pull * np.eye(3)
        w -= np.linalg.solve(hess, x.T @ (q - toxic) + pull * (w - start))
    return float(w[0]), float(w[1]), float(w[2])


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[list[str | None], list[int]]:
    """Texts and labels to fit to: the first by hash of each class, none held out."""
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y")).filter(~held_out("k"))
    order = [F.xxhash64("k"), F.col("k")]
    few = known.filter("y = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.filter("y = 0").orderBy(*order).limit(MAX_CLEAN))
    # At most MAX_TOXIC + MAX_CLEAN keys: safe to broadcast at any size of the tables.
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(few), "k").groupBy("k").agg(F.max("y").alias("y"), F.max("t").alias("t")).collect()
    texts: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: r.k):  # a text counts once, or its copies would teach their own words
        texts[r.t or ""] = max(texts.get(r.t or "", 0), int(r.y))
    return list(texts), list(texts.values())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    return fit(*sample(docs, labels, key, text, label))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    if model is None:
        out = rows.select("key", "held_out", F.lit(0.0).alias("score"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(model)
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    logit = scorer.logits(batch.column(2).to_pylist()).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-logit)))], names=["key", "held_out", "score"])
            del scorer
            trim()

        out = rows.mapInArrow(run, f"key {kind}, held_out boolean, score double")
    return out.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay."""
    if model is None:
        return docs
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        limit = math.log(THRESHOLD / (1 - THRESHOLD))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield batch.filter(pa.array(scorer.logits(batch.column(column).to_pylist()) < limit))
        del scorer
        trim()

    return docs.mapInArrow(run, docs.schema)
