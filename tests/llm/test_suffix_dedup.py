import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import suffix_dedup as sd


def brute(rows):
    """Contract: bytes under a 50-byte string that also starts in a document with a smaller id."""
    data = [(i if i is not None else sd.NO_ID, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "tion", "ér", "was", "ing", "ou", "🙂", "re", "a"]) + str(rng.randrange(30)) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (5, 11, 14, 30, 60)]
    rows = [(i, " ".join(rng.choice([prose(rng, 12), rng.choice(shared)]) for _ in range(rng.randrange(5)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 50), (104, "x" * 500), (105, "x" * 51), (106, "ab" * 300), (107, "ab" * 30), (3, shared[4]), (3, shared[3]), (None, shared[4]), (None, shared[4])]
    rows += [(200 + i, shared[3] + str(i)) for i in range(8)] + [rows[7], rows[7]]
    rows += [(300, "\0" * 60 + "a"), (301, "\0" * 60 + "b"), (302, "ÿ" * 60)]
    rng.shuffle(rows)
    return rows


def compare(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, keys string, bucket int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.find_repeats(docs, **kw).collect())
    want = sorted((i if i is not None else -1, *w) for (i, _), w in zip(rows, brute(rows), strict=True))
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    compare(spark, corpus(seed), bucket_bytes=4000)


def test_frequent_keys_and_one_bucket(spark):
    compare(spark, corpus(3), bucket_bytes=100_000, hot_rows=3)
    compare(spark, corpus(3), bucket_bytes=2_000, hot_rows=3)
    compare(spark, corpus(3), bucket_bytes=100_000)


def test_blocks_merge_by_binary_search():
    rng = random.Random(5)
    segments = [prose(rng, rng.randrange(10, 30)).encode() for _ in range(40)] * 2
    rng.shuffle(segments)
    segments = [s for s in segments if len(s) >= 50]
    data = np.frombuffer(b"".join(segments), np.uint8)
    count = np.array([len(s) - 49 for s in segments])
    ids = np.arange(len(segments))
    whole = sd.least_ids(data, count, ids)
    assert (sd.least_ids(data, count, ids, block=300) == whole).all()
    want, seen = [], {}
    for i, s in enumerate(segments):
        for k in range(len(s) - 49):
            seen.setdefault(s[k : k + 50], i)
    for s in segments:
        want += [seen[s[k : k + 50]] for k in range(len(s) - 49)]
    assert list(whole) == want


def test_suffix_array_and_prefixes():
    rng = random.Random(9)
    for _ in range(60):
        n, a = rng.randrange(150), rng.choice([1, 2, 4, 256])
        b = bytes(rng.randrange(a) for _ in range(n))
        d = np.frombuffer(b, np.uint8)
        sa, _ = sd.larsson_sadakane(d)
        assert list(sa) == sorted(range(n), key=lambda i: b[i:])
        prefix = lambda i, j: next((k for k in range(50) if i + k >= n or j + k >= n or b[i + k] != b[j + k]), 50)
        assert list(sd.kasai(d, sa, 50))[1:] == [prefix(sa[i - 1], sa[i]) for i in range(1, n)]


def test_kept_bytes_and_empty_table(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").filter("doc_id >= 100").dropDuplicates(["doc_id"])
    want = {r.doc_id: r.kept_sha256 for r in sd.find_repeats(docs).collect()}
    got = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in sd.remove_repeats(docs).collect()}
    assert got == want
    assert sd.find_repeats(docs.limit(0)).count() == 0


def test_windows_that_nothing_equals_get_no_suffix_array(monkeypatch):
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 120, np.uint8).tobytes()
    segments = [rng.integers(97, 123, 400, np.uint8).tobytes() for _ in range(40)] + [rng.integers(97, 123, 200, np.uint8).tobytes() + shared for _ in range(2)] + [shared + b"z" * 60]
    data, size = np.frombuffer(b"".join(segments), np.uint8), np.array([len(x) for x in segments])
    start, count = np.append(0, np.cumsum(size)[:-1]), size - sd.LENGTH + 1
    owner, skip, run = sd.repeated_runs(sd.words8(data), start, count, np.arange(len(size)))
    found = {(int(o), int(a)) for o, s, n in zip(owner, skip, run, strict=True) for a in range(s, s + n)}
    held = {}
    for o, x in enumerate(segments):
        for a in range(len(x) - sd.LENGTH + 1):
            held.setdefault(x[a : a + sd.LENGTH], []).append((o, a))
    assert found == {p for places in held.values() if len(places) > 1 for p in places}
    searched = []
    monkeypatch.setattr(sd, "least_ids", lambda data, count, ids, of=sd.least_ids: searched.append(len(data)) or of(data, count, ids))
    p = lambda x, kind: sd.packed(np.asarray(x), kind)
    row = {"shard": 0, "bucket": 5, "data": sd.packed(data), "counts": p(count, np.int32), "ids": p(np.arange(len(size)), np.int64), "numbers": p(np.arange(len(size)), np.int32), "subs": p([7] * len(size), np.uint8)}
    out = sd._search_shard(pa.Table.from_pylist([row]))
    assert sum(searched) < 800 < len(data)
    assert set(sd.joined(out["numbers"], np.int32)) == {41, 42}  # those of a larger id than the first that holds the passage
