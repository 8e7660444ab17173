import math
import random

import numpy as np
import pytest

from skein.llm import pq


def corpus(seed=0, dim=24, n=240):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    while len(rows) < n:
        base = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 7))):
            v = base + rng.standard_normal(dim) * rng.choice([0.02, 0.2, 0.35, 0.5])
            rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
            i += 1
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(4)] + [(2000, [2 * x for x in rows[5][1]], rows[5][2]), rows[7], rows[7]]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * dim, 1), (3003, [float("nan")] + rows[5][1][1:], 1), (3004, [None] + rows[5][1][1:], 1), (3005, [math.inf] * dim, 1), (3006, rows[5][1], None), (3007, rows[5][1][:-1], rows[5][2]), (None, rows[9][1], rows[9][2])]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows):
    big = 2**63 - 1
    good = [k for k, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    low = {}
    ids = [i if i is not None else big for i, *_ in rows]
    for k, i in enumerate(ids):
        low[find(k)] = min(low.get(find(k), big), i)
    return sorted((ids[k], links[k], low[find(k)]) for k in range(len(rows)))


@pytest.mark.parametrize("kw", [{}, {"list_rows": 20, "block": 10, "sample": 100, "queries": 7}, {"list_rows": 1000, "block": 10, "queries": 1000}])
def test_equals_brute_force(spark, kw):
    rows = corpus()
    got = pq.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n int"), **kw).collect()
    big = 2**63 - 1
    none = lambda x: big if x is None else x
    assert sorted((none(r.vec_id), r.n_links, none(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_unusable_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert pq.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    r = pq.near_duplicates(spark.createDataFrame([(4, None, 1)], schema)).first()
    assert (r.vec_id, r.n_links, r.component_id, r.kept) == (4, 0, 4, True)


def test_recall_of_the_index_alone():
    rng = np.random.default_rng(3)
    base = pq.unit(rng.standard_normal((300, 32)))
    x = pq.unit(np.repeat(base, 4, 0) + 0.05 * rng.standard_normal((1200, 32)))
    index = pq.Index(x[::3], 12)
    cell, codes, error, _ = index.encode(x)
    probes, _ = index.probes(x, cell, pq.reach_of(0.93))
    found = set()
    for c in range(len(index.coarse)):
        q = np.array([i for i in range(len(x)) if c in probes[i]])
        d = np.flatnonzero(cell == c)
        if len(q) and len(d):
            i, j = pq.search(index, c, x[q], x[d], codes[d], error[d], 0.93)
            found |= set(zip(q[i].tolist(), d[j].tolist(), strict=True))
    true = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.93), strict=True)}
    assert found == true
