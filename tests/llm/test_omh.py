import random
import re
from collections import Counter

import numpy as np

from skein.llm import omh


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_alignment_equals_plain_edit_distance():
    rng = random.Random(3)
    a, b = [], []
    for _ in range(300):
        x = [rng.randrange(1, 6) for _ in range(rng.randrange(60))]
        y = list(x) if rng.random() < 0.8 else [rng.randrange(1, 6) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(12)):
            p = rng.randrange(len(y) + 1)
            y[p : p + rng.randrange(2)] = [rng.randrange(1, 9)] * rng.randrange(2)
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
    most = np.array([max(len(x), len(y)) // 5 for x, y in zip(a, b, strict=True)])
    got, want = omh.distances(a, b, most), np.array([edit(x, y) for x, y in zip(a, b, strict=True)])
    assert ((got <= most) == (want <= most)).all() and (got[want <= most] == want[want <= most]).all()


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def text_of(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(n))


def corpus():
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(25):
        base = text_of(rng, rng.randrange(30, 200)).split()
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(len(t) // 40):
                t[rng.randrange(len(t))] = "edit" + str(rng.randrange(9))
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(500 + i, rows[0][1]) for i in range(5)] + [(700, None), (701, ""), (702, "!!"), (703, "one"), (704, "One "), (705, "one two"), (None, rows[3][1]), (None, "only here"), rows[9], rows[9], (9, "same id, other text")]
    rng.shuffle(rows)
    return rows


def brute(rows):
    """Component of each row: links are edit similarity of 0.8 or equal texts."""
    node = [((i if i is not None else 2**63 - 1), t or "") for i, t in rows]
    ws = [words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            longest = max(len(ws[i]), len(ws[j]))
            if node[i][1] == node[j][1] or (ws[i] and ws[j] and min(len(ws[i]), len(ws[j])) >= 0.8 * longest and edit(ws[i], ws[j]) <= 0.2 * longest + 1e-9):
                root[find(i)] = find(j)
    low = {}
    for i, n in enumerate(node):
        low[find(i)] = min(low.get(find(i), n), n)
    return [low[find(i)][0] for i in range(len(rows))]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    clash = ["node", "id", "unit", "side", "salt", "__id", "__Node", "__text", "__copies", "__own_id", "___own_node", "least"]
    docs = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in clash)).repartition(3)
    for settings in ({}, {"chunk": 2, "cell": 2}):  # whole keys, and keys cut into many units
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else 2**63 - 1) for r in omh.near_duplicates(docs, **settings).collect())
        assert got == sorted((i if i is not None else -1, c) for (i, _), c in zip(rows, brute(rows), strict=True))
    kept = omh.keep_one(docs)
    assert kept.columns == docs.columns
    n_classes = len({(c, "9b" if t == "same id, other text" else t if i is None and t == "only here" else "") for (i, t), c in zip(rows, brute(rows), strict=True)})
    assert kept.count() == n_classes


def test_order_of_shingles_matters_and_occurrences_count():
    rng = random.Random(1)
    a, b = text_of(rng, 60), text_of(rng, 60)
    keys = omh.sketches(*omh.word_hashes([a + " " + b, b + " " + a, a + " " + b.replace("alpha", "ALPHA"), a, a + " " + a]))
    same = lambda i, j: int((keys[i] == keys[j]).sum())
    assert same(0, 2) == omh.BANDS and same(0, 1) < omh.BANDS // 2 and same(3, 4) < omh.BANDS


def test_large_group_links_to_one_class_in_linear_pairs(spark):
    rng = random.Random(2)
    base = text_of(rng, 80).split()
    rows = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(80)] = f"v{i}"
        rows.append((i, " ".join(t)))
    found = omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.component_id for r in found) == {0: 400} and [r.doc_id for r in found if r.kept] == [0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert omh.near_duplicates(docs).count() == 0 and omh.keep_one(docs).count() == 0


def triples(seed, n=40):
    """Texts a, b, c where a-b and b-c are near and a-c is not, and b and c have little in common that a lacks."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        fresh = lambda k: [f"edit{rng.randrange(10**9)}" for _ in range(k)]
        a, part = fresh(200), fresh(30)
        b, c = part + a[30:], part[:3] + fresh(40) + a[43:]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((a, b, c))]
    return rows


def test_groups_of_any_size_align_every_pair_that_shares_a_key(spark):
    rows = triples(4)
    keys = omh.sketches(*omh.word_hashes([t for _, t in rows]))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i - i % 3, i):
            if (keys[i] == keys[j]).any() and edit(words(rows[i][1]), words(rows[j][1])) <= 40:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(rows)):
        low.setdefault(find(i), i)
    want = [low[find(i)] for i in range(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in ({}, {"chunk": 1}, {"chunk": 2, "cell": 2}):
        assert [r.component_id for r in sorted(omh.near_duplicates(docs, **settings).collect())] == want, settings


def test_recall_of_keys_by_edit_similarity():
    rng = random.Random(8)
    for similarity, least in ((0.95, 0.99), (0.9, 0.99), (0.85, 0.95), (0.8, 0.85)):
        for n in (60, 200, 600):
            texts = []
            for _ in range(100):
                a = [f"w{rng.randrange(5000)}" for _ in range(n)]
                b = list(a)
                for p in rng.sample(range(n), round((1 - similarity) * n)):
                    b[p] = f"edit{rng.randrange(10**6)}"
                texts += [" ".join(a), " ".join(b)]
            keys = omh.sketches(*omh.word_hashes(texts))
            found = float((keys[::2] == keys[1::2]).any(1).mean())
            print(similarity, n, found)
            assert found >= least


def test_recall_on_a_corpus_with_a_hot_group(spark):
    """6000 rows: a third near copies of one text, other families, a passage that many unlike texts share, noise."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(20_000)}"
    passage = [word() for _ in range(40)]
    texts = []

    def family(size, n, share):
        base = [word() for _ in range(n)]
        for _ in range(size):
            t = list(base)
            for p in rng.sample(range(n), int(share * n)):
                t[p] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(t))

    family(2000, 60, 0.04)
    for _ in range(300):
        family(rng.randrange(2, 8), rng.randrange(50, 150), rng.choice((0.02, 0.05, 0.08)))
    texts += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(20)]) for _ in range(1200)]
    texts += [" ".join(word() for _ in range(rng.randrange(40, 90))) for _ in range(6000 - len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in omh.near_duplicates(docs, chunk=64, cell=256).collect()}
    # Brute force: all pairs that lengths and shared words allow, by alignment.
    ws = [np.array([hash(x) for x in t.split()], np.int64) for t in texts]
    slot = np.zeros((len(ws), 512), np.int16)
    for i, w in enumerate(ws):
        np.add.at(slot[i], w % 512, 1)
    size = slot.sum(1, dtype=np.int32)
    pairs = []
    for i in range(1, len(ws)):
        both = np.minimum(slot[:i], slot[i]).sum(1, dtype=np.int32)
        pairs += [(int(j), i) for j in np.flatnonzero(both >= 0.8 * np.maximum(size[:i], size[i]))]
    hot = [p for p in pairs if p[1] < 2000]  # two million of them: a sample stands for the rest
    pairs = [p for p in pairs if p[1] >= 2000] + rng.sample(hot, 3000)
    a, b = [ws[i].astype(np.uint64) for i, _ in pairs], [ws[j].astype(np.uint64) for _, j in pairs]
    ok, _ = omh.similar(a, b, 0.8)
    near = [p for p, x in zip(pairs, ok, strict=True) if x]
    found = sum(got[i] == got[j] for i, j in near) / len(near)
    print("pairs", len(near), "recall", found)
    assert len(near) > 1500 and found >= 0.98
    assert len({got[i] for i in range(2000)}) == 1 and len({got[i] for i in range(len(texts) - 500, len(texts))}) == 500


def test_nodes_that_share_many_keys_travel_once_for_all_of_them(spark):
    """A group of 300 under 40 keys, each of which misses some, and strangers that share a key with one of them."""
    rng = random.Random(9)
    rows = [(k, v) for k in range(40) for v in range(300) if rng.random() < 0.9] + [(100 + v, w) for v in range(300) for w in (v, 1000 + v)]
    n = Counter(k for k, _ in rows)
    found = omh.families(spark.createDataFrame([(k, v, 10, v, n[k]) for k, v in rows], "key long, node long, n_words int, root long, n long")).collect()
    assert sorted((k, r.node) for r in found for k in r.owned) == sorted(rows)  # every key with all of its nodes, once
    assert len({(r.family, r.node) for r in found}) == len(found)
    at = {}
    for r in found:
        for k in r.owned:
            assert at.setdefault(k, r.family) == r.family
    assert len({at[k] for k in range(40)}) == 1 and sum(r.family == at[0] for r in found) == 300
    assert len(found) == 900
