"""Near-duplicates by Order MinHash, confirmed by banded alignment.

A text's words are runs of ASCII letters and digits and of non-ASCII bytes, in lower case. Its shingles
of ``SHINGLE`` words carry the number of their occurrence in the text, so repeats count. For each of
``BANDS`` seeds the ``TAKE`` smallest of the seeded shingle hashes are taken and laid in text order; that
sequence is one key. Pairs whose shingles agree to 0.8 practically always share a key, and so do nearly all pairs of
some forty words or more at edit similarity 0.85; texts with the same parts in another order share few. Two texts are
linked when the edit distance of their word sequences is at most ``1 - SIMILARITY`` of the longer one, by an
alignment in a band that doubles until it decides.

Equal texts (by 64-bit hash) form one class before anything else. Under every key that several classes hold:

1. the class of the smallest hash is the key's centre; classes with the same least centre are settled in chunks, each
   with the centre: pairs that share a key are aligned unless a bound rules them out or links already join them;
2. of the keys whose classes these links do not all join, those that hold mostly the same classes make a family;
   every pair of a family's classes is bounded by length and bags of words, which cannot miss a link; classes without a
   partner left drop out;
3. the classes left are settled as in step 1.

The same path serves keys of any size: the work of steps 1 to 3 is dealt in units of a bounded number of classes (a
chunk of a star, or a cell of two blocks of a family's classes), so no task holds a key, and a class that shares many
keys with the same others travels once for all of them. Every pair that shares a key is
so aligned, joined by links, or ruled out by a bound. Components are taken over all links.

Defined results: a null text is the empty text; texts without a word are near only to equal texts;
texts of fewer than ``SHINGLE`` words have their whole word sequence as one shingle; rows without an id
count as the largest id; rows that share an id but not the text are different documents; an empty
table gives an empty table; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, fresh, trim

SHINGLE = 5
BANDS, TAKE = 64, 2
SIMILARITY = 0.8
SLICE_BYTES = 2 << 20
#: Classes, about, in a chunk of a star, and in a block of a family's classes.
CHUNK, CELL = 256, 2048
#: Slots of the bags of words that rule out pairs before they are aligned.
BAG = 128
#: Salts that deal the holders of a key where they meet its row.
SALTS = 8

U64 = np.uint64
MIX = tuple(U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x94D049BB133111EB))
MOST = np.iinfo(np.uint64).max
#: Stands for a missing id.
NONE = (1 << 63) - 1
#: Bytes that words are made of: ASCII digits and letters, and all bytes of other characters.
IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX[1]
    x = (x ^ (x >> U64(27))) * MIX[4]
    return x ^ (x >> U64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in turn, number of words of each text)."""
    held = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(held) + b"\n" + b"\0" * 8, np.uint8)
    inside = IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.append(0, edge)
    start, stop = edge[::2], edge[1::2]
    word = data.astype(U64)
    for shift in (1, 2, 4):
        word[:-shift] |= word[shift:] << U64(8 * shift)
    size = stop - start
    out = size.astype(U64) * MIX[3]
    live = np.arange(len(start))
    at = 0
    while len(live):
        left = np.minimum(size[live] - at, 8).astype(U64)
        w = word[start[live] + at] << ((U64(8) - left) * U64(8))
        out[live] = mixed(out[live] ^ (w * MIX[0]))
        at += 8
        live = live[size[live] > at]
    ends = np.cumsum([len(b) + 1 for b in held])
    return out, np.diff(np.append(0, np.searchsorted(start, ends))).astype(np.int64)


def sketches(hashes: np.ndarray, count: np.ndarray, bands: int = BANDS, take: int = TAKE) -> np.ndarray:
    """(texts, bands) keys; rows of texts without words hold zeros."""
    n_texts = len(count)
    out = np.zeros((n_texts, bands), np.int64)
    first = np.append(0, np.cumsum(count)[:-1])
    shingles = np.where(count == 0, 0, np.maximum(count - SHINGLE + 1, 1))
    full = np.flatnonzero(shingles)
    if not len(full):
        return out
    size = shingles[full]
    begin = np.append(0, np.cumsum(size)[:-1])
    row = np.repeat(np.arange(len(full)), size)
    places = np.arange(len(row))
    spot = places - begin[row]  # of a shingle in its text
    at = spot + first[full][row]
    end = (first + count)[full][row]
    grams = np.zeros(len(row), U64)
    padded = np.append(hashes, np.zeros(SHINGLE, U64))
    for k in range(SHINGLE):
        part = np.where(at + k < end, padded[at + k], U64(0))
        grams = (grams ^ part) * MIX[k] + U64(k)
    grams = mixed(grams)
    # Number equal shingles of a text in text order.
    order = np.lexsort((grams, row))
    new = np.ones(len(row), bool)
    new[1:] = (grams[order][1:] != grams[order][:-1]) | (row[order][1:] != row[order][:-1])
    occurrence = np.empty(len(row), np.int64)
    occurrence[order] = places - np.maximum.accumulate(np.where(new, places, 0))
    labelled = mixed(grams + occurrence.astype(U64) * MIX[0])
    # The low bits of a seeded hash make room for the shingle's place, so that the least hash names it.
    bits = U64(max(24, int(size.max()).bit_length()))
    low, place = (U64(1) << bits) - U64(1), spot.astype(U64)
    seeds = mixed(np.arange(1, bands + 1, dtype=U64) * MIX[2]) | U64(1)
    v = np.empty_like(labelled)
    for b in range(bands):
        np.multiply(labelled, seeds[b], out=v)
        v &= ~low
        v |= place
        spots = np.full((take, len(full)), -1, np.int64)
        for k in range(take):
            least = np.minimum.reduceat(v, begin)
            more = size > k
            spots[k, more] = (begin + (least & low).astype(np.int64))[more]
            v[spots[k, more]] = MOST
        spots.sort(axis=0)  # text order; texts with fewer shingles keep -1 in front
        key = np.full(len(full), seeds[b])
        for k in range(take):
            key = mixed(key * MIX[3] + np.where(spots[k] >= 0, labelled[spots[k]], U64(k)))
        out[full, b] = key.astype(np.int64)
    return out


# -- alignment -------------------------------------------------------------------------------------


def banded(a: list[np.ndarray], b: list[np.ndarray], band: int, most: np.ndarray) -> np.ndarray:
    """Edit distances of pairs side by side, exact where at most ``band``, else above it.

    ``most``: distances above it need not be exact either; the sweep ends when all pairs are above.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, width = int(n.max()), 2 * band + 1
    kind = np.int16 if rows + 2 * band < 8000 else np.int32  # no cost exceeds rows + width below "big"
    big = kind(1 << 14) if kind is np.int16 else kind(1 << 29)
    left = np.zeros((len(a), rows + 1), U64)
    right = np.full((len(a), rows + 2 * band + 2), MOST, U64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, 1 : len(x) + 1] = x
        y = y[: rows + band + 1]
        right[i, band + 1 : band + 1 + len(y)] = y
    k = np.arange(width, dtype=kind)
    now = np.where(k >= band, k - band, big)[None, :].repeat(len(a), 0).astype(kind)
    out = np.full(len(a), 1 << 29, np.int32)
    ends = m - n + band
    fits = (ends >= 0) & (ends < width)
    done = np.flatnonzero(fits & (n == 0))
    out[done] = now[done, ends[done]]
    for i in range(1, rows + 1):
        new = np.minimum(now, big) + (left[:, i, None] != right[:, i : i + width]).view(np.int8)
        new[:, :-1] = np.minimum(new[:, :-1], now[:, 1:] + 1)
        if i <= band:
            new[:, : band - i] = big
            new[:, band - i] = i
        new = np.minimum.accumulate(new - k, axis=1) + k
        if i <= band:
            new[:, : band - i] = big
        now = new
        done = np.flatnonzero(fits & (n == i))
        out[done] = now[done, ends[done]]
        if i % 32 == 0 and (now.min(1) > np.where(n > i, most, -1)).all() and (n[n > i].size > 0 or i >= rows):
            break
    return out


def distances(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray, group: int = 128) -> np.ndarray:
    """Edit distance of each pair where at most ``most``; anything above it otherwise."""
    out = np.zeros(len(a), np.int64)
    short_a, short_b, todo = list(a), list(b), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        n = min(len(x), len(y))
        # What both begin and end with needs no alignment.
        diff = np.flatnonzero(x[:n] != y[:n])
        head = int(diff[0]) if len(diff) else n
        x, y = x[head:], y[head:]
        n = min(len(x), len(y))
        diff = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
        tail = int(diff[0]) if len(diff) else n
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if not len(x) or not len(y):
            out[i] = len(x) + len(y)
            continue
        ux, cx = np.unique(x, return_counts=True)
        uy, cy = np.unique(y, return_counts=True)
        _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        least = max(len(x), len(y)) - int(np.minimum(cx[ix], cy[iy]).sum())
        if least > most[i]:  # words that the other text lacks are edits in any alignment
            out[i] = least
            continue
        short_a[i], short_b[i] = (x, y) if len(x) <= len(y) else (y, x)
        todo.append((i, max(least, 4)))
    todo.sort(key=lambda t: len(short_a[t[0]]))
    band = 8
    while todo:
        rest = []
        ready = [t for t in todo if t[1] <= band]
        rest += [t for t in todo if t[1] > band]
        step = max(1, min(group, (1 << 20) // (2 * band + 1)))
        for lo in range(0, len(ready), step):
            part = [t[0] for t in ready[lo : lo + step]]
            d = banded([short_a[i] for i in part], [short_b[i] for i in part], band, most[part])
            for i, x in zip(part, d, strict=True):
                if x <= band or band >= most[i]:
                    out[i] = x
                else:
                    rest.append((i, band + 1))
        todo = sorted(rest, key=lambda t: len(short_a[t[0]]))
        band *= 2
    return out


# -- the steps on Spark ----------------------------------------------------------------------------


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
        texts, lo = batch.column(2).to_pylist(), 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE_BYTES):
                size += len(texts[hi])
                hi += 1
            hashes, count = word_hashes(texts[lo:hi])
            keys = [k.tolist() if n else [] for k, n in zip(sketches(hashes, count), count, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(count, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "node", "n_words", "keys"])
            lo = hi
    trim()


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def similar(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether linked, similarity where linked) of pairs of word sequences."""
    longest = np.maximum([len(x) for x in a], [len(x) for x in b]).astype(np.int64)
    most = np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)
    d = distances(a, b, most)
    return d <= most, 1 - d / np.maximum(longest, 1)


def bags(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts, BAG) numbers of words in each slot."""
    at = np.repeat(np.arange(len(count)), count) * BAG + (hashes % U64(BAG)).astype(np.int64)
    return np.bincount(at, minlength=len(count) * BAG).reshape(-1, BAG).astype(np.int32)


class Pairs:
    """The pairs of a unit that a link may join: sides differ if the unit has several, components differ, and neither
    the lengths nor the bags (words of one slot count as equal, words that the other text lacks are edits) rule it out."""

    def __init__(self, bag: np.ndarray, side: np.ndarray, similarity: float) -> None:
        n_words = bag.sum(1, dtype=np.int64)
        self.order = np.argsort(n_words, kind="stable")
        self.bag, self.side, self.length = bag[self.order], side[self.order], n_words[self.order]
        self.across = len(side) > 0 and (side != side[0]).any()
        # Words that a partner, not longer than this text, must share.
        self.shared = self.length - np.floor((1 - similarity) * self.length + 1e-9).astype(np.int64)

    def of(self, i: int, comp: np.ndarray) -> np.ndarray:
        """Partners of the i-th text by length that come before it; places by length, those with most in common first."""
        lo = int(np.searchsorted(self.length, self.shared[i]))
        ok = comp[lo:i] != comp[i]
        if self.across:
            ok &= self.side[lo:i] != self.side[i]
        other = np.flatnonzero(ok) + lo
        if not len(other):
            return other
        both = np.concatenate([np.minimum(self.bag[other[at : at + 4096]], self.bag[i]).sum(1, dtype=np.int32) for at in range(0, len(other), 4096)])
        good = np.flatnonzero(both >= self.shared[i])
        return other[good[np.argsort(-both[good], kind="stable")]]


class Unit:
    """Nodes whose pairs are to be settled: those that share one of their ``keys``, and if the nodes own keys in the unit,
    those whose least common key is one of these."""

    def __init__(self, columns: tuple[list, ...], bag: np.ndarray, similarity: float) -> None:
        nodes, roots, sides, owners, keys = columns[:5]  # owners: of each node the keys that it has in this unit
        pairs = Pairs(bag, np.array(sides), similarity)
        self.order, self.nodes = pairs.order, nodes
        self.comp = np.unique(np.array(roots, np.int64)[pairs.order], return_inverse=True)[1].reshape(-1)
        self.todo: dict[int, np.ndarray] = {}
        own, owned = [np.array(keys[i], np.int64) for i in pairs.order], [owners[i] for i in pairs.order]
        for i in range(1, len(nodes)):
            other = pairs.of(i, self.comp)
            if not len(other):
                continue
            flat = np.concatenate([own[j] for j in other])
            least = np.minimum.reduceat(np.where(np.isin(flat, own[i]), flat, NONE), np.append(0, np.cumsum([len(own[j]) for j in other])[:-1]))
            other = other[least < NONE if owned[i] is None else np.isin(least, owned[i])]
            if len(other):
                self.todo[i] = other

    def asked(self) -> list[tuple[int, int]]:
        """For each text the next partner that links do not join with it yet."""
        out = []
        for i, other in list(self.todo.items()):
            other = other[self.comp[other] != self.comp[i]]
            if len(other):
                out.append((i, int(other[0])))
                self.todo[i] = other[1:]
            else:
                del self.todo[i]
        return out

    def join(self, i: int, j: int) -> None:
        self.comp[self.comp == self.comp[j]] = self.comp[i]


def settle(units: list[tuple[list, ...]], similarity: float) -> list[tuple[int, int, float]]:
    """Links of units (nodes, roots, sides, owned keys, keys, texts): every pair of a unit (see ``Unit``; across its sides, if
    it has several) is aligned, ruled out by a bound, or joined by links, given ones (equal roots) or found ones."""
    hashes, count = word_hashes([t for u in units for t in u[5]])
    words, bag = np.split(hashes, np.cumsum(count)[:-1]), bags(hashes, count)
    start = np.append(0, np.cumsum([len(u[0]) for u in units]))
    live = [(Unit(u, bag[lo : lo + len(u[0])], similarity), int(lo)) for u, lo in zip(units, start, strict=False)]
    links = []
    while live:
        todo = [(u, lo, i, j) for u, lo in live for i, j in u.asked()]
        for at in range(0, len(todo), 1024):
            part = [x for x in todo[at : at + 1024] if x[0].comp[x[2]] != x[0].comp[x[3]]]
            good, sim = similar([words[lo + u.order[i]] for u, lo, i, _ in part], [words[lo + u.order[j]] for u, lo, _, j in part], similarity) if part else ((), ())
            for (u, _, i, j), ok, x in zip(part, good, sim, strict=True):
                if ok:
                    links.append((u.nodes[u.order[i]], u.nodes[u.order[j]], float(x)))
                    u.join(i, j)
        live = [x for x in live if x[0].todo]
    return links


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit; those of one stand next to each other."""
    current, held = None, []
    for batch in batches:
        unit = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)] if len(unit) else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if held and unit[lo] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = unit[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _settle(similarity: float):
    """Rows (unit, node, root, side, owned, keys, text), those of a unit next to each other, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            links = settle(waiting, similarity)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*links, strict=True) if links else [()] * 3, LINKS, strict=True)], schema=LINKS)

        for table in by_unit(batches):
            waiting.append(tuple(table.column(k).to_pylist() for k in range(1, 7)))
            size += table.column(6).nbytes
            if size > SLICE_BYTES:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()
        del waiting
        trim()

    return run


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
        found = bags(*word_hashes(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(x.astype(np.uint16) if x.max() < 1 << 16 else x).tobytes() for x in found], pa.binary())], names=["node", "bag"])


def _near(similarity: float):
    """Of rows (unit, node, root, side, owned, bag), those of a unit next to each other, the ones with a partner that neither
    links nor bounds rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_unit(batches):
            table = table.combine_chunks()
            bag = np.stack([np.frombuffer(x, np.uint16 if len(x) == 2 * BAG else np.int32) for x in table.column(5).to_pylist()])
            pairs = Pairs(bag, table.column(3).to_numpy(), similarity)
            comp, marked = table.column(2).to_numpy()[pairs.order], np.zeros(len(bag), bool)
            for i in range(1, len(bag)):
                other = pairs.of(i, comp)
                marked[pairs.order[other]] = True
                marked[pairs.order[i]] |= len(other) > 0
            if marked.any():
                yield from table.select([0, 1, 2, 3, 4]).filter(pa.array(marked)).combine_chunks().to_batches()

    return run


def with_node(key: str, text: str) -> list[Column]:
    """id (largest where null), node (the hash that stands for the text) and text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.coalesce(F.col(key).cast("long"), F.lit(NONE)).alias("id"), F.xxhash64(t).alias("node"), t.alias("text")]


def meet(many: DataFrame, few: DataFrame, on: str, spread: str, how: str = "inner") -> DataFrame:
    """Join of ``many`` with the one row of ``few`` for each value of ``on``; rows of one value are dealt over
    ``SALTS`` tasks by a hash of ``spread``."""
    dealt = few.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(dealt, [on, "salt"], how).drop("salt")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with those of a unit next to each other."""
    return rows.repartition("unit").sortWithinPartitions("unit")


def families(rows: DataFrame) -> DataFrame:
    """(family, node, n_words, root, owned: its keys of the family) of rows (key, node, n_words, root, n: nodes of the key).

    Each node names the largest of its keys. A key joins the family of the key that its nodes name if all of them do, so
    that no node is added; or if most do and it is not much smaller, so that the family does not grow by many strangers
    who then meet all of it. Any other key is its own family. Every key is in one family with all of its nodes.
    """
    own = rows.groupBy("node").agg(F.collect_list(F.struct("n", "key")).alias("keys"), F.first("n_words").alias("n_words"), F.first("root").alias("root"))  # ``BANDS`` keys at most
    named = own.select("node", "n_words", "root", F.array_max("keys").alias("most"), F.explode("keys").alias("k")).select("node", "n_words", "root", "most", "k.key", "k.n")
    votes = named.groupBy("key", "most").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    best = votes.groupBy("key").agg(F.max(F.struct("c", "most")).alias("x"), F.first("n").alias("n"))
    joins = (F.col("x.c") == F.col("n")) | ((2 * F.col("x.c") > F.col("n")) & (4 * F.col("n") >= F.col("x.most.n")))
    best = best.select("key", F.when(joins, F.col("x.most.key")).otherwise(F.col("key")).alias("family"))
    return meet(named.select("key", "node", "n_words", "root"), best, "key", "node").groupBy("family", "node").agg(F.first("n_words").alias("n_words"), F.first("root").alias("root"), F.collect_list("key").alias("owned"))


def find_links(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, chunk: int = CHUNK, cell: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, roots): rows (id, node, n_words) has each row with its class of equal texts; links (a, b,
    similarity) joins the nodes of classes found similar; roots (v, root) has the smallest node of the component
    of each linked node."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(*with_node(key, text))
    rows = scratch.keep("sketches", texts.mapInArrow(_sketch, "id long, node long, n_words int, keys array<long>"))
    classes = rows.groupBy("node").agg(F.any_value("n_words").alias("n_words"), F.any_value("keys").alias("keys"))
    postings = classes.select(F.explode("keys").alias("key"), "node", "n_words")
    # A block of a key's classes holds about ``cell`` of them, and not too many words.
    several = postings.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.min(F.struct("node", "n_words")).alias("c")).filter("n > 1")
    size = lambda n, words, most: F.ceil(F.greatest(F.col(n) / most, F.col(words) / (most * 1000))).cast("int")
    several = several.select("key", "n", size("n", "words", chunk).alias("chunks"), F.col("c.node").alias("c"), F.col("c.n_words").alias("c_words"))
    left = scratch.keep("postings", meet(postings, several, "key", "node"))

    # Of each class that shares a key with another: one text, the keys it shares (``BANDS`` at most), and the least
    # centre of its keys; texts whose lengths are further apart cannot be linked.
    far = F.least("n_words", "c_words") < similarity * F.greatest("n_words", "c_words")
    nodes = left.groupBy("node").agg(F.collect_list("key").alias("keys"), F.min(F.when((F.col("node") != F.col("c")) & ~far, F.struct("c", "chunks"))).alias("star"))
    least = rows.groupBy("node").agg(F.min("id").alias("id")).join(nodes, "node")
    held = texts.join(least.hint("merge"), ["id", "node"]).groupBy("node").agg(F.any_value("star").alias("star"), F.any_value("keys").alias("keys"), F.any_value("text").alias("text"))
    held = scratch.keep("texts", held)

    # Stars: chunks of the classes of one centre, with the centre.
    pairs = held.filter("star is not null").select("star.*", "node")
    pairs = pairs.select("c", "node", F.xxhash64("c", "chunks", F.pmod("node", "chunks")).alias("unit"))
    sides = pairs.select("unit", "node").unionByName(pairs.select("unit", F.col("c").alias("node")).distinct())
    kind = "a long, b long, similarity double"
    stars = sides.join(held, "node").select("unit", "node", F.col("node").alias("root"), F.lit(0).alias("side"), F.lit(None).cast("array<long>").alias("owned"), "keys", "text")
    stars = scratch.keep("stars", dealt(stars).mapInArrow(_settle(similarity), kind))
    roots = scratch.keep("roots", components(stars.select("a", "b")))

    # Cells: of families of keys whose classes are not all joined, blocks of them against blocks.
    at = left.join(roots, F.col("node") == F.col("v"), "left").select("key", "node", "n_words", F.coalesce("root", "node").alias("root"))
    still = at.groupBy("key").agg((F.min("root") < F.max("root")).alias("open"), F.count("*").alias("n")).filter("open").select("key", "n")
    at = scratch.keep("families", families(meet(at, still, "key", "node")))
    sizes = at.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    at = meet(at.drop("n_words"), sizes.select("family", size("n", "words", cell).alias("blocks")), "family", "node")
    at = at.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = scratch.keep("cells", at.select(F.xxhash64("family", F.least("side", "other"), F.greatest("side", "other")).alias("unit"), "node", "root", "side", "owned"))
    signs = held.join(cells.select("node").distinct(), "node").select("node", "text").mapInArrow(_bags, "node long, bag binary")
    near = scratch.keep("near", dealt(cells.join(signs, "node").select("unit", "node", "root", "side", "owned", "bag")).mapInArrow(_near(similarity), "unit long, node long, root long, side int, owned array<long>"))
    across = scratch.keep("across", dealt(near.join(held, "node").select("unit", "node", "root", "side", "owned", "keys", "text")).mapInArrow(_settle(similarity), kind))
    if not across.isEmpty():
        roots = scratch.keep("all_roots", components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(across.select("a", "b"))))
    scratch.drop("postings", "texts", "families", "cells", "near")
    return rows.select("id", "node", "n_words"), stars.unionByName(across), roots


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, chunk: int = CHUNK, cell: int = CELL) -> DataFrame:
    """(id, node, n_words, least): each row with the smallest (id, node) of its class of near-duplicates."""
    rows, _, roots = find_links(docs, key, text, similarity, chunk, cell)
    out = meet(rows, roots.withColumnRenamed("v", "node"), "node", "id", "left").withColumn("root", F.coalesce("root", "node"))
    least = out.groupBy("root").agg(F.min(F.struct("id", "node")).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return meet(out, least, "root", "id", "left").select("id", "node", "n_words", F.coalesce("least", F.struct("id", "node")).alias("least"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, chunk: int = CHUNK, cell: int = CELL) -> DataFrame:
    """(key, component_id, kept, n_words): class id (its smallest id) of each row, and whether it stays."""
    out = classes_of(docs, key, text, similarity, chunk, cell)
    return out.select(
        F.when(F.col("id") != NONE, F.col("id")).alias(key),
        F.when(F.col("least.id") != NONE, F.col("least.id")).alias("component_id"),
        ((F.col("id") == F.col("least.id")) & (F.col("node") == F.col("least.node"))).alias("kept"),
        F.col("n_words").cast("long").alias("n_words"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class; all columns stay.

    Of repeated rows (equal id and text) that would stay, one does.
    """
    i, v, n, own_i, own_v = fresh(docs, "id", "node", "copies", "own_id", "own_node")
    roots = classes_of(docs, key, text, similarity).filter((F.col("id") == F.col("least.id")) & (F.col("node") == F.col("least.node")))
    roots = roots.groupBy(F.col("id").alias(i), F.col("node").alias(v)).agg(F.count("*").alias(n))
    own = with_node(key, text)
    marked = docs.select("*", own[0].alias(own_i), own[1].alias(own_v))
    held = Scratch(docs.sparkSession).keep("kept", marked.join(roots, (F.col(own_i) == F.col(i)) & (F.col(own_v) == F.col(v))).select(*docs.columns, i, v, n))
    once, again = held.filter(F.col(n) == 1), held.filter(F.col(n) > 1).dropDuplicates([i, v])
    return once.unionByName(again).select(*docs.columns)
