"""Removal of long passages that repeat across documents, by suffix arrays.

A byte goes when a ``LENGTH``-byte string over it also starts in a document with a smaller id. Suffixes
of the whole corpus would be some fifty times its size, so work is dealt out by content first:

1. The key of a window (``LENGTH`` bytes) is the least hash of its ``GRAM``-byte grams. Equal windows have
   equal keys, and neighbours mostly share theirs: a run of windows with one key is a segment.
   Each batch of documents sends its distinct keys, with the buckets of documents they occur in, to the
   key's owner, which returns to those buckets the keys that two documents or more hold.
2. Segments with such keys, once per distinct text in a bucket and with the smallest id that holds
   them, go to the key's shard. Windows of very frequent keys go one by one, dealt by their own hash.
3. A shard builds suffix arrays over blocks of its segments (Larsson-Sadakane refinement), Kasai's
   algorithm gives common prefixes, and neighbours that share ``LENGTH`` bytes form one class whose
   smallest id is known; classes of different blocks are merged by binary search in their sorted
   windows. Smaller ids found go back to the bucket.
4. Each bucket of documents marks the windows whose smallest id is below the document's own.

All arrays travel packed in binary columns. No task holds more than a bucket, a key's owners' lists
(one entry per batch at most) or a shard; the numbers of buckets and shards follow the input's bytes.

Defined results: a null text is empty; matches never cross documents; a null id counts as larger than
any other; rows that share an id never remove one another, whatever their texts; equal rows get equal
results, one row per input row; texts shorter than ``LENGTH`` bytes stay whole; an empty table gives an
empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

LENGTH = 50
GRAM = 16
#: Bytes of text in a bucket of documents, about, of segments in a part of a shard's keys, about, and of
#: segments that one suffix array holds at most.
BUCKET_BYTES = 4 << 20
PART_BYTES, BLOCK_BYTES = 1 << 20, 4 << 20
#: A key held by more rows than this has its windows dealt one by one.
HOT_ROWS = 5000

U64 = np.uint64
#: Odd multipliers of the gram hash and the text hash.
MIX = tuple(U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
NO_ID = np.iinfo(np.int64).max
#: Keys travel as 6 bytes: the low ones, as the least of many hashes has few high bits.
KEY_BITS = U64((1 << 48) - 1)


# -- suffix arrays ---------------------------------------------------------------------------------


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(U64)


def dense_words(data: np.ndarray) -> tuple[np.ndarray, int]:
    """(first symbols of each suffix as one number, how many they are).

    Bytes are renumbered from one in their order, so that as many as possible fit; zero is the end.
    """
    used = np.flatnonzero(np.bincount(data, minlength=256))
    bits = max(1, int(len(used)).bit_length())
    code = np.zeros(256, U64)
    code[used] = np.arange(1, len(used) + 1)
    n, want, have = len(data), 64 // bits, 1
    powers = [(1, np.append(code[data], np.zeros(want, U64)))]
    while 2 * have <= want:
        x = powers[-1][1]
        y = x << U64(bits * have)
        y[:-have] |= x[have:]
        have *= 2
        powers.append((have, y))
    out = powers[-1][1]
    for size, x in reversed(powers[:-1]):
        if have + size <= want:
            out = out << U64(bits * size)
            out[:-have] |= x[have:]
            have += size
    return out[:n], have


def larsson_sadakane(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix).

    Ranks by the first symbols come from one sort; then only groups that are not yet single are refined
    by the rank of the suffix h further on, and h doubles. A group's rank is the place of its last
    member, so refining never disturbs others. A suffix that ends sorts before its extensions.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    words, h = dense_words(data)
    sa = np.argsort(words).astype(np.int32)
    key = words[sa]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    del words, key
    rank = np.empty(n, np.int32)

    def last_of(head: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(head).astype(np.int32)
        stops = np.append(starts[1:], np.int32(len(head))) - np.int32(1)
        return np.repeat(stops, stops - starts + 1)

    group = last_of(head)
    rank[sa] = group
    while True:
        single = head & np.append(head[1:], True)
        todo = np.flatnonzero(~single)
        if not len(todo):
            break
        at = sa[todo]
        nxt = at + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        again = np.argsort((group[todo].astype(np.int64) << 32) | second)  # one sort by (group, second)
        at, second = at[again], second[again]
        sa[todo] = at
        split = head[todo]
        split[1:] |= second[1:] != second[:-1]
        head[todo] = split
        group = last_of(head)
        rank[sa[todo]] = group[todo]
        h *= 2
    return sa, rank


def kasai(data: np.ndarray, sa: np.ndarray, cap: int, lane: int = 64) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, counted up to ``cap``.

    Kasai's chain in text order: a suffix shares at least one byte less than the suffix before it
    did. The chain runs in lanes of ``lane`` positions side by side; eight bytes are compared at once.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    word = np.append(words8(data), np.zeros(cap + 16, U64))
    out = np.zeros(n, np.int64)
    begin = np.arange(0, n, lane)
    h = np.zeros(len(begin), np.int64)
    for step in range(lane):
        i = begin + step
        live = i < n
        if not live.all():
            begin, h, i = begin[live], h[live], i[live]
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(h - 1, 0))
        room = np.minimum(cap, n - np.maximum(i, j))  # neither suffix reads past the end
        act = np.flatnonzero((j >= 0) & (h < room))
        while len(act):
            x = word[i[act] + h[act]] ^ word[j[act] + h[act]]
            same = np.full(len(act), 8, np.int64)
            odd = np.flatnonzero(x)
            if len(odd):
                lead = np.frexp((x[odd] >> U64(11)).astype(np.float64))[1] + 11
                lead = np.where(x[odd] >> U64(11) == 0, np.frexp(x[odd].astype(np.float64))[1], lead)
                same[odd] = (64 - lead) // 8
            h[act] = np.minimum(h[act] + same, room[act])
            act = act[(same == 8) & (h[act] < room[act])]
        out[i] = h
    return out[sa]


# -- windows, keys and segments --------------------------------------------------------------------


def window_keys(data: np.ndarray, chunk: int = 1 << 17) -> np.ndarray:
    """The least gram hash of each window of ``LENGTH`` bytes."""
    n, width = len(data) - LENGTH + 1, LENGTH - GRAM + 1
    out = np.empty(max(n, 0), U64)
    for lo in range(0, n, chunk):
        hi = min(lo + chunk, n)
        w = words8(data[lo : hi + LENGTH - 1])
        m = len(w) - GRAM + 1
        g = w[:m] * MIX[0]
        g ^= g >> U64(31)
        g += w[8 : m + 8]
        g *= MIX[1]
        g ^= g >> U64(29)
        g *= MIX[2]
        g ^= g >> U64(32)
        size = 1
        while 2 * size <= width:
            g = np.minimum(g[:-size], g[size:])
            size *= 2
        if size < width:
            g = np.minimum(g[: len(g) - (width - size)], g[width - size :])
        out[lo:hi] = g[: hi - lo]
    return out


class Texts:
    """Texts of a batch end to end, and the runs of equal keys among their windows."""

    def __init__(self, column: pa.Array | pa.ChunkedArray) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if column.null_count:
            column = column.fill_null(b"")
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        self.edge = offsets - offsets[0]
        self.data = data[offsets[0] : offsets[-1]]
        self.length = np.diff(self.edge)
        n = len(self.data) - LENGTH + 1
        if n <= 0:
            self.start = self.count = self.row = np.zeros(0, np.int64)
            self.key = np.zeros(0, U64)
            return
        keys = window_keys(self.data)
        change = np.ones(n, bool)
        change[1:] = keys[1:] != keys[:-1]
        # Windows that would cross into the next text belong to no run.
        inside = np.ones(n, bool)
        cut = self.edge[1:-1]
        for back in range(1, LENGTH):
            at = cut - back
            at = at[(at >= 0) & (at < n)]
            inside[at] = False
        first = self.edge[:-1][self.length > 0]
        change[first[first < n]] = True
        change &= inside
        change[1:] |= inside[1:] & ~inside[:-1]
        start = np.flatnonzero(change)
        stop = np.append(start[1:], n)
        good = np.append(0, np.cumsum(inside))
        self.start, self.count = start, good[stop] - good[start]
        self.key = keys[start] & KEY_BITS
        self.row = np.searchsorted(self.edge, start, side="right") - 1


def flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each stretch, end to end."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.ones(total, np.int64)
    at = np.append(0, np.cumsum(size)[:-1])
    some = size > 0
    s, at, size = start[some], at[some], size[some]
    jump[at[0]] = s[0]
    jump[at[1:]] = s[1:] - (s[:-1] + size[:-1] - 1)
    return np.cumsum(jump)


def text_hash(word: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of the text whose ``words8`` are given, word after word."""
    n = len(start)
    out = np.full(n, MIX[3], U64) * (size.astype(U64) + U64(1))
    if not n:
        return out
    live = np.arange(n)
    for at in range(0, int(size.max()), 8):
        live = live[size[live] > at]
        left = np.minimum(size[live] - at, 8)
        w = word[start[live] + at] >> (U64(64) - left.astype(U64) * U64(8))
        h = (out[live] ^ (w * MIX[0])) * MIX[1]
        out[live] = h ^ (h >> U64(29))
    return out


def distinct(data: np.ndarray, word: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representatives, number of each stretch's representative): stretches of equal bytes are one.

    They are told apart by 64-bit hash, length and first bytes; what does not agree stands for itself.
    """
    hashes = text_hash(word, start, size)
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = order[new]
    like = first[inverse]
    head = np.minimum(size, 8)
    wrong = np.flatnonzero((size[like] != size) | (data[start] != data[start[like]]) | (data[start + head - 1] != data[start[like] + head - 1]))
    if len(wrong):
        inverse[wrong] = len(first) + np.arange(len(wrong))
        first = np.append(first, wrong)
    return first, inverse


# -- the shard: smallest id of each window ---------------------------------------------------------


def block_classes(data: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window positions, class of each, smallest id of each class) for one block of segments."""
    sa, _ = larsson_sadakane(data)  # in full: Kasai's chain holds only for a complete order
    lcp = kasai(data, sa, LENGTH)
    owner = np.full(len(data), -1, np.int64)
    at = flat(start, count)
    owner[at] = np.repeat(np.arange(len(start)), count)
    group = np.cumsum(lcp < LENGTH) - 1
    mine = owner[sa]
    use = np.flatnonzero(mine >= 0)
    classes, number = np.unique(group[use], return_inverse=True)
    least = np.full(len(classes), NO_ID, np.int64)
    np.minimum.at(least, number, ids[mine[use]])
    return sa[use], number, least


def least_ids(data: np.ndarray, count: np.ndarray, ids: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
    """For segments laid end to end, the smallest id that holds each window, segment by segment."""
    size = count + LENGTH - 1
    start = np.append(0, np.cumsum(size)[:-1])
    out_at = np.append(0, np.cumsum(count))
    out = np.empty(int(out_at[-1]), np.int64)
    bounds, lo = [], 0
    total = np.cumsum(size)
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + block, side="right")))
        bounds.append((lo, hi))
        lo = hi
    held = []
    for lo, hi in bounds:
        base = start[lo]
        part = data[base : base + size[lo:hi].sum()]
        pos, number, least = block_classes(part, start[lo:hi] - base, count[lo:hi], ids[lo:hi])
        place = np.full(len(part), -1, np.int64)
        place[flat(start[lo:hi] - base, count[lo:hi])] = np.arange(out_at[lo], out_at[hi])
        # Positions come in suffix order, so the classes' first windows are sorted.
        head = pos[np.flatnonzero(np.append(True, number[1:] != number[:-1]))] if len(number) else pos
        held.append((part, head, least, place[pos], number))
    if len(held) > 1:
        merge_blocks([(p, h, m) for p, h, m, *_ in held])
    for _, _, least, place, number in held:
        out[place] = least[number]
    return out


def window_strings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data[at[:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()


def merge_blocks(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Give classes of different blocks that hold the same window their common smallest id, in place.

    Each block's windows are sorted; the sorted union of those seen so far is searched by halving.
    """
    seen, least = np.zeros(0, f"S{LENGTH}"), np.zeros(0, np.int64)
    for data, head, ids in blocks:
        strings = window_strings(data, head)
        at = np.searchsorted(seen, strings)
        found = np.flatnonzero(at < len(seen))
        found = found[seen[at[found]] == strings[found]]
        least[at[found]] = np.minimum(least[at[found]], ids[found])
        new = np.setdiff1d(np.arange(len(strings)), found, assume_unique=True)
        seen, least = np.insert(seen, at[new], strings[new]), np.insert(least, at[new], ids[new])
    for data, head, ids in blocks:
        ids[:] = least[np.searchsorted(seen, window_strings(data, head))]


# -- the steps on Spark ----------------------------------------------------------------------------


def owner_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U64(16)) % U64(n)).astype(np.int64)


def split_by(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, places) of each owner that occurs, places in their order."""
    order = np.argsort(owner, kind="stable")
    cut = np.flatnonzero(np.diff(owner[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(owner[part[0]]), part


_zstd: list = []


def codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair a process: messages are many and small, and a context costs more than most of them."""
    if not _zstd:
        _zstd.append((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _zstd[0]


def packed(values: np.ndarray, kind: type | None = None) -> bytes:
    return codec()[0].compress(np.ascontiguousarray(values if kind is None else values.astype(kind)))


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    d = codec()[1]
    return np.frombuffer(b"".join(d.decompress(x) for x in column.to_pylist()), kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Six bytes a key; hashes do not compress."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def joined_keys(column: pa.ChunkedArray) -> np.ndarray:
    six = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(U64).ravel()


def _batch(**columns) -> pa.Table:
    return pa.table(columns)


def _send_keys(n_owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                texts = Texts(part.column(1))
                bucket = np.asarray(part.column(0)).astype(np.int64)
                # Each key once for each row; then once for each bucket, with its number of rows.
                order = np.lexsort((texts.row, texts.key))
                key, row = texts.key[order], texts.row[order]
                one = np.ones(len(key), bool)
                one[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key, of = key[one], bucket[row[one]]
                order = np.lexsort((of, key))
                key, of = key[order], of[order]
                one = np.ones(len(key), bool)
                one[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                first = np.flatnonzero(one)
                rows = np.diff(np.append(first, len(key)))
                order = np.lexsort((key[first], of[first]))  # buckets and numbers then pack into next to nothing
                key, of, rows = key[first][order], of[first][order], rows[order]
                out = [(o, packed_keys(key[p]), packed(of[p], np.int32), packed(rows[p], np.int32)) for o, p in split_by(owner_of(key, n_owners))]
                if out:
                    o, k, b, r = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32()), pa.array(k, pa.binary()), pa.array(b, pa.binary()), pa.array(r, pa.binary())], names=["owner", "keys", "buckets", "rows"])

    return run


def slices(batch: pa.RecordBatch, text: int, most: int = BUCKET_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of about ``most`` bytes of text."""
    size = np.cumsum([len(v) if v is not None else 0 for v in (x.as_buffer() for x in batch.column(text))]) if batch.num_rows else np.zeros(0)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _return_shared(hot_rows: int):
    return lambda table: _shared_keys(table, hot_rows)


def _shared_keys(table: pa.Table, hot_rows: int) -> pa.Table:
    keys, buckets, rows = joined_keys(table["keys"]), joined(table["buckets"], np.int32), joined(table["rows"], np.int32)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    total = np.add.reduceat(rows[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    good = total[number] >= 2
    keys, buckets, hot = sorted_keys[good], buckets[order][good], (total[number] > hot_rows)[good]
    pair = np.lexsort((keys, buckets))
    keys, buckets, hot = keys[pair], buckets[pair], hot[pair]
    one = np.ones(len(keys), bool)
    one[1:] = (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])
    keys, buckets, hot = keys[one], buckets[one], hot[one]
    out = [(b, packed_keys(keys[p]), packed(hot[p])) for b, p in split_by(buckets.astype(np.int64))]
    b, k, h = zip(*out, strict=True) if out else ((), (), ())
    return _batch(bucket=pa.array(b, pa.int32()), keys=pa.array(k, pa.binary()), hot=pa.array(h, pa.binary()))


class Shared:
    """The segments of a bucket whose keys other documents hold too, once per distinct text."""

    def __init__(self, docs: pa.Table, keys: np.ndarray, hot: np.ndarray) -> None:
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        self.texts = t = Texts(docs["text"])
        self.ids = np.asarray(docs["id"].combine_chunks().fill_null(NO_ID)).astype(np.int64)
        at = np.searchsorted(keys, t.key)
        at[at == len(keys)] = 0
        use = np.flatnonzero(keys[at] == t.key) if len(keys) else np.zeros(0, np.int64)
        start, count, key, row, is_hot = t.start[use], t.count[use], t.key[use], t.row[use], hot[at[use]].astype(bool) if len(keys) else np.zeros(0, bool)
        # Windows of very frequent keys stand alone.
        alone = np.flatnonzero(is_hot)
        single = flat(start[alone], count[alone])
        self.start = np.append(start[~is_hot], single)
        self.count = np.append(count[~is_hot], np.ones(len(single), np.int64))
        self.row = np.append(row[~is_hot], np.repeat(row[alone], count[alone]))
        word = words8(t.data)
        key = np.append(key[~is_hot], text_hash(word, single, np.full(len(single), LENGTH)) & KEY_BITS)
        self.first, self.number = distinct(t.data, word, self.start, self.count + LENGTH - 1)
        self.key = key[self.first]
        self.least = np.full(len(self.first), NO_ID, np.int64)
        np.minimum.at(self.least, self.number, self.ids[self.row])


def _of_bucket(docs: pa.Table, sent: pa.Table) -> Shared:
    return Shared(docs, joined_keys(sent["keys"]), joined(sent["hot"], np.uint8))


def _send_segments(n_shards: int):
    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            s = _of_bucket(docs, sent)
            bucket = docs["bucket"][0].as_py()
            start, count = s.start[s.first], s.count[s.first]
            for shard, p in split_by(owner_of(s.key, n_shards)):
                bytes_of = s.texts.data[flat(start[p], count[p] + LENGTH - 1)]
                rows.append((shard, bucket, packed(bytes_of), packed(count[p], np.int32), packed(s.least[p]), packed(p, np.int32), packed(s.key[p] & U64(255), np.uint8)))
        cols = zip(*rows, strict=True) if rows else [()] * 7
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "bucket", "data", "counts", "ids", "numbers", "subs"])

    return run


def window_hashes(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``LENGTH`` bytes from each place of the text whose ``words8`` are given."""
    out = np.full(len(at), MIX[3], U64)
    for skip in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # the last word overlaps the one before
        out ^= word[at + skip] * MIX[0]
        out *= MIX[1]
        out ^= out >> U64(29)
    return out


def repeated_runs(word: np.ndarray, start: np.ndarray, count: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, windows before it, windows) of each run of windows whose hash two windows or more have.

    Equal windows have equal hashes, so what is left out equals no other window and needs no suffix array; what stays is
    compared byte by byte there.
    """
    hashes = window_hashes(word, flat(start, count))
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    keep = np.zeros(len(hashes) + 1, bool)
    keep[order[1:][same]] = keep[order[:-1][same]] = True
    edge = np.append(0, np.cumsum(count))
    begins = keep[:-1].copy()
    begins[1:] &= ~keep[:-2]
    begins[edge[:-1]] = keep[edge[:-1]]  # a run ends with its segment
    ends = keep[:-1].copy()
    ends &= ~keep[1:]
    ends[edge[1:] - 1] = keep[edge[1:] - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(edge, begin, side="right") - 1
    return names[owner], begin - edge[owner], end - begin


def key_parts(sub: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of segments of about ``PART_BYTES``, dealt by a byte of their keys: equal windows fall into one part."""
    part = sub * max(1, min(256, -(-int(size.sum()) // PART_BYTES))) >> 8
    return (p for _, p in split_by(part))


def _search_shard(table: pa.Table) -> pa.Table:
    data = joined(table["data"], np.uint8)
    unpack = codec()[1].decompress
    parts = [np.frombuffer(unpack(x), np.int32) for x in table["counts"].to_pylist()]
    sizes = [len(x) for x in parts]
    count = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    ids, number = joined(table["ids"], np.int64), joined(table["numbers"], np.int32)
    bucket = np.repeat(np.asarray(table["bucket"]).astype(np.int64), sizes)
    size = count + LENGTH - 1
    start = np.append(0, np.cumsum(size)[:-1])
    # Other buckets sent many of these segments too: each text is searched once, for its smallest id.
    word = words8(data)
    first, like = distinct(data, word, start, size)
    least = np.full(len(first), NO_ID, np.int64)
    np.minimum.at(least, like, ids)
    # Different keys never hold equal windows: parts of the keys are searched one after another.
    sub = joined(table["subs"], np.uint8)[first].astype(np.int64)
    start, size, held = start[first], size[first], count[first]
    at = np.append(0, np.cumsum(held)[:-1])
    found = np.repeat(least, held)  # that of the segment, for windows that no other place has
    runs = []
    for p in key_parts(sub, size):
        runs.append(repeated_runs(word, start[p], held[p], p))
    owner, skip, run = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 3
    for p in key_parts(sub[owner], run + LENGTH - 1):
        o = owner[p]
        found[flat(at[o] + skip[p], run[p])] = least_ids(data[flat(start[o] + skip[p], run[p] + LENGTH - 1)], run[p], least[o])
    mine = flat(at[like], count)
    result = found[mine]
    edge = np.append(0, np.cumsum(count)[:-1])
    del word
    news = np.flatnonzero(np.minimum.reduceat(result, edge) < ids) if len(ids) else np.zeros(0, np.int64)
    rows = []
    for b, p in split_by(bucket[news]):
        p = news[p]
        rows.append((b, packed(number[p]), packed(result[flat(edge[p], count[p])])))
    b, n, m = zip(*rows, strict=True) if rows else ((), (), ())
    return _batch(bucket=pa.array(b, pa.int32()), numbers=pa.array(n, pa.binary()), least=pa.array(m, pa.binary()))


def _mark(docs: pa.Table, sent: pa.Table) -> pa.Table:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    if not docs.num_rows:
        return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span)], names=names)
    keys = sent.filter(pa.compute.is_valid(sent["keys"]))
    news = sent.filter(pa.compute.is_valid(sent["numbers"]))
    s = _of_bucket(docs, keys)
    t = s.texts
    count = s.count[s.first]
    at = np.append(0, np.cumsum(count))
    least = np.repeat(s.least, count)
    number = joined(news["numbers"], np.int32).astype(np.int64)
    least[flat(at[number], count[number])] = joined(news["least"], np.int64)
    window = flat(s.start, s.count)
    gone = window[least[flat(at[s.number], s.count)] < np.repeat(s.ids[s.row], s.count)]
    n = len(t.data)
    change = np.zeros(n + 1, np.int32)
    change[gone] = 1
    np.add.at(change, np.minimum(gone + LENGTH, n), -1)
    covered = np.cumsum(change[:n]) > 0
    # Neighbouring texts may both be covered at their common edge: each text is read on its own.
    out = []
    for i, (lo, hi) in enumerate(zip(t.edge[:-1], t.edge[1:], strict=True)):
        c = covered[lo:hi]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]]))) if hi > lo else np.zeros(0, np.int64)
        kept = t.data[lo:hi][~c] if len(edge) else t.data[lo:hi]
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
        out.append((int(hi - lo), int(c.sum()), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans))
    cols = list(zip(*out, strict=True))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
    return pa.table([docs["id"].combine_chunks(), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


MARKED = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, removed: byte spans) of each row."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    sent = rows.select("bucket", "text").mapInArrow(_send_keys(n), "owner int, keys binary, buckets binary, rows binary")
    shared = materialise(sent.groupBy("owner").applyInArrow(_return_shared(hot_rows), "bucket int, keys binary, hot binary"), "repeats")
    dealt = rows.select("bucket", "id", "text").groupBy("bucket")
    segments = dealt.cogroup(shared.groupBy("bucket")).applyInArrow(_send_segments(n), "shard int, bucket int, data binary, counts binary, ids binary, numbers binary, subs binary")
    news = segments.groupBy("shard").applyInArrow(_search_shard, "bucket int, numbers binary, least binary")
    both = shared.select("bucket", "keys", "hot", F.lit(None).cast("binary").alias("numbers"), F.lit(None).cast("binary").alias("least")).unionByName(news, allowMissingColumns=True)
    marked = dealt.cogroup(both.groupBy("bucket")).applyInArrow(_mark, MARKED)
    return marked.withColumnRenamed("id", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept bytes) of each row: the text without its removed spans, as binary."""
    found = find_repeats(docs, key, text).select(F.col(key).alias("k"), "kept_sha256", "n_bytes", "removed").distinct()
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    kept = F.expr("""aggregate(removed, struct(0L AS at, cast(array() AS array<binary>) AS parts),
        (acc, s) -> struct(s.end AS at, array_append(acc.parts, substring(t, int(acc.at + 1), int(s.start - acc.at))) AS parts),
        acc -> aggregate(array_append(acc.parts, substring(t, int(acc.at + 1))), cast('' AS binary), (a, b) -> concat(a, b)))""")
    out = rows.join(found, F.col(key).eqNullSafe(F.col("k")) & (F.octet_length("t") == F.col("n_bytes"))).withColumn("kept", kept)
    return out.filter(F.sha2("kept", 256) == F.col("kept_sha256")).select(key, "kept")
