"""Alignment of two tokenizers' tokens by their byte ranges.

Each side's tokens end somewhere in the bytes of a text. The end events of both sides are united, dealt by document and
sorted by offset within partitions; one pass over them keeps a constant state (the token of each side that is open, the
group that is open) and emits a link at every distinct end, between the two tokens whose ranges meet below it, and a
group wherever both sides end. Events travel in runs: the ids of one side whose ends lie in one window of ``WINDOW``
bytes, and the id that is open at its end; ends follow from the lengths of the ids' bytes.

The links of some ``CHUNK_LINKS`` neighbours share a chunk. A chunk asks for the corpus-wide count of each id pair once,
so that a pair which every text holds is one row for each chunk and never one for each text.

Defined results: null and empty texts, and texts whose tokens of either side do not give back space + text byte for byte,
have no tokens: zeros and an empty digest. Repeated rows and ids give one row each and all count. A document of any
length passes through in windows; only its open group waits. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trim

WINDOW, CHUNK_LINKS = 4096, 1 << 18
A, B = 0, 1


def byte_table(path: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary, its characters decoded; of a piece model, by its pieces."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        return {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in vocab.items()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        out[i] = bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()
    return out


#: Characters that every edition of Unicode classes alike; texts of these alone are split by the fast pattern.
SETTLED = re.compile("[^\\x00-\u024f]")
#: How byte-level vocabularies split texts (a fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level(path: str, table: dict[int, bytes]) -> Callable[[str], list[int]]:
    """Ids of space + text by a byte-level file. Where ids follow the order of merges, a faster encoder of the same ranks
    serves the texts whose characters leave no doubt about the split."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.encode_special_tokens = True
    model.no_truncation()
    model.no_padding()
    slow = lambda text: model.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    merges = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
    plain = {"normalizer": None, "pre_tokenizer": ("ByteLevel", False, True)} == {"normalizer": parts.get("normalizer"), "pre_tokenizer": tuple((parts.get("pre_tokenizer") or {}).get(k, True) for k in ("type", "add_prefix_space", "use_regex"))}
    if not plain or any(parts["model"]["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        return slow
    import tiktoken

    ranks = {table[i]: i for i in range(256 + len(merges))}
    fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow(text) if SETTLED.search(text) else fast.encode_ordinary(" " + text)


def by_pieces(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by a piece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: model.encode(text, num_threads=1)


class Side:
    """One tokenizer with the bytes of its ids."""

    def __init__(self, path: str) -> None:
        table = byte_table(path)
        self.bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        #: The narrowest type that holds the ids, and each id as text in front of a comma, a bar and a semicolon.
        self.kind = np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32
        self.text = np.array([f"{i}{mark}" for i in range(len(self.bytes)) for mark in ",|;"], object)
        self.encode = byte_level(path, table) if path.endswith(".json") else by_pieces(path)

    def ids(self, text: str, whole: bytes) -> list[int] | None:
        """Ids of a text, or None if their bytes are not ``whole``."""
        ids = self.encode(text)
        return ids if b"".join(map(self.bytes.__getitem__, ids)) == whole else None


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


EVENTS = "row long, window int, side int, at long, ids binary, carry int, last boolean"


def events(docs: DataFrame, paths: tuple[str, str] | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, mark, row, window, side, at, ids, carry, last): runs of end events of both sides. ``row`` and ``mark`` tell
    rows apart; ``at``: where the run's first token starts; ``carry``: the id that is open at the window's end (-1: none).
    A text without tokens has one run of each side without ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [side(p) for p in paths or default_paths()]
        names = ["key", "mark", *(x.split()[0] for x in EVENTS.split(", "))]
        types = [None, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.bool_()]
        row = TaskContext.get().partitionId() << 40
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, 64):  # ids as Python integers weigh ten times their text
                batch = whole_batch.slice(first, 64)
                out: list[list] = [[] for _ in names]
                for i, (value, mark) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    row += 1
                    whole = b" " + value.encode() if value else b""
                    found = [s.ids(value, whole) if value else None for s in both]
                    good = all(x is not None for x in found)
                    for k, s in enumerate(both):
                        ids = np.array(found[k] if good else [], s.kind)
                        ends = np.cumsum(s.lengths[ids])
                        n = max(1, -(-len(whole) // window)) if good else 1
                        # An end at a window's last byte belongs to it: windows are (w * size, (w + 1) * size].
                        cuts = np.searchsorted(ends, np.arange(n + 1) * window, side="right") if good else [0, 0]
                        cuts[-1] = len(ids)
                        for w in range(n):
                            a, b = int(cuts[w]), int(cuts[w + 1])
                            part = (i, mark, row, w, k, int(ends[a - 1]) if a else 0, ids[a:b].tobytes(), int(ids[b]) if b < len(ids) else -1, w == n - 1)
                            for column, x in zip(out, part, strict=True):
                                column.append(x)
                keys = batch.column(0).take(pa.array(out[0], pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(out[1:], types[1:], strict=True))], names=names)
        trim()

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(run, f"key {kind}, mark long, {EVENTS}")


class Sweep:
    """The pass over one document's windows: the open tokens, the open group and running figures."""

    def __init__(self, sides: list[Side]) -> None:
        self.sides = sides
        self.n = [0, 0]
        self.groups = self.links = 0
        self.hash = hashlib.sha256()
        self.waiting: list[list[np.ndarray]] = [[], []]  # ids of the group that is open
        self.ended = ""  # the last group's text, held back for the mark behind it

    def window(self, runs: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
        """Take a window's run (ids, at, carry) of each side; give the A ids and B ids of its links."""
        ends = [at + np.cumsum(s.lengths[ids]) for (ids, at, _), s in zip(runs, self.sides, strict=True)]
        every = np.concatenate(ends)
        every.sort()
        same = every[1:] == every[:-1]
        both = every[1:][same]
        every = np.concatenate((every[:1], every[1:][~same]))
        pairs = []
        for (ids, _, carry), own, k in zip(runs, ends, (A, B), strict=True):
            self.n[k] += len(ids)
            pairs.append(np.append(ids.astype(np.int64), carry)[np.searchsorted(own, every)])
        self.links += len(every)
        self.groups += len(both)
        if len(both):
            cuts = [np.searchsorted(own, both, side="right") for own in ends]
            # The group that was open takes what comes up to the first common end.
            head = [len(w) for w in map(np.concatenate, ([*self.waiting[k], runs[k][0][:0]] for k in (A, B)))]
            ids = [np.concatenate([*self.waiting[k], runs[k][0][: cuts[k][-1]]]) for k in (A, B)]
            cuts_here = [c + h for c, h in zip(cuts, head, strict=True)]
            self.hash.update(self.ended.encode())
            text = self.told(ids, cuts_here)
            self.hash.update(text[:-1].encode())
            self.ended = ";"
            self.waiting = [[runs[k][0][cuts[k][-1] :]] for k in (A, B)]
        else:
            for k in (A, B):
                self.waiting[k].append(runs[k][0])
        return pairs

    def told(self, ids: list[np.ndarray], cuts: list[np.ndarray]) -> str:
        """Whole groups as text: the A ids of each, then its B ids. A token's place follows from the groups before it."""
        before = [np.concatenate(([0], c[:-1])) for c in cuts]
        out = np.empty(len(ids[A]) + len(ids[B]), object)
        for k, mark, shift in ((A, 1, before[B]), (B, 2, cuts[A])):
            place = np.arange(len(ids[k])) + np.repeat(shift, cuts[k] - before[k])
            which = ids[k].astype(np.int64) * 3
            which[cuts[k] - 1] += mark
            out[place] = self.sides[k].text[which]
        return "".join(out.tolist())

    def digest(self) -> str:
        return self.hash.hexdigest() if self.groups else ""


PARTS = "chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, distinct binary, sums binary"


def pair_kind(sides: list[Side]) -> type:
    """The narrowest type that holds a pair of ids."""
    return np.uint32 if len(sides[A].bytes) * len(sides[B].bytes) <= 1 << 32 else np.int64


def swept(sorted_events: DataFrame, kind: str, width: int, paths: tuple[str, str] | None = None, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(key, row, *PARTS): the figures of each document and its links in parts, from events in order of document and
    offset. A part has its id pairs (A id * ``width`` + B id) and how often each; the figures stand on a document's last
    part. A chunk's distinct pairs and their sums have a row of their own."""
    names = ["key", "row", *(x.split()[0] for x in PARTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [side(p) for p in paths or default_paths()]
        chunk = TaskContext.get().partitionId() << 32
        kind_of_pairs = pair_kind(both)
        out: list[tuple] = []
        asked: list[np.ndarray] = []  # distinct pairs of the parts of the chunk
        times: list[np.ndarray] = []
        n_links, weight, key_kind = 0, 0, None

        def emit() -> pa.RecordBatch:
            nonlocal out, weight
            types = [key_kind, pa.int64(), *[pa.int64()] * 5, pa.string(), *[pa.binary()] * 4]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out, weight = [], 0
            return batch

        def close_chunk() -> None:
            nonlocal chunk, n_links, asked, times, weight
            if asked:
                distinct, inverse = np.unique(np.concatenate(asked), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate(times)).astype(np.int64)
                out.append((None, None, chunk, None, None, None, None, None, None, None, distinct.astype(np.int64).tobytes(), sums.tobytes()))
                weight += len(distinct)
            chunk, n_links, asked, times = chunk + 1, 0, [], []

        def close_part(key: object, row: int, links: list[np.ndarray], sweep: Sweep, last: bool) -> None:
            nonlocal n_links, weight
            pairs, counts = np.unique(np.concatenate(links) if links else np.empty(0, np.int64), return_counts=True)
            figures = (*sweep.n, sweep.groups, sweep.links, sweep.digest()) if last else (None,) * 5
            out.append((key, row, chunk, *figures, pairs.astype(kind_of_pairs).tobytes(), counts.astype(np.int32).tobytes(), None, None))
            n_links, weight = n_links + int(counts.sum()), weight + len(pairs) + 16
            asked.append(pairs)
            times.append(counts)
            if n_links >= chunk_links:
                close_chunk()

        sweep, held, links, n_part = Sweep(both), [], [], 0
        for batch in batches:
            key_kind = batch.schema.field(0).type
            for key, row, k, at, ids, carry, last in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4, 5, 6, 7, 8)), strict=True):
                held.append((np.frombuffer(ids, both[k].kind), at, carry))
                if k == A:
                    continue
                a, b = sweep.window(held)
                held = []
                links.append(a * width + b)
                n_part += len(a)
                if last or n_part >= chunk_links:
                    close_part(key, row, links, sweep, last)
                    links, n_part = [], 0
                if last:
                    sweep = Sweep(both)
                if weight >= 1 << 17:
                    yield emit()
        close_chunk()
        if out:
            yield emit()
        trim()

    return sorted_events.mapInArrow(run, f"key {kind}, row long, {PARTS}")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, n) from rows (chunk, distinct, sums)."""
    for batch in batches:
        for chunk, pairs, sums in zip(*(batch.column(i) for i in range(3)), strict=True):
            pairs, sums = np.frombuffer(pairs.as_py(), np.int64), np.frombuffer(sums.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk.as_py(), np.int64)), pa.array(pairs), pa.array(sums)], names=["chunk", "pair", "n"])


def align(docs: DataFrame, paths: tuple[str, str] | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    kind = docs.schema[key].dataType.simpleString()
    sides = [side(p) for p in paths or default_paths()]
    width, packed = len(sides[B].bytes), np.dtype(pair_kind(sides))
    scratch = Scratch(docs.sparkSession)
    in_order = events(docs, paths, key, text, window).repartition("key", "mark").sortWithinPartitions("key", "mark", "row", "window", "side")
    parts = scratch.keep("aligned", swept(in_order, kind, width, paths, chunk_links))

    asked = parts.filter("distinct is not null").select("chunk", "distinct", "sums").mapInArrow(unpacked, "chunk long, pair long, n long")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = scratch.keep("pair_counts", counts.withColumn("b", F.pmod("pair", F.lit(width))))
    best = counts.groupBy("b").agg(F.max("count").alias("best"))  # at most one row an id of B
    known = counts.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    answers = asked.select("chunk", "pair").join(known, "pair")

    def of_chunk(_: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(pairs := told.column("pair").to_numpy())
        pairs, count, is_best = pairs[order], told.column("count").to_numpy()[order], told.column("is_best").to_numpy()[order]
        n_best, total = [], []
        for own, times in zip(texts.column("pairs").to_pylist(), texts.column("times").to_pylist(), strict=True):
            at, times = np.searchsorted(pairs, np.frombuffer(own, packed)), np.frombuffer(times, np.int32)
            n_best.append(int(times[is_best[at]].sum()) if len(at) else 0)
            total.append(int((times * count[at]).sum()) if len(at) else 0)
        return pa.table({"row": texts.column("row"), "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())} | {c: texts.column(c) for c in FIGURES}).select(["key", "row", *FIGURES[1:], "n_best", "count_sum"])

    FIGURES = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    told = parts.filter("distinct is null").select("chunk", "row", "pairs", "times", *FIGURES).groupBy("chunk").cogroup(answers.groupBy("chunk"))
    found = told.applyInArrow(of_chunk, f"key {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    # Most documents are one part; the parts of the others meet here.
    whole = found.groupBy("key", "row").agg(*(F.max(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return whole.drop("row").withColumnRenamed("key", key)
