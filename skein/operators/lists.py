"""Exact nearest neighbours and similarity joins of vectors through inverted lists.

Centroids of a bounded sample (``SAMPLE`` rows) deal the normalised vectors into lists; a list's radius is the
distance of its furthest vector. A query visits the lists whose ball can hold a vector as near as it asks for, by the
triangle inequality, so nothing is missed: of a join the threshold, of a search the k-th best of its own list. Queries
meet the blocks of lists by an equi-join; queries are cut into chunks, and a chunk and a block are one matrix product.

Defined results: null, empty and zero vectors and those with null or non-finite components are similar to nothing;
vectors of different lengths never meet; repeated ids give one row a pair, the best; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import materialise

SAMPLE, LIST_ROWS, MOST_LISTS = 4096, 256, 1024
BLOCK, CHUNK = 1024, 256
#: Vectors of a block in a join, at most.
JOIN_ROWS = 16384
#: Vectors that a task holds against all centroids at once, and rows (a vector and a list that it visits) of a batch that it gives.
STEP, OUT_ROWS = 512, 4096
#: Bytes of vectors that a task of the meeting holds.
TASK_BYTES = 32 << 20
#: Slack for rounding in distances.
SLACK = 1e-6


def usable(vectors: DataFrame, key: str, vector: str, raw: bool = False) -> DataFrame:
    """(id, v): vectors that can be similar to others, of length one; ``raw``: (id, x, n), as they are and their lengths."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.col(vector).alias("x")).filter("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = rows.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("n > 0")
    return rows.select("id", "x", "n") if raw else rows.select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


class Lists:
    """Centroids, and the radius and number of vectors of each list; vectors of an odd length have a list of their own."""

    def __init__(self, rows: DataFrame) -> None:
        lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        self.width, n = (lengths.d, lengths.n) if lengths else (1, 0)
        sample = rows.filter(F.size("v") == self.width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
        x = matrix(sample, self.width) if n else np.zeros((1, 1))
        k = max(1, min(MOST_LISTS, n // LIST_ROWS, len(x)))
        self.centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(5):
            near = (x @ self.centres.T - 0.5 * (self.centres**2).sum(1)).argmax(1)
            total, count = np.zeros_like(self.centres), np.bincount(near, minlength=k)
            np.add.at(total, near, x)
            self.centres[count > 0] = total[count > 0] / count[count > 0, None]
        self.radius: dict[int, tuple[float, int]] = {}

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * (x @ self.centres.T), 0))

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, matrix) of the rows of each length, ``STEP`` at most; vectors in column 1."""
        sizes = np.asarray(batch.column(1).value_lengths())
        for d in np.unique(sizes):
            every = np.flatnonzero(sizes == d)
            for lo in range(0, len(every), STEP):
                at = every[lo : lo + STEP]
                yield int(d), at, matrix(batch.column(1).take(pa.array(at)), int(d))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """(list, far, id, v): the list of each vector and its distance from the centroid."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, at, x in self.parts(batch):
                    far = self.distances(x) if d == self.width else None
                    own = far.argmin(1) if far is not None else np.full(len(at), -d)
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(far.min(1) if far is not None else np.zeros(len(at))), part.column(0), part.column(1)], names=["list", "far", "id", "v"])

        return rows.select("id", "v").mapInArrow(run, "list long, far double, id long, v array<double>")

    def measured(self, dealt: DataFrame) -> None:
        """At most ``MOST_LISTS`` rows and one for each odd length."""
        self.radius = {r.list: (r.far, r.n) for r in dealt.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}

    def asked(self, queries: DataFrame, own_only: bool = False, onward: bool = False) -> DataFrame:
        """(list, id, v, least) for each list that a query (id, v, least) must visit; ``onward``: of lists other than its own
        only later ones, where the vectors of both are queries and either finds the pair."""
        radius = np.array([self.radius.get(i, (-np.inf, 0))[0] for i in range(len(self.centres))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, at, x in self.parts(batch):
                    part = batch.take(pa.array(at))
                    if d != self.width:
                        row, which = np.arange(len(at)), np.full(len(at), -d)
                    else:
                        far = self.distances(x)
                        reach = np.sqrt(np.maximum(2 - 2 * np.asarray(part.column(2)), 0)) + SLACK
                        row, which = (np.arange(len(at)), np.where(np.isfinite(radius), far, np.inf).argmin(1)) if own_only else np.nonzero((far - radius <= reach[:, None]) & (not onward or np.arange(far.shape[1]) >= far.argmin(1)[:, None]))
                    for lo in range(0, len(row), OUT_ROWS):  # a query may visit all lists: never all copies of a batch at once
                        some = part.take(pa.array(row[lo : lo + OUT_ROWS]))
                        yield pa.RecordBatch.from_arrays([pa.array(which[lo : lo + OUT_ROWS], pa.int64()), *some.columns], names=["list", "id", "v", "least"])

        return queries.select("id", "v", "least").mapInArrow(run, "list long, id long, v array<double>, least double")

    def met(self, dealt: DataFrame, asked: DataFrame, find, schema: str) -> DataFrame:
        """``find`` (queries, their least similarities, ids, similarities) of every chunk of queries and block of their list."""
        blocks = F.create_map(*(F.lit(x) for i, (_, n) in self.radius.items() for x in (i, -(-n // BLOCK)))) if self.radius else F.create_map(F.lit(0), F.lit(1))
        block = F.pmod(F.xxhash64("id"), F.element_at(blocks, F.col("list")).cast("long"))
        held = dealt.groupBy("list", block.alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
        counts = asked.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
        # Queries times lists bound what is asked; it grows faster than the vectors, so tasks grow with it.
        n = sum(n for _, n in self.radius.values())
        tasks = max(dealt.sparkSession.sparkContext.defaultParallelism, min(1 << 14, n * len(self.radius) * self.width * 8 // TASK_BYTES))
        wanted = asked.join(F.broadcast(counts), "list").withColumn("chunk", chunk).repartition(tasks, "list", "chunk").groupBy("list", "chunk").agg(F.collect_list(F.struct("id", "v", "least")).alias("queries"))  # a row a list

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for left, right in zip(batch.column(0), batch.column(1), strict=True):
                    q, x = left.values, right.values
                    width = len(q.field("v")[0])
                    sim = matrix(q.field("v"), width) @ matrix(x.field("v"), width).T
                    yield find(np.asarray(q.field("id")), np.asarray(q.field("least")), np.asarray(x.field("id")), sim)

        # A chunk is handed to every block of its list, so that a long list is as many keys as it has blocks.
        dealt_out = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("list")).cast("long") - 1)))
        return dealt_out.repartition(tasks, "list", "block").join(held.hint("merge"), ["list", "block"]).select("queries", "rows").mapInArrow(run, schema)


def knn_graph(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, neighbor, rank, similarity): the k most similar other vectors of each query, exactly; ties by id."""
    rows, wanted = materialise(usable(vectors, key, vector), "vectors"), usable(queries, key, vector)
    lists = Lists(rows)
    dealt = materialise(lists.dealt(rows), "lists")
    lists.measured(dealt)

    def best(qi: np.ndarray, least: np.ndarray, xi: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        sim = np.where(qi[:, None] == xi, -np.inf, np.round(sim, 9))
        order = np.lexsort((np.broadcast_to(xi, sim.shape), -sim), axis=1)[:, :k]
        kept = np.take_along_axis(sim, order, 1)
        good = np.isfinite(kept)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, order.shape[1])[good.ravel()]), pa.array(xi[order][good]), pa.array(kept[good])], names=["id", "neighbor", "similarity"])

    def search(asked: DataFrame) -> DataFrame:
        found = lists.met(dealt, asked, best, "id long, neighbor long, similarity double")
        found = found.groupBy("id", "neighbor").agg(F.max("similarity").alias("similarity"))
        return found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbor"))).filter(F.col("rank") <= k)

    wanted = materialise(wanted.withColumn("least", F.lit(-1.0)), "queries")
    near = search(lists.asked(wanted, own_only=True)).filter(F.col("rank") == k).select("id", "similarity")
    bound = wanted.join(near, "id", "left").select("id", "v", F.coalesce(F.col("similarity") - SLACK, F.lit(-1.0)).alias("least"))
    return search(lists.asked(bound))


class Meeting:
    """Blocks of vectors for a join: short lists in a row share one, long lists fill several. ``meets``: for each block the
    earlier ones whose vectors can be near enough, by the centroids and radii of their lists."""

    def __init__(self, lists: Lists, reach: float, cores: int) -> None:
        self.lists, self.reach = lists, reach
        total = sum(n for _, n in lists.radius.values())
        # No more vectors than a task may hold; of few vectors enough blocks for all cores, as each is copied once a block.
        rows = max(1, min(JOIN_ROWS, TASK_BYTES // (8 * lists.width)))
        rows = min(rows, max(BLOCK, -(-total // (2 * -int(-(cores**0.5) // 1)))))
        self.first, self.blocks, held = {}, {}, []
        free = 0
        for i, (_, n) in sorted(lists.radius.items()):
            if n > free or i < 0:
                held.append([])
                free = rows
            self.first[i], self.blocks[i] = len(held) - 1, max(1, -(-n // rows))
            held[-1].append(i)
            held += [[i] for _ in range(self.blocks[i] - 1)]
            free = free - n if i >= 0 and self.blocks[i] == 1 else 0
        far = lists.distances(lists.centres) if lists.radius else np.zeros((0, 0))
        at = [np.array([i for i in own if i >= 0], int) for own in held]
        radius = np.array([lists.radius.get(i, (-np.inf, 0))[0] for i in range(len(lists.centres))])
        near = far - radius - radius[:, None] <= reach
        self.meets = [[c for c in range(b) if (near[np.ix_(at[b], at[c])].any() if len(at[b]) and len(at[c]) else held[b] == held[c])] for b in range(len(held))]

    def copies(self, rows: DataFrame) -> DataFrame:
        """(block, other, asks, id, x, n): the rows (list, id, x, n) of every block, once for itself and each earlier block that
        it meets, and the rows of those that ask for it: each vector for the lists that it can have a partner in."""
        lists, first, blocks, meets, reach = self.lists, self.first, self.blocks, self.meets, self.reach
        radius = np.array([lists.radius.get(i, (-np.inf, 0))[0] for i in range(len(lists.centres))])
        later = [[] for _ in meets]
        for b, others in enumerate(meets):
            for c in others:
                later[c].append(b)
        holds = [np.zeros(len(radius), bool) for _ in meets]
        for i in first:
            for b in range(first[i], first[i] + blocks[i]):
                if i >= 0:
                    holds[b][i] = True

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, STEP):
                    part = batch.slice(lo, STEP)
                    own, ids = np.asarray(part.column(0)), np.asarray(part.column(1))
                    at = np.array([first[i] + h % blocks[i] for i, h in zip(own.tolist(), ids.tolist(), strict=True)])
                    out = []  # (places, block, other, asks)
                    for b in np.unique(at):
                        mine = np.flatnonzero(at == b)
                        out += [(mine, b, c, False) for c in [*meets[b], b]]
                        odd = own[mine[0]] < 0
                        if later[b] and not odd:
                            x = matrix(part.column(2).take(pa.array(mine)), lists.width) / np.asarray(part.column(3))[mine, None]
                            visited = lists.distances(x) - radius <= reach
                        for c in later[b]:
                            some = mine if odd else mine[(visited & holds[c]).any(1)]
                            if len(some):
                                out.append((some, c, b, True))
                    for places, b, c, asks in out:
                        k = len(places)
                        some = part.take(pa.array(places))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, b, np.int32)), pa.array(np.full(k, c, np.int32)), pa.array([asks] * k), *some.columns[1:]], names=["block", "other", "asks", "id", "x", "n"])

        kind = rows.schema["x"].dataType.simpleString()
        return rows.select("list", "id", "x", "n").mapInArrow(run, f"block int, other int, asks boolean, id long, x {kind}, n double")


def similarity_join(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id_1, id_2, similarity) with id_1 < id_2 of the pairs at or above the threshold, exactly.

    A pair of blocks is one task's, so vectors travel, as they are stored, once for each block and not for each list; a pair
    of vectors is looked at once, so that pairs travel only where ids are repeated.
    """
    spark = vectors.sparkSession
    raw = usable(vectors, key, vector, raw=True)
    unit = F.transform("x", lambda x: x.cast("double") / F.col("n"))
    lists = Lists(raw.select("id", unit.alias("v")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in lists.parts(batch):
                part = batch.take(pa.array(at))
                far = lists.distances(x / np.asarray(part.column(2))[:, None]) if d == lists.width else None
                own = far.argmin(1) if far is not None else np.full(len(at), -d)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(far.min(1) if far is not None else np.zeros(len(at))), *part.columns], names=["list", "far", "id", "x", "n"])

    kind = raw.schema["x"].dataType.simpleString()
    rows = materialise(raw.select("id", "x", "n").mapInArrow(listed, f"list long, far double, id long, x {kind}, n double"), "vectors")
    lists.measured(rows)
    meeting = Meeting(lists, float(np.sqrt(max(2 - 2 * threshold, 0))) + SLACK, spark.sparkContext.defaultParallelism)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        asks = held.column("asks").to_numpy()
        alone = held.column("block")[0] == held.column("other")[0]
        ids, n = held.column("id").to_numpy(), held.column("n").to_numpy()
        x = held.column("x").combine_chunks()
        v = matrix(x, len(x[0])) / n[:, None]
        one, two = (np.arange(len(ids)), np.arange(len(ids))) if alone else (np.flatnonzero(asks), np.flatnonzero(~asks))
        right, xi = v[two].T, ids[two]
        for lo in range(0, len(one), CHUNK):
            qi = ids[one[lo : lo + CHUNK]]
            sim = v[one[lo : lo + CHUNK]] @ right
            good = sim >= threshold
            i, j = np.nonzero(good & (qi[:, None] < xi if alone else qi[:, None] != xi))
            a, b = qi[i], xi[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim[i, j])], names=["id_1", "id_2", "similarity"])

    found = meeting.copies(rows).groupBy("block", "other").applyInArrow(pairs, "id_1 long, id_2 long, similarity double")
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return found
    return found.groupBy("id_1", "id_2").agg(F.max("similarity").alias("similarity"))
