"""A persistent inverted index of texts: postings by term, in blocks of neighbouring texts, in segments that are appended.

A segment deals its texts into chunks of about ``CHUNK``; a block holds the postings of one term in one chunk (ids, term
counts, lengths of the texts) with the largest count and the least length, which bound the score of any text in it. Blocks
lie in folders by a hash of the term, sorted by term, so a search opens the folders of its terms and of these the row
groups that hold them: texts without the terms are not read, whatever their number. A top-k search first reads the bounds
alone, scores the most promising chunks, and then only the chunks whose bounds reach the k-th score found.

Segments count once their statistics, written last, are complete; a segment that is written again under its name replaces
the one before. Defined results: null texts are empty and count as texts; a term is one token in lower case; terms that
repeat count once; a text id that stands in two segments is two texts until ``merged``; no terms find nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import shared_dir

#: The layout on disk; texts and words of a chunk, folders of a segment, tasks that share a folder at least.
FORMAT, CHUNK, CHUNK_WORDS, FOLDERS, SPREAD = 3, 1024, 1 << 21, 16, 4
K1, B = 1.2, 0.75
BLOCK = "term string, chunk long, postings array<struct<id:{kind},tf:int,dl:int>>, n long, most_tf int, least_dl int"


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the texts (id, words) of a task, chunk by chunk, and for each chunk a row of its texts and words."""
    chunk, texts, words = TaskContext.get().partitionId() << 32, 0, 0
    held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []  # ids, words of all texts in turn, number of words of each

    def close() -> Iterator[pa.RecordBatch]:
        ids, sizes = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[2] for x in held])
        coded = pa.concat_arrays([x[1] for x in held]).dictionary_encode()
        # Terms by number, of each the texts in turn: both are in one number, so that one sort counts them.
        pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * texts + np.repeat(np.arange(texts), sizes), return_counts=True)
        term, text = np.divmod(pairs, texts)
        offsets = np.append(0, np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))).astype(np.int64)
        tf, dl = tf.astype(np.int32), sizes.astype(np.int32)[text]
        struct = pa.StructArray.from_arrays([ids.take(pa.array(text)), pa.array(tf), pa.array(dl)], names=["id", "tf", "dl"])
        for at in range(0, len(coded.dictionary), 20_000):
            edges = offsets[at : at + 20_001]
            lo, hi, n = edges[0], edges[-1], len(edges) - 1
            columns = [coded.dictionary.slice(at, n), pa.array(np.full(n, chunk)), pa.ListArray.from_arrays(pa.array(edges - lo, pa.int32()), struct.slice(lo, hi - lo)), pa.array(np.diff(edges))]
            columns += [pa.array(np.maximum.reduceat(tf[lo:hi], edges[:-1] - lo)), pa.array(np.minimum.reduceat(dl[lo:hi], edges[:-1] - lo)), *[pa.nulls(n, pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)
        empty = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), struct.slice(0, 0))
        nothing = [pa.array([None], t) for t in (pa.string(), pa.int64())]
        yield pa.RecordBatch.from_arrays([nothing[0], pa.array([chunk], pa.int64()), empty, nothing[1], *[pa.array([None], pa.int32())] * 2, pa.array([texts], pa.int64()), pa.array([words], pa.int64())], names=NAMES)
        held.clear()

    for batch in batches:
        sizes, flat = batch.column(1).value_lengths().to_numpy().astype(np.int64), batch.column(1).flatten()
        ends, at = np.append(0, np.cumsum(sizes)), 0
        while at < batch.num_rows:
            # As many texts as the chunk still takes; a longer one is a chunk of its own.
            to = min(at + CHUNK - texts, int(np.searchsorted(ends, ends[at] + CHUNK_WORDS - words, "right")) - 1)
            to = max(to, at if held else at + 1)
            if to > at:
                held.append((batch.column(0).slice(at, to - at), flat.slice(ends[at], ends[to] - ends[at]), sizes[at:to]))
                texts, words = texts + to - at, words + int(ends[to] - ends[at])
            if to < batch.num_rows or texts >= CHUNK:
                yield from close()
                chunk, texts, words = chunk + 1, 0, 0
            at = to
    if held:
        yield from close()


NAMES = ["term", "chunk", "postings", "n", "most_tf", "least_dl", "texts", "words"]


class TextIndex:
    """The index at ``root``, on any file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _listed(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path(self.root)):
            return []
        found = [s.getPath() for s in fs.listStatus(path(self.root)) if s.isDirectory()]
        return sorted(p.getName() for p in found if fs.exists(path(p, "stats/_SUCCESS")))

    def segments(self) -> list[str]:
        return [f"{self.root}/{name}" for name in self._listed()]

    def append(self, texts: DataFrame, name: str, key: str = "id", text: str = "text") -> TextIndex:
        """Add texts as the segment ``name``. Tasks invert the texts that they have; what is shuffled are whole blocks."""
        kind = texts.schema[key].dataType.simpleString()
        words = texts.select(F.col(key).alias("id"), T.tokens(F.col(text)).alias("ws"))
        blocks = words.mapInArrow(inverted, f"term string, chunk long, postings array<struct<id:{kind},tf:int,dl:int>>, n long, most_tf int, least_dl int, texts long, words long")
        folder = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(FOLDERS))).cast("int")
        # The chunks of a folder are dealt by their hash (their low bits count from nought in every task), over more tasks the
        # more texts there are, so that what one of them sorts does not grow.
        wide = max(SPREAD, -(-texts.rdd.getNumPartitions() // SPREAD))
        # Spark's own number, which it lowers for small tables, where that is enough.
        tasks = [FOLDERS * wide] if FOLDERS * wide > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else []
        placed = blocks.withColumn("folder", folder).repartition(*tasks, "folder", F.pmod(F.xxhash64("chunk"), F.lit(wide))).sortWithinPartitions("folder", "term", "chunk")
        placed.write.mode("overwrite").partitionBy("folder").parquet(f"{self.root}/{name}/blocks")
        sums = self.spark.read.schema(placed.schema).parquet(f"{self.root}/{name}/blocks").filter("folder = -1").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        sums.withColumn("id", F.lit(None).cast(kind)).write.mode("overwrite").parquet(f"{self.root}/{name}/stats")
        return self

    def stats(self) -> tuple[int, int]:
        """(texts, words)."""
        one = [self.spark.read.parquet(f"{s}/stats") for s in self.segments()]
        rows = [df.first() for df in one]  # a row a segment
        return sum(r.n for r in rows), sum(r.words for r in rows)

    def blocks(self, terms: list[str]) -> DataFrame:
        """(segment, term, chunk, postings, n, most_tf, least_dl) of the terms, from their folders."""
        wanted = sorted({t.lower() for t in terms})
        folders = self.spark.createDataFrame([(t,) for t in wanted], "term string").select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int").alias("f")) if wanted else None
        which = sorted({r.f for r in folders.collect()}) if folders is not None else []  # a row a term of the query
        out = None
        for i, s in enumerate(self.segments()):
            kind = self.spark.read.parquet(f"{s}/stats").schema["id"].dataType.simpleString()
            df = self.spark.read.schema(f"{BLOCK.format(kind=kind)}, folder int").parquet(f"{s}/blocks").filter(F.col("folder").isin(which) & F.col("term").isin(wanted)).withColumn("segment", F.lit(i))
            df = df.select("segment", "term", "chunk", "postings", "n", "most_tf", "least_dl")
            out = df if out is None else out.unionByName(df)
        return out

    def holding(self, terms: list[str], every: bool = True) -> DataFrame:
        """(id): texts that hold all (or any) of the terms."""
        wanted = {t.lower() for t in terms}
        blocks = self.blocks(terms)
        if every:  # chunks without one of the terms have no such text
            full = blocks.groupBy("segment", "chunk").agg(F.count("*").alias("k")).filter(F.col("k") == len(wanted)).select("segment", "chunk")
            blocks = blocks.join(full, ["segment", "chunk"], "left_semi")
        hits = blocks.select("segment", F.explode("postings.id").alias("id")).groupBy("segment", "id").agg(F.count("*").alias("k"))
        return hits.filter(F.col("k") >= (len(wanted) if every else 1)).select("id")

    def top(self, terms: list[str], k: int) -> DataFrame:
        """(id, score): the k best texts by BM25; ties by id."""
        n, words = self.stats()
        average = max(words / max(1, n), 1e-9)
        blocks = self.blocks(terms)
        found = {r.term: r.df for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row a term of the query
        idf = F.create_map(*(x for t, df in found.items() for x in (F.lit(t), F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))))) if found else F.create_map(F.lit(""), F.lit(0.0))

        def score(tf, dl):
            return idf[F.col("term")] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))

        chunk = ["segment", "chunk"]
        bounds = blocks.groupBy(*chunk).agg(F.sum(score(F.col("most_tf").cast("double"), F.col("least_dl").cast("double"))).alias("most"))

        def scored(kept: DataFrame) -> DataFrame:
            each = kept.select(*chunk, "term", F.explode("postings").alias("p"))
            one = score(F.col("p.tf").cast("double"), F.col("p.dl").cast("double"))
            # Terms are added in one order, wherever their blocks lie: texts that are alike have scores equal to the last bit.
            sums = each.groupBy("segment", F.col("p.id").alias("id")).agg(F.lit(0).alias("s"), *(F.sum(F.when(F.col("term") == t, one)).alias(f"s{i}") for i, t in enumerate(sorted(found))))
            return sums.select("id", sum((F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(found))), F.lit(0.0)).alias("score"))

        first = bounds.orderBy(F.desc("most"), *chunk).limit(k)  # every chunk of the bounds has a text: k of them have k
        sample = scored(blocks.join(F.broadcast(first), chunk)).orderBy(F.desc("score")).limit(k)
        known = sample.agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
        least = known.least - 1e-9 if known.n == k else float("-inf")
        rest = bounds.filter(F.col("most") >= least).select(*chunk)
        return scored(blocks.join(rest, chunk, "left_semi")).orderBy(F.desc("score"), "id").limit(k)

    def merged(self, texts: DataFrame, key: str = "id", text: str = "text") -> TextIndex:
        """One segment of ``texts`` in place of all others."""
        old = self._listed()
        self.append(texts, f"merged-{len(old)}-{old[-1] if old else 'none'}"[:80], key, text)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in old:  # its statistics go first: without them a segment does not count
            fs.delete(path(f"{self.root}/{name}/stats"), True)
            fs.delete(path(f"{self.root}/{name}"), True)
        return self


def of_table(texts: DataFrame, label: str, key: str = "id", text: str = "text") -> TextIndex:
    """The index of a table of files, built once for each state of the files and found again in the shared folder."""
    spark = texts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    state = []
    for name in sorted(texts.inputFiles()):
        s = path(name).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(name))
        state.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    mark = hashlib.sha256("\n".join(state).encode()).hexdigest()[:32]
    index = TextIndex(spark, f"{shared_dir(spark)}/text-index-{FORMAT}-{label}-{mark}")
    return index if index.segments() else index.append(texts, "all", key, text)
