"""Near-duplicate vectors by product quantisation with inverted lists, complete at any threshold.

Coarse centroids deal normalised vectors into lists; what is left of a vector is coded part by part
with small codebooks. Both are fitted to a bounded sample (``SAMPLE`` vectors); every vector is indexed.
A query visits each list that can hold a vector within the threshold's distance: the list's border
with the query's own list must be that near, and so must the shell around the list's centroid that its
vectors fill. Of two lists that could visit each other, one does, and the pairs found count for both
sides. In a list, table look-ups give the distance to each decoded vector; as the decoding error of every
vector is stored, a candidate is left out only if the triangle inequality rules it out. Candidates are
measured exactly, by cosine in double precision. So nothing is missed; tests hold recall against brute force.

Equal vectors of a label form one class with a multiplicity. Searching tasks do not emit pairs: they
sum each vector's links and reduce the links to one edge per vector and component of the task. Lists
longer than ``BLOCK`` are split into blocks, and the queries of a block are dealt in slices of about
``QUERIES``, so the rows that a task holds do not grow with the table.

Defined results: vectors with a null label, null or empty vectors, zero vectors and those with null or
non-finite components link with nothing; vectors of different lengths never link; rows without an id
count as the largest id; repeated rows are separate vectors; an empty table gives an empty table;
columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

COSINE = 0.93
SAMPLE = 8192
LIST_ROWS, MAX_LISTS, BLOCK, QUERIES = 2000, 4096, 4096, 16384
PART, CODES = 8, 64
ROUNDS = 8
NODE = "struct<id:bigint,label:bigint,hash:bigint>"


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's iterations; fewer than k where the rows are fewer."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and the codebooks of the parts of what they leave."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.coarse = kmeans(sample, min(lists, MAX_LISTS), 1)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        d = sample.shape[1]
        self.parts = [slice(i, min(i + PART, d)) for i in range(0, d, PART)]
        self.books = [kmeans(np.ascontiguousarray(rest[:, p]), CODES, 2 + i) for i, p in enumerate(self.parts)]
        self.between = np.sqrt(squares(self.coarse, self.coarse))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, decoding error, distance to the list's centroid) of each row."""
        cell = nearest(x, self.coarse)
        rest = x - self.coarse[cell]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return cell, codes, np.sqrt(((rest - decoded) ** 2).sum(1)), np.sqrt((rest**2).sum(1))

    def probes(self, x: np.ndarray, cell: np.ndarray, reach: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Lists whose cells come within ``reach`` of each row, its own and those behind a near border, and the
        distances to their centroids."""
        d2 = squares(x, self.coarse)
        own = d2[np.arange(len(x)), cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            border = (d2 - own[:, None]) / (2 * self.between[cell])
        border[np.arange(len(x)), cell] = 0
        border[~np.isfinite(border)] = 0
        near = [np.flatnonzero(b <= reach) for b in border]
        return near, [np.sqrt(d[n]) for d, n in zip(d2, near, strict=True)]

    def distances(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the decoded vectors of one list, by table look-ups."""
        rest = query - self.coarse[cell]
        out = np.zeros((len(query), len(codes)))
        for i, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            out += squares(rest[:, p], book)[:, codes[:, i]]
        return np.sqrt(out)


def reach_of(cosine: float) -> float:
    """Distance of unit vectors with this cosine, with room for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal or smaller length as doubles, padded with zeros."""
    out = np.zeros((len(column), dim))
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values).astype(np.float64)
    size = np.diff(offsets)
    if len(size) and (size == dim).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, dim).copy()
    for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : hi - lo] = values[lo:hi]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)  # large components would overflow when squared
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def search(index: Index, cell: int, queries: np.ndarray, data: np.ndarray, codes: np.ndarray, error: np.ndarray, cosine: float, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each pair whose cosine is at least ``cosine``."""
    reach = reach_of(cosine)
    found_q, found_x = [], []
    for lo in range(0, len(queries), chunk):
        q = queries[lo : lo + chunk]
        a, b = np.nonzero(index.distances(q, cell, codes) <= reach + error)
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            good = (q[i] * data[j]).sum(1) >= cosine
            found_q.append(i[good] + lo)
            found_x.append(j[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_x])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex that each vertex reaches by the edges."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, sample: int = SAMPLE, list_rows: int = LIST_ROWS, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    none = (1 << 63) - 1
    rows = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(none)).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = "label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x <> 0)"
    good = F.coalesce(F.expr(usable), F.lit(False))
    rows = rows.withColumn("good", good)
    classes = rows.filter("good").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = materialise(classes.select(F.struct("id", "label", F.xxhash64("v").alias("hash")).alias("node"), "label", F.size("v").alias("dim"), "v", "n"), "vectors")
    size = classes.agg(F.max("dim").alias("dim")).first()
    single = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))

    def shown(df: DataFrame) -> DataFrame:
        named = {c: F.when(F.col(c) != none, F.col(c)) for c in ("id", "component_id")}
        return df.select(named["id"].alias(key), "n_links", named["component_id"].alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))

    if size.dim is None:
        return shown(single)
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    drawn = classes.orderBy(F.xxhash64("v", "label")).limit(sample).select("v").toArrow()
    index = Index(unit(matrix(drawn["v"].combine_chunks(), size.dim)), max(1, -(-most // list_rows)))
    dim, reach = size.dim, reach_of(cosine)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(3), dim))
            cell, codes, error, radius = index.encode(x)
            near, away = index.probes(x, cell, reach)
            probes = [[{"to": t, "away": d} for t, d in zip(n.tolist(), a.tolist(), strict=True)] for n, a in zip(near, away, strict=True)]
            new = [("cell", pa.int32()), ("codes", pa.binary()), ("error", pa.float64()), ("radius", pa.float64()), ("probes", pa.list_(pa.struct([("to", pa.int32()), ("away", pa.float64())])))]
            columns = [cell, [c.tobytes() for c in codes], error, radius, probes]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), *(pa.array(c, k) for c, (_, k) in zip(columns, new, strict=True))],
                schema=pa.schema([*(batch.schema.field(i) for i in range(5)), *new]),
            )

    shape = f"node {NODE}, label long, dim int, v array<double>, n long, cell int, codes binary, error double, radius double, probes array<struct<to:int,away:double>>"
    coded = materialise(classes.select("node", "label", "dim", "v", "n").mapInArrow(encode, shape), "coded")
    blocks = coded.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("radius").alias("least"), F.max("radius").alias("most"))
    data = coded.join(blocks.drop("least", "most"), ["label", "dim", "cell"]).withColumn("block", F.pmod("node.hash", "blocks").cast("int"))
    # Of two lists, or two blocks of a list, one visits the other: which of them changes with their numbers' parity.
    visits = lambda a, b: f"({a} < {b}) = (({a} + {b}) % 2 = 0)"
    at = ["label", "dim", "cell", "block"]
    asked = data.withColumnsRenamed({"cell": "home", "block": "home_block"}).withColumn("probe", F.explode("probes"))
    asked = asked.filter(f"probe.to = home or {visits('home', 'probe.to')}").select("node", "label", "dim", "v", "n", "home", "home_block", F.col("probe.to").alias("cell"), "probe.away")
    asked = asked.join(blocks, ["label", "dim", "cell"]).filter(F.col("away").between(F.col("least") - reach, F.col("most") + reach))
    asked = asked.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    asked = asked.filter(f"cell <> home or block = home_block or {visits('home_block', 'block')}")
    asked = asked.withColumn("across", F.expr("cell <> home or block <> home_block"))
    slices = materialise(asked.groupBy(*at).agg(F.ceil(F.count("*") / queries).cast("int").alias("slices")), "slices")
    asked = asked.join(slices, at).withColumn("slice", F.pmod(F.xxhash64("node.hash"), "slices").cast("int"))
    data = data.join(slices, at).withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))

    def find(queries: pa.Table, held: pa.Table) -> pa.Table:
        kind = held.schema.field("node").type
        empty = pa.table({"node": pa.array([], kind), "links": pa.array([], pa.int64()), "other": pa.array([], kind)})
        if not held.num_rows or not queries.num_rows:
            return empty
        x = unit(matrix(held["v"].combine_chunks(), dim))
        q = unit(matrix(queries["q_v"].combine_chunks(), dim))
        codes = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint8).reshape(len(x), -1)
        i, j = search(index, held["cell"][0].as_py(), q, x, codes, np.asarray(held["error"]), cosine)
        names = pa.concat_arrays([queries["q_node"].combine_chunks(), held["node"].combine_chunks()])
        met = np.unique(np.concatenate([i, j + len(q)]))  # rows of some pair
        number: dict[tuple, int] = {}
        vertex = np.zeros(len(names), np.int64)
        vertex[met] = [number.setdefault((n["id"], n["label"], n["hash"]), len(number)) for n in names.take(pa.array(met)).to_pylist()]
        place = np.zeros(len(number), np.int64)
        place[vertex[met][::-1]] = met[::-1]
        vq, vx = vertex[:len(q)][i], vertex[len(q) :][j]
        other = vq != vx
        i, j, vq, vx = i[other], j[other], vq[other], vx[other]
        links = np.zeros(len(number), np.int64)
        np.add.at(links, vq, np.asarray(held["n"])[j])
        both = np.asarray(queries["q_across"])[i].astype(bool)
        np.add.at(links, vx[both], np.asarray(queries["q_n"])[i[both]])
        root = forest(vq, vx, len(number))
        some = np.flatnonzero(root != np.arange(len(number)))
        counted = np.flatnonzero(links)
        rows_at = place[np.append(counted, some)]
        others = place[np.append(counted, root[some])]
        return pa.table({"node": names.take(pa.array(rows_at)), "links": pa.array(np.append(links[counted], np.zeros(len(some), np.int64))), "other": names.take(pa.array(others))})

    at = [*at, "slice"]
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in (*at, "node", "v", "n", "across")))
    found = asked.groupBy(*(f"q_{c}" for c in at)).cogroup(data.select(*at, "node", "v", "n", "codes", "error").groupBy(*at)).applyInArrow(find, f"node {NODE}, links long, other {NODE}")
    found = materialise(found, "links")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).select(F.col("v").alias("node"), "root")
    out = classes.select("node", "v", "n").join(totals, "node", "left").join(roots, "node", "left")
    out = out.select(F.col("node.label").alias("label"), "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node")["id"].alias("component_id"))
    joined = rows.filter("good").join(out, ["label", "v"]).select("id", "n_links", "component_id")
    return shown(joined.unionByName(single))
