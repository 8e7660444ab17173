"""A keyed table that takes changes as delta files: only the folders of the changed keys are written.

Keys fall into folders by a hash. A batch of changes (rows, and tombstones of deleted keys) writes one delta, a file set in
each folder that it touches; a version names, for every folder, the deltas that make it up. A version counts once its file
of the log has its final name, which a rename gives it at once; what a batch wrote before that is never read. A batch whose
number the log holds already changes nothing, so replays are harmless. Reading merges the deltas of a folder, newest last;
folders of one delta are read as they are. ``compact`` writes folders of many deltas anew, ``vacuum`` deletes what no
version names any more.

Defined results: of several changes to a key in one batch the most recent counts, a deletion before others of the same
time; null keys are keys; a deletion of an unknown key is kept and shows nothing; an empty batch makes a
version without a delta.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FOLDERS = 64
GONE, VERSION, FOLDER = "_gone", "_version", "_folder"


class KeyedTable:
    """The table at ``root``, on any file system: the schema of its rows, the columns of its key, and the column that says
    which row of a key is the latest (the later batch, without one)."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], recency: str | None = None, folders: int = FOLDERS) -> None:
        self.spark, self.root, self.keys, self.recency, self.folders = spark, root.rstrip("/"), keys, recency, folders
        self.schema = schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- the log

    def versions(self) -> list[int]:
        log = self._path(f"{self.root}/log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def state(self, version: int | None = None) -> dict:
        """{"version", "batches": {source: last number}, "folders": {folder: [deltas]}} of a version, the newest by default."""
        known = self.versions()
        if not known:
            return {"version": 0, "batches": {}, "folders": {}}
        at = self._path(f"{self.root}/log/{known[-1] if version is None else version:010d}.json")
        stream = self.spark._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(at), "UTF-8")
        return json.loads(stream)

    def _commit(self, state: dict) -> None:
        final = self._path(f"{self.root}/log/{state['version']:010d}.json")
        draft = self._path(f"{self.root}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {state['version']} of {self.root} was written by another")

    def _latest(self, rows: DataFrame, tie: Column, *within: str) -> DataFrame:
        """The latest row of each key; ``within``: columns that the rows are dealt by and that follow from the key."""
        order = F.struct(*([F.col(self.recency)] if self.recency else []), tie)
        return rows.groupBy(*within, *self.keys).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")

    # -- writing

    def folder(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.folders)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by their folder."""
        return rows.withColumn(FOLDER, self.folder()).repartition(FOLDER)

    def _write(self, rows: DataFrame, name: str) -> list[str]:
        """Write a delta; the folders that it has."""
        placed = rows if FOLDER in rows.columns else self._placed(rows)
        placed.write.mode("overwrite").partitionBy(FOLDER).parquet(f"{self.root}/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{name}")) if s.isDirectory()]
        return sorted(n.split("=")[1] for n in found if n.startswith(f"{FOLDER}="))

    def merge(self, changes: DataFrame, gone: Column | None = None, batch: int | None = None, source: str = "") -> dict:
        """Apply changes (rows of the schema); where ``gone`` holds, the key is deleted. Returns the new state.

        ``batch`` numbers the batches of a source upwards: one that is not above the last changes nothing.
        """
        state = self.state()
        if batch is not None and batch <= state["batches"].get(source, -1):
            return state
        version = state["version"] + 1
        rows = changes.select(*self.schema.names, (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias(GONE))
        latest = self._latest(self._placed(rows), ~F.col(GONE), FOLDER)  # keys meet in their folder: one shuffle
        name = f"delta-{version:010d}-{uuid.uuid4().hex[:8]}"
        touched = self._write(latest.withColumn(VERSION, F.lit(version).cast("long")), name)
        folders = {k: list(v) for k, v in state["folders"].items()}
        for f in touched:
            folders.setdefault(f, []).append(name)
        batches = state["batches"] | ({source: batch} if batch is not None else {})
        new = {"version": version, "batches": batches, "folders": folders, "touched": touched}
        self._commit(new)
        return new

    # -- reading

    def _deltas(self, folders: dict[str, list[str]], columns: list[str] | None = None) -> DataFrame:
        needed = {*self.keys, self.recency, *(self.schema.names if columns is None else columns)}
        kinds = StructType([f for f in self.schema.fields if f.name in needed]).add(GONE, "boolean").add(VERSION, "long")
        paths = [f"{self.root}/{d}/{FOLDER}={f}" for f, deltas in folders.items() for d in deltas]
        return self.spark.read.schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)

    def _merged(self, folders: dict[str, list[str]], with_gone: bool = False, columns: list[str] | None = None) -> DataFrame:
        one = {f: d for f, d in folders.items() if len(d) == 1}
        more = {f: d for f, d in folders.items() if len(d) > 1}
        rows, names = self._deltas(one, columns), self.schema.names if columns is None else columns
        if more:
            rows = rows.unionByName(self._latest(self._deltas(more, columns), F.col(VERSION)))
        return rows.select(*names, GONE) if with_gone else rows.filter(~F.col(GONE)).select(*names)

    def read(self, version: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows of a version, with ``columns`` alone if named: merging then moves no others."""
        return self._merged(self.state(version)["folders"], columns=columns)

    def lookup(self, *keys: tuple) -> DataFrame:
        """The rows of a few keys, from their folders alone."""
        kinds = StructType([self.schema[k] for k in self.keys])
        wanted = self.spark.createDataFrame(list(keys), kinds)
        which = {str(r.f) for r in wanted.select(self.folder().alias("f")).collect()}
        rows = self._merged({f: d for f, d in self.state()["folders"].items() if f in which})
        match = F.lit(True)
        right = wanted.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)))
        for i, k in enumerate(self.keys):
            match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return rows.join(right.hint("broadcast"), match, "left_semi")  # the keys asked for

    def changed(self, version: int | None = None) -> DataFrame:
        """The rows, tombstones left out, that a version's own delta wrote."""
        state = self.state(version)
        own = {f: [d[-1]] for f, d in state["folders"].items() if d and d[-1].startswith(f"delta-{state['version']:010d}-")}
        return self._deltas(own).filter(~F.col(GONE)).select(*self.schema.names)

    # -- upkeep

    def compact(self, most: int = 4) -> dict:
        """Write folders of more than ``most`` deltas as one. Tombstones go, but for tables with a column of recency, where
        an older change to a deleted key may still come."""
        state = self.state()
        many = {f: d for f, d in state["folders"].items() if len(d) > most}
        if not many:
            return state
        version = state["version"] + 1
        name = f"base-{version:010d}-{uuid.uuid4().hex[:8]}"
        rows = self._merged(many, True).withColumn(VERSION, F.lit(version).cast("long"))
        rows = rows if self.recency else rows.filter(~F.col(GONE))
        kept = set(self._write(rows, name))
        folders = {f: d for f, d in state["folders"].items() if f not in many} | {f: [name] for f in many if f in kept}
        new = state | {"version": version, "folders": folders, "touched": sorted(many)}
        self._commit(new)
        return new

    def vacuum(self) -> int:
        """Delete older versions and the files that the newest does not name; how many folders of files went."""
        state, gone = self.state(), 0
        live = {(d, f) for f, deltas in state["folders"].items() for d in deltas}
        for s in self._fs.listStatus(self._path(self.root)) if state["version"] else []:
            name = s.getPath().getName()
            if name == "log":
                continue
            parts = [p.getPath() for p in self._fs.listStatus(s.getPath()) if p.isDirectory()]
            dead = [p for p in parts if (name, p.getName().split("=")[1]) not in live]
            for p in [s.getPath()] if len(dead) == len(parts) else dead:
                self._fs.delete(p, True)
            gone += len(dead)
        for v in self.versions()[:-1]:
            self._fs.delete(self._path(f"{self.root}/log/{v:010d}.json"), False)
        return gone
