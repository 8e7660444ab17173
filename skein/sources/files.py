"""Source trees, git logs, manifests and the sinks that keep relations."""

from __future__ import annotations

import ast
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import materialise
from ..operators.diff import upsert

SKIP_DIRS = ("__pycache__", "node_modules", "venv", "build", "dist")
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".rs": "rust", ".c": "c", ".java": "java"}
MAX_SOURCE_BYTES = 10 << 20


def project_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size, content) of files below ``root``, without hidden and generated directories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    skip = r"/(?:\.[^/]+|" + "|".join(SKIP_DIRS) + ")/"
    return files.filter(~F.col("path").rlike(skip)).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def with_language(files: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return files.withColumn("lang", names[F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))])


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.sha2("content", 256))


def git_changes(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """(commit, ts, author, file, added, deleted) of a ``git log --numstat`` text whose headers are
    ``hash␞epoch␞subject␞email``; binary rows are skipped."""
    raw = spark.read.text(path, wholetext=True)  # one log file a row; split long histories into files
    blocks = raw.select(F.explode(F.split("value", r"\n(?=[0-9a-f]{40}\x1e)")).alias("block")).select(F.split("block", r"\n").alias("lines"))
    head = F.split(F.element_at("lines", 1), "\x1e")
    rows = blocks.select(head.alias("h"), F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line")).filter(F.size("h") >= 4)
    part = F.split("line", "\t", 3)
    rows = rows.select("h", part.alias("p")).filter((F.size("p") == 3) & ~((F.col("p")[0] == "-") & (F.col("p")[1] == "-")))
    n = lambda i: F.coalesce(F.expr(f"try_cast(p[{i}] AS bigint)"), F.lit(0))
    out = rows.select(F.col("h")[0].alias("commit"), F.timestamp_seconds(F.expr("try_cast(h[1] AS bigint)")).alias("ts"), F.col("h")[3].alias("author"), F.trim(F.col("p")[2]).alias("file"), n(0).alias("added"), n(1).alias("deleted"))
    return out.filter(F.col("file").endswith(suffix)) if suffix else out


SYMBOL = "path string, record string, id string, name string, qualified_name string, kind string, start_line int, end_line int, signature string, docstring string, is_public boolean, src string, dst string, edge_type string"


class _Reader(ast.NodeVisitor):
    """Collects definitions and references of one module."""

    def __init__(self, path: str) -> None:
        self.path, self.scope, self.rows, self.classes = path, [], [], set()

    def put(self, name: str, kind: str, node: ast.AST, signature: str = "", doc: str | None = None) -> str:
        qualified = ".".join([*self.scope, name])
        doc = doc if doc is None or len(doc) <= 1000 else doc[:1000] + "..."
        key = f"{self.path}:{qualified}"
        self.rows.append(("symbol", key, name, qualified, kind, node.lineno, getattr(node, "end_lineno", node.lineno), signature, doc, not name.startswith("_"), None, None, None))
        return key

    def edge(self, dst: str, kind: str) -> None:
        src = f"{self.path}:{'.'.join(self.scope)}" if self.scope else self.path
        self.rows.append(("edge", None, None, None, None, None, None, None, None, None, src, dst, kind))

    def inside(self, node: ast.AST, name: str) -> None:
        self.scope.append(name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [ast.unparse(b) for b in node.bases]
        self.put(node.name, "class", node, f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}", ast.get_docstring(node))
        self.scope.append(node.name)
        for b in bases:
            plain = b.split("[")[0].split(".")[-1]
            interface = plain in ("ABC", "Protocol") or plain.endswith("Interface") or (len(plain) > 1 and plain[0] == "I" and plain[1].isupper())
            self.edge(plain, "implements" if interface else "inherits")
        self.scope.pop()
        self.classes.add(".".join([*self.scope, node.name]))
        self.inside(node, node.name)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        kind = "method" if ".".join(self.scope) in self.classes else "function"
        word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        self.put(node.name, kind, node, f"{word} {node.name}({ast.unparse(node.args)}){back}", ast.get_docstring(node))
        self.inside(node, node.name)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name) and len(self.scope) <= 1:
                self.put(t.id, "constant" if t.id.isupper() else "variable", node)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.edge(a.name, "imports")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.edge("." * node.level + (node.module or ""), "imports")

    def visit_Call(self, node: ast.Call) -> None:
        name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else None
        if name:
            self.edge(name, "instantiates" if name[:1].isupper() else "calls")
        self.generic_visit(node)


def parse_python(files: DataFrame) -> DataFrame:
    """Symbols and edges of Python sources (path, content), one row each; a file that does not parse, or is
    larger than ``MAX_SOURCE_BYTES``, gives one row with record ``failed``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOL.split(", ")]
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    if len(content) > MAX_SOURCE_BYTES:
                        raise ValueError("too large")
                    reader = _Reader(path)
                    reader.visit(ast.parse(bytes(content).decode("utf-8")))
                    rows += [(path, *r) for r in reader.rows]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, "failed", None, None, None, None, None, None, None, str(e)[:200], None, None, None, None))
            out = pd.DataFrame(rows, columns=names)
            for c in ("start_line", "end_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, SYMBOL)


def resolve_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (path, src, dst name) with the symbol that the name means: one of the same file first, then the smallest id."""
    # Each edge meets one row of its name in its file and one of its name, however many symbols share it. Sizes that Spark
    # infers for parsed rows are those of the files' names; by them it would broadcast all symbols.
    near = symbols.groupBy("path", F.col("name").alias("dst")).agg(F.min("id").alias("near"))
    far = symbols.groupBy(F.col("name").alias("dst")).agg(F.min("id").alias("far"))
    one = edges.select("path", "src", "dst", "edge_type").distinct().join(near.hint("merge"), ["path", "dst"], "left").join(far.hint("merge"), "dst", "left")
    return one.select("path", "src", "dst", "edge_type", F.coalesce("near", "far").alias("target_id")).withColumn("resolution_state", F.when(F.col("target_id").isNotNull(), 1).otherwise(0))


def linearise(classes: DataFrame) -> DataFrame:
    """(family, name, mro) of classes (family, name, bases array<string>): C3 order within each family; a conflict gives null."""

    def c3(pdf: pd.DataFrame) -> pd.DataFrame:
        bases = {n: list(b) for n, b in zip(pdf["name"], pdf["bases"], strict=True)}
        done: dict[str, list[str] | None] = {}

        def order(name: str, trail: tuple[str, ...] = ()) -> list[str] | None:
            if name in trail:
                return None
            if name not in done:
                above = [order(b, (*trail, name)) for b in bases.get(name, [])]
                rows = None if None in above else [list(x) for x in above] + [list(bases.get(name, []))]
                out: list[str] | None = [name]
                while rows is not None and any(rows):
                    rows = [r for r in rows if r]
                    good = next((r[0] for r in rows if not any(r[0] in x[1:] for x in rows)), None)
                    if good is None:
                        rows = None
                        break
                    out.append(good)
                    rows = [[x for x in r if x != good] for r in rows]
                done[name] = out if rows is not None else None
            return done[name]

        return pd.DataFrame({"family": pdf["family"], "name": pdf["name"], "mro": [order(n) for n in pdf["name"]]})

    return classes.groupBy("family").applyInPandas(c3, "family string, name string, mro array<string>")


def method_categories(mro: DataFrame, methods: DataFrame) -> DataFrame:
    """(name, method, owner, category): own, inherited or overrides, by the first class of the order that defines it."""
    places = mro.select("name", F.posexplode("mro").alias("at", "cls"))
    seen = places.join(methods.select(F.col("cls"), "method"), "cls")
    per = seen.groupBy("name", "method").agg(F.min_by("cls", "at").alias("owner"), F.min("at").alias("first"), F.count("*").alias("n"))
    return per.select("name", "method", "owner", F.when(F.col("first") > 0, "inherited").when(F.col("n") > 1, "overrides").otherwise("own").alias("category"))


def manifest_dependencies(name: str, content: str) -> list[str]:
    """Declared dependencies of one manifest file, for the ecosystems known."""
    import json
    import re

    bare = lambda s: re.split(r"[\s<>=!~;\[(@]", s.strip())[0]
    if name.endswith("pyproject.toml"):
        spec = tomllib.loads(content)
        return sorted({bare(d) for d in spec.get("project", {}).get("dependencies", [])} | set(spec.get("tool", {}).get("poetry", {}).get("dependencies", {})) - {"python"})
    if name.endswith("requirements.txt"):
        return sorted({bare(x) for x in content.splitlines() if x.strip() and not x.lstrip().startswith(("#", "-"))})
    if name.endswith("package.json"):
        spec = json.loads(content)
        return sorted({*spec.get("dependencies", {}), *spec.get("devDependencies", {})})
    if name.endswith("go.mod"):
        return sorted(set(re.findall(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v", content, re.M)))
    if name.endswith("Cargo.toml"):
        return sorted(tomllib.loads(content).get("dependencies", {}))
    return []


def load_rules(content: str) -> dict:
    """Layer rules of a JSON or TOML document: layers, mappings (pattern, layer), rules, exceptions."""
    import json

    spec = json.loads(content) if content.lstrip().startswith("{") else tomllib.loads(content)
    errors = [f"unknown layer {m['layer']}" for m in spec.get("mappings", []) if m["layer"] not in spec.get("layers", {})]
    if errors:
        raise ValueError("; ".join(errors))
    return spec


def write_versioned(df: DataFrame, root: str, version: int) -> str:
    """A new immutable version of a table; readers switch by the path."""
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def upsert_table(base: DataFrame, updates: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """The merged table, cut from its inputs, ready to be written over them."""
    return materialise(upsert(base, updates, keys, recency), "upsert")


def append_audit(events: DataFrame, path: str, columns: list[str]) -> None:
    """Redacted events as JSON lines."""
    events.select(*(T.redacted(F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in events.columns)).write.mode("append").json(path)


def vector_sink(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of the right length only; another length fails the job."""
    good = F.size("embedding") == dim
    return vectors.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("wrong dimension for "), F.col("id").cast("string")))))


def lru_evict(cache: DataFrame, cap: int, size: str = "size", used: str = "used") -> DataFrame:
    """The most recently used entries that fit in four fifths of ``cap`` bytes, all if they fit in ``cap``."""
    total = cache.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"))
    hour = F.date_trunc("hour", F.col(used))
    # Running sums within an hour, on top of the sums of later hours: no task orders the whole cache.
    hours = cache.groupBy(hour.alias("hour")).agg(F.sum(size).alias("s")).withColumn("later", F.coalesce(F.sum("s").over(W.orderBy(F.desc("hour")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    running = cache.withColumn("hour", hour).withColumn("r", F.sum(size).over(W.partitionBy("hour").orderBy(F.desc(used), "key"))).join(hours.select("hour", "later"), "hour")
    return running.join(F.broadcast(total)).filter((F.col("total") <= cap) | (F.col("r") + F.col("later") <= 0.8 * cap)).select(*cache.columns)
