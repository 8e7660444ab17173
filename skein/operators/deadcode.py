"""Definitions of a Python tree that nothing seems to use, and what speaks for those that something might.

One pass reads every source for what it defines, refers to, exports and calls; the rest is joins over the whole tree.
Of each definition the first signal of life decides: its name is loaded somewhere, a framework decorator, an override
marker, an abstract method, an export, reached from an entry file along calls, or the implementation of an abstract method
of a base class. Names meet by equality, whatever their module, so doubt keeps code alive.

Defined results: sources that do not parse give nothing; a definition that stands twice in one scope of a file counts once;
private names are judged like others.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialise
from .code import ENTRY_FILES
from .graph import bfs
from .quality import dead_confidence

# Decorators by which a framework calls a function, and those that mark an override.
FRAMEWORK_DECORATORS = frozenset(
    (
        "route", "app.route", "blueprint.route", "Flask.route", "get", "post", "put", "delete", "patch", "options", "fastapi.get", "fastapi.post",
        "task", "celery.task", "shared_task", "command", "group", "click.command", "click.group", "admin.register", "admin.site.register", "receiver", "signal",
        "fixture", "pytest.fixture", "abstractmethod", "abc.abstractmethod",
    )
)
OVERRIDE_DECORATORS = frozenset(("override", "overrides", "impl", "implements"))
FACTS = "path string, record string, name string, owner string, kind string, framework boolean, override boolean, abstract boolean, other string"


class _Facts(ast.NodeVisitor):
    def __init__(self, path: str) -> None:
        self.path, self.classes, self.functions, self.rows = path, [], [], []

    def put(self, record: str, name: str, kind: str = "", marks: tuple[bool, bool, bool] = (False, False, False), other: str = "") -> None:
        self.rows.append((self.path, record, name, ".".join(self.classes), kind, *marks, other))

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        full = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        last = {f.rsplit(".", 1)[-1] for f in full}
        abstract = "abstractmethod" in last
        framework = not abstract and bool({*full, *last} & FRAMEWORK_DECORATORS)
        self.put("def", node.name, "method" if self.classes and not self.functions else "function", (framework, bool(last & OVERRIDE_DECORATORS), abstract))
        self.functions.append(node.name)
        self.generic_visit(node)
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.put("def", node.name, "class")
        for base in node.bases:
            self.put("base", node.name, other=ast.unparse(base).split("[")[0].rsplit(".", 1)[-1])
        self.classes.append(node.name)
        self.generic_visit(node)
        self.classes.pop()

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.put("ref", node.id)

    def visit_Call(self, node: ast.Call) -> None:
        called = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
        if called:
            for caller in self.functions or ["<module>"]:
                self.put("call", caller, other=called)
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, ast.List | ast.Tuple):
            for e in node.value.elts:
                if isinstance(e, ast.Constant) and isinstance(e.value, str):
                    self.put("export", e.value)
        self.generic_visit(node)


def facts(files: DataFrame) -> DataFrame:
    """What the sources (path, text) define (``def``), load (``ref``), export, call and derive from (``base``)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"], strict=True):
                reader = _Facts(path)
                try:
                    reader.visit(ast.parse(text or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += reader.rows
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.select("path", "text").mapInPandas(run, FACTS)


def dead_code(files: DataFrame) -> DataFrame:
    """(path, owner, name, kind, confidence, signal) of every definition: ``high`` where nothing speaks for it."""
    known = materialise(facts(files), "facts")
    of = lambda record: known.filter(F.col("record") == record)
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    definitions = of("def").groupBy("path", "owner", "name", "kind").agg(*(F.max(c).alias(c) for c in ("framework", "override", "abstract")))
    name = F.regexp_extract("path", "[^/]*$", 0)
    # Call edges join the definitions of names; what an entry file defines, or calls from its top, is where searches begin.
    entry = F.when(name.isin(*ENTRY_FILES) & ~F.col("path").contains("test"), True).otherwise(False)
    calls = of("call").select(F.col("name").alias("src"), F.col("other").alias("dst"), "path")
    begin = definitions.filter(entry).select(F.col("name").alias("id")).unionByName(calls.filter(entry & (F.col("src") == "<module>")).select(F.col("dst").alias("id"))).distinct()
    start = begin.select(F.lit("entry").alias("src"), F.col("id").alias("dst"))
    edges = calls.filter("src <> '<module>'").select("src", "dst").unionByName(start).distinct()
    reached = bfs(edges, known.sparkSession.createDataFrame([("entry",)], "id string")).filter("level > 0").select(F.col("id").alias("name"))
    own_entry = F.coalesce(F.col("entry"), F.lit(False))
    # An abstract method of a base is implemented by a method of its name in a class that derives from it.
    abstract = definitions.filter("abstract").select(F.col("owner").alias("base"), "name")
    bases = of("base").select("path", F.concat_ws(".", F.when(F.col("owner") != "", F.col("owner")), F.col("name")).alias("owner"), F.col("other").alias("base"))
    implements = flag(bases.join(abstract, "base").select("path", "owner", "name"), "interface")
    judged = definitions.join(flag(of("ref").select("name"), "referenced"), "name", "left").join(flag(of("export").select("path", "name"), "exported"), ["path", "name"], "left")
    judged = judged.join(flag(reached, "entry"), "name", "left").join(implements, ["path", "owner", "name"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    confidence, signal = dead_confidence({"referenced": yes("referenced"), "decorator": yes("framework"), "override": yes("override"), "abstract": yes("abstract"), "exported": yes("exported"), "entry_reachable": own_entry, "interface": yes("interface")})
    return judged.select("path", "owner", "name", "kind", confidence.alias("confidence"), signal.alias("signal"))
