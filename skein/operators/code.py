"""Source trees as relations: imports of several languages and the files they name, test pairs, project facts, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# What error texts must not show, and what is shown instead.
ERROR_MASKS = (
    (r'File ".*?", line', "[Internal file path]"),
    (r"/home/[^/]+/[^/\s]+", "[Internal path]"),
    (r"/tmp/[^/\s]+", "[Temporary path]"),
    (r"sqlite3\.[A-Z]+Error: .*", "[Database error]"),
    (r"Traceback.*", "[Internal error]"),
    (r'column ".*?" does not exist', "[Database schema error]"),
    (r'table ".*?" does not exist', "[Database schema error]"),
)
ERROR_MESSAGES = (
    ("sqlite3.OperationalError", "Database operation failed"),
    ("sqlite3.IntegrityError", "Data integrity constraint violated"),
    ("sqlite3.DatabaseError", "Database error occurred"),
    ("FileNotFoundError", "Requested resource not found"),
    ("PermissionError", "Access denied"),
    ("SyntaxError", "Invalid syntax in query"),
    ("ValueError", "Invalid input provided"),
    ("KeyError", "Required field missing"),
    ("TypeError", "Invalid data type provided"),
    ("TimeoutError", "Operation timed out"),
)
OTHER_ERROR = "An internal error occurred"
# Extensions that a script's import may leave out, and files that start a program.
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".d.ts", ".d.mts")
INDEX_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs")
ENTRY_FILES = ("main.py", "__main__.py", "cli.py", "app.py", "wsgi.py", "asgi.py", "manage.py", "celery.py")

#: What each language's import statements name, as the first group.
IMPORTS = {
    "python": r"(?m)^[ \t]*(?:import|from)[ \t]+(\.*[A-Za-z_][A-Za-z0-9_.]*|\.+)",
    "typescript": r"""(?:\bfrom|\bimport|\brequire[ \t]*\(|\bimport[ \t]*\()[ \t]*['"]([^'"]+)['"]""",
    "go": r'(?m)^[ \t]*(?:import[ \t]+)?(?:[A-Za-z_.][A-Za-z0-9_]*[ \t]+)?"([^"]+)"[ \t]*$',
    "rust": r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([A-Za-z_][A-Za-z0-9_:]*[A-Za-z0-9_])",
    "c": r'(?m)^[ \t]*#[ \t]*include[ \t]+(<[^>]+>|"[^"]+")',
}


def masked_error(text: Column) -> Column:
    """An error text for logs, without paths, traces and schema names."""
    for pattern, instead in ERROR_MASKS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def shown_error(text: Column) -> Column:
    """The general message that a user sees: of the first kind that the text names."""
    out = F.lit(OTHER_ERROR)
    for kind, message in reversed(ERROR_MESSAGES):
        out = F.when(text.contains(kind), message).otherwise(out)
    return out


def guidance(tool: Column, text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The advice of the first rule (tool, part of the text, advice) that holds; null where no error shows or none fits.

    A tool that has rules of which none fits is sent to its documentation.
    """
    low = F.lower(text)
    out = F.when(tool.isin(*sorted({t for t, _, _ in rules})), F.concat(F.lit("Check docs for "), tool, F.lit(".")))
    for name, part, advice in reversed(rules):
        out = F.when((tool == name) & low.contains(part.lower()), F.lit(advice)).otherwise(out)
    return F.when(text.contains("Error:") | F.substring(low, 1, 50).contains("error"), out)


def imports(files: DataFrame) -> DataFrame:
    """(path, lang, module): distinct imports of the files (path, lang, text)."""
    found = F.array().cast("array<string>")
    for lang, pattern in IMPORTS.items():
        found = F.when(F.col("lang") == lang, F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).otherwise(found)
    return files.select("path", "lang", F.explode(F.array_distinct(found)).alias("module"))


def clean_path(path: Column) -> Column:
    """``.`` and ``..`` resolved; steps above the root are dropped."""
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def candidates(lang: Column, path: Column, module: Column) -> Column:
    """The files, best first, that an import may mean; empty for system headers and packages from elsewhere."""
    here = S.parent_dir(path)
    near = lambda name: F.concat(here, F.lit("/"), name)
    every = lambda base, ends: [F.concat(base, F.lit(e)) for e in ends]
    # Python: dots in front climb from the file's own directory, one less than their number.
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    dotted = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat(here, F.lit("/"), F.repeat(F.lit("../"), dots - 1), dotted)
    roots = [F.concat(F.lit("src/"), dotted), dotted, near(dotted)]
    python = F.when(dots > 0, F.array(*every(up, (".py", "/__init__.py")))).otherwise(F.array(*(x for r in roots for x in every(r, (".py", "/__init__.py")))))
    relative = F.when(module.rlike(r"^\.\.?/"), near(module)).otherwise(module)
    script = F.when(module.startswith("@") | ~module.contains("/"), F.array().cast("array<string>")).otherwise(F.array(*every(relative, SCRIPT_EXTENSIONS), *every(relative, ["/index" + e for e in INDEX_EXTENSIONS])))
    # Rust: paths of the crate are files below src; the last part may be an item of its module.
    parts = F.split(F.regexp_replace(module, "^(crate|self|super)::", ""), "::")
    whole, outer = F.array_join(parts, "/"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    rust = F.when(module.rlike("^(crate|self|super)::"), F.array(*(F.concat(F.lit("src/"), x, F.lit(e)) for x in (whole, outer) for e in (".rs", "/mod.rs")))).otherwise(F.array().cast("array<string>"))
    quoted = F.regexp_replace(module, '"', "")
    header = F.when(module.startswith("<"), F.array().cast("array<string>")).otherwise(F.array(near(quoted), quoted))
    found = F.when(lang == "python", python).when(lang == "typescript", script).when(lang == "rust", rust).when(lang == "c", header).otherwise(F.array().cast("array<string>"))
    return F.transform(found, clean_path)


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, target): the first candidate of each import that is a file. Candidates meet files by equality."""
    tried = found.select("path", "module", F.posexplode(candidates(F.col("lang"), F.col("path"), F.col("module"))).alias("place", "target"))
    # Both sides grow with the files. Spark judges their sizes by the columns that the paths are made of, and would broadcast them.
    known = files.select(F.col("path").alias("target")).distinct().hint("merge")
    return tried.join(known, "target").filter("target <> path").groupBy("path", "module").agg(F.min_by("target", "place").alias("target"))


def resolve_go(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, dir, first, files) of Go imports: the directory of the project whose path is the longest end of the
    import's, its first file and how many it has. Ends of imports meet directories by equality."""
    dirs = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "path").groupBy("dir").agg(F.min("path").alias("first"), F.count("*").alias("files"))
    parts = F.split("module", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    tried = found.filter("lang = 'go'").select("path", "module", F.posexplode(ends).alias("place", "dir"))
    best = tried.join(dirs, "dir").groupBy("path", "module").agg(F.min(F.struct("place", "dir", "first", "files")).alias("x"))
    return best.filter(F.regexp_replace("path", "/[^/]*$", "") != F.col("x.dir")).select("path", "module", "x.dir", "x.first", "x.files")


def stem(path: Column) -> Column:
    """The file's name without extension, ``test_`` in front and ``_test`` behind."""
    bare = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"\.[^.]*$", "")
    return F.when(bare.startswith("test_"), F.substring(bare, 6, 1 << 20)).when(bare.endswith("_test"), F.regexp_replace(bare, "_test$", "")).otherwise(bare)


def test_pairs(files: DataFrame) -> DataFrame:
    """(path, other, reason, confidence): tests of each source file, and sources of each test, by names."""
    here, s = S.parent_dir(F.col("path")), stem(F.col("path"))
    bare = F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"\.[^.]*$", "")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    tests = F.array(*(join("tests/test_", s, e) for e in (".py", ".rs", ".go")), join(here, "/test_", bare, ".py"), join(here, "/", s, "_test.py"), join("test_", s, ".py"), join(s, "_test.py"))
    sources = F.array(join("src/", s, ".py"), join(s, ".py"), join("lib/", s, ".py"), join(S.parent_dir(here), "/", s, ".py"))
    is_test = bare.startswith("test_") | bare.endswith("_test")
    tried = files.select("path", F.when(is_test, 0.9).otherwise(0.95).alias("confidence"), F.explode(F.array_distinct(F.transform(F.when(is_test, sources).otherwise(tests), clean_path))).alias("other"))
    return tried.filter("other <> path").join(files.select(F.col("path").alias("other")).distinct(), "other", "left_semi").select("path", "other", F.lit("test_file").alias("reason"), "confidence")


def is_test_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"[^/]*$", 0))
    return path.endswith(".py") & (name.contains("test") | path.rlike("(^|/)tests/"))


def test_frameworks(files: DataFrame, project: str = "project") -> DataFrame:
    """(project, framework, test_files, entry_points) of files (project, path, text): the first rule that holds."""
    path, text = F.col("path"), F.coalesce(F.col("text"), F.lit(""))
    test = is_test_file(path)
    any_of = lambda c: F.max(F.coalesce(c, F.lit(False)))
    flags = files.groupBy(project).agg(
        any_of(path.isin("conftest.py") | path.rlike("(^|/)tests/(.*/)?conftest[.]py$")).alias("conftest"), any_of(path.isin("pyproject.toml", "pytest.ini", "setup.cfg", "tox.ini") & text.contains("pytest")).alias("config"),
        any_of((path == "requirements.txt") & F.lower(text).contains("pytest")).alias("required"), F.min(F.when(test & text.rlike("import pytest|from pytest|import unittest"), F.struct(path, F.when(text.rlike("import pytest|from pytest"), "pytest").otherwise("unittest").alias("f")))).alias("first"),
        any_of((path == "package.json") & (F.get_json_object(text, "$.dependencies.jest").isNotNull() | F.get_json_object(text, "$.devDependencies.jest").isNotNull())).alias("jest"),
        F.count_if(test).alias("test_files"), F.count_if(F.regexp_extract(path, r"[^/]*$", 0).isin(*ENTRY_FILES) & ~path.contains("test")).alias("entry_points"),
    )
    framework = F.when(F.col("conftest") | F.col("config") | F.col("required"), "pytest").when(F.col("first").isNotNull(), F.col("first.f")).when(F.col("jest"), "jest").otherwise("unknown")
    return flags.select(project, framework.alias("framework"), "test_files", "entry_points")


def class_metrics(bases: DataFrame, methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(class, depth, num_bases, num_methods, num_overrides, is_abstract, has_concrete_methods).

    ``bases`` (class, base), ``methods`` (class, name, abstract), ``ancestors`` (class, ancestor). A method that an
    ancestor has too is an override, else the class's own.
    """
    above = ancestors.join(methods.select(F.col("class").alias("ancestor"), "name").distinct(), "ancestor").select("class", "name").distinct().withColumn("again", F.lit(True))
    per = methods.groupBy("class", "name").agg(F.max("abstract").alias("abstract")).join(above, ["class", "name"], "left")
    counts = per.groupBy("class").agg(F.count_if(F.col("again").isNull()).alias("num_methods"), F.count_if("again").alias("num_overrides"), F.max("abstract").alias("is_abstract"))
    out = bases.groupBy("class").agg(F.count_distinct("base").alias("num_bases")).join(ancestors.groupBy("class").agg(F.count_distinct("ancestor").alias("depth")), "class", "full").join(counts, "class", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    abstract = F.coalesce("is_abstract", F.lit(False))
    return out.select("class", zero("depth"), zero("num_bases"), zero("num_methods"), zero("num_overrides"), abstract.alias("is_abstract"), (~abstract & (F.coalesce("num_methods", F.lit(0)) > 0)).alias("has_concrete_methods"))


def page(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows with ``total`` and whether that cuts any off."""
    total = rows.agg(F.count("*").alias("total"))
    first = rows.orderBy(*order).limit(limit)
    return first.join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)  # one row


def exceptions(violations: DataFrame, rules: list[tuple[str, str]], path: str = "file") -> DataFrame:
    """``violations`` with the severity of the first rule (shell pattern, severity) that the path matches, else ``error``."""
    severity = F.lit("error")
    for pattern, level in reversed(rules):
        severity = F.when(F.col(path).rlike(S.glob_regex(pattern)), level).otherwise(severity)
    return violations.withColumn("severity", severity)


def counted(violations: DataFrame, fail_on: str = "error") -> DataFrame:
    """(errors, warnings) among the violations that count: errors, and with ``fail_on`` = ``warn`` all."""
    kept = violations if fail_on == "warn" else violations.filter("severity = 'error'")
    return kept.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))


def dot_lines(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(line): the edges of a graph in the DOT language; quotes in names are escaped."""
    name = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), name(src), F.lit(" -> "), name(dst), F.lit(";")).alias("line"))


def html_rows(rows: DataFrame) -> DataFrame:
    """(line): each row as a row of an HTML table, escaped; null cells are empty."""
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(plain), F.lit(safe))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    return rows.select(F.concat(F.lit("<tr>"), *(cell(c) for c in rows.columns), F.lit("</tr>")).alias("line"))
