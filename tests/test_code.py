"""Source trees, clusterings and reports on hand-made frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import cluster, code, refresh

FILES = [
    ("src/pkg/__init__.py", "python", ""), ("src/pkg/a.py", "python", "import os\nfrom . import b\nfrom .sub.c import x\nfrom ..top import y\nimport pkg.sub.c as z\n    import late\n"), ("src/pkg/b.py", "python", "from pkg import a"),
    ("src/pkg/sub/c.py", "python", None), ("src/top.py", "python", "import pkg"),
    ("web/x.ts", "typescript", "import a from './lib';\nimport '../web/y';\nconst z = require(\"./y\")\nexport {q} from '@scope/p/q'\nimport('web/lib/index')"), ("web/y.tsx", "typescript", ""), ("web/lib/index.js", "typescript", ""),
    ("src/lib.rs", "rust", "use std::fmt;\npub use crate::net::Socket;\nuse crate::io::{Read, Write};"), ("src/net.rs", "rust", ""), ("src/io/mod.rs", "rust", ""),
    ("c/main.c", "c", '#include <stdio.h>\n  # include "util.h"\n#include "inc/deep.h"'), ("c/util.h", "c", ""), ("inc/deep.h", "c", ""), ("m.go", "go", 'package m\nimport (\n\t"fmt"\n\tx "a/b"\n)\nimport "c/d"\n'),
]


def test_imports_and_their_files(spark):
    files = spark.createDataFrame(FILES, "path string, lang string, text string")
    found = code.imports(files)
    by = {}
    for r in found.collect():
        by.setdefault(r.path, set()).add(r.module)
    assert by["src/pkg/a.py"] == {"os", ".", ".sub.c", "..top", "pkg.sub.c", "late"} and by["m.go"] == {"fmt", "a/b", "c/d"} and by["src/lib.rs"] == {"std::fmt", "crate::net::Socket", "crate::io"}
    got = {(r.path, r.module): r.target for r in code.resolve(found, files).collect()}
    assert got == {
        ("src/pkg/a.py", "."): "src/pkg/__init__.py", ("src/pkg/a.py", ".sub.c"): "src/pkg/sub/c.py", ("src/pkg/a.py", "..top"): "src/top.py", ("src/pkg/a.py", "pkg.sub.c"): "src/pkg/sub/c.py", ("src/pkg/b.py", "pkg"): "src/pkg/__init__.py",
        ("src/top.py", "pkg"): "src/pkg/__init__.py", ("web/x.ts", "./lib"): "web/lib/index.js", ("web/x.ts", "../web/y"): "web/y.tsx", ("web/x.ts", "./y"): "web/y.tsx", ("web/x.ts", "web/lib/index"): "web/lib/index.js",
        ("src/lib.rs", "crate::net::Socket"): "src/net.rs", ("src/lib.rs", "crate::io"): "src/io/mod.rs", ("c/main.c", '"util.h"'): "c/util.h", ("c/main.c", '"inc/deep.h"'): "inc/deep.h",
    }


def test_pairs_of_tests_and_sources(spark):
    paths = ["src/a.py", "tests/test_a.py", "lib/b.py", "lib/b_test.py", "pkg/tests/test_c.py", "pkg/c.py", "lonely.py"]
    got = {(r.path, r.other): r.confidence for r in code.test_pairs(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {("src/a.py", "tests/test_a.py"): 0.95, ("tests/test_a.py", "src/a.py"): 0.9, ("lib/b.py", "lib/b_test.py"): 0.95, ("lib/b_test.py", "lib/b.py"): 0.9, ("pkg/tests/test_c.py", "pkg/c.py"): 0.9}


def test_class_metrics(spark):
    bases = spark.createDataFrame([("B", "A"), ("C", "B"), ("C", "M")], "class string, base string")
    methods = spark.createDataFrame([("A", "f", True), ("B", "f", False), ("B", "g", False), ("C", "g", False), ("C", "h", False), ("C", "h", False)], "class string, name string, abstract boolean")
    above = spark.createDataFrame([("B", "A"), ("C", "B"), ("C", "A"), ("C", "M")], "class string, ancestor string")
    got = {r["class"]: tuple(r)[1:] for r in code.class_metrics(bases, methods, above).collect()}
    assert got == {"A": (0, 0, 1, 0, True, False), "B": (1, 1, 1, 1, False, True), "C": (3, 2, 1, 1, False, True)}


def test_errors_pages_and_sinks(spark):
    df = spark.createDataFrame([("Traceback (most recent)",), ('table "x" does not exist at /tmp/zz/q',), ("KeyError: 'a'",), (None,)], "t string")
    assert [tuple(r) for r in df.select(code.masked_error(F.col("t")), code.shown_error(F.col("t"))).collect()] == [
        ("[Internal error]", code.OTHER_ERROR), ("[Database schema error] at [Temporary path]/q", code.OTHER_ERROR), ("KeyError: 'a'", "Required field missing"), (None, code.OTHER_ERROR),
    ]
    page = code.page(spark.range(5).withColumnRenamed("id", "x"), ["x"], 2).collect()
    assert [tuple(r) for r in page] == [(0, 5, True), (1, 5, True)] and code.page(spark.range(0), ["id"], 2).count() == 0
    odd = spark.createDataFrame([('a"b', "<&>"), (None, "x")], "src string, dst string")
    assert code.html_rows(odd).collect()[0].line == "<tr><td>a&quot;b</td><td>&lt;&amp;&gt;</td></tr>" and code.dot_lines(odd).first().line == '  "a\\"b" -> "<&>";'


def test_merging_and_cutting_clusters(spark):
    rows = [(i, c) for i, c in enumerate(["r00"] * 5 + ["r010"] * 1 + ["r011"] * 4 + ["r1"] * 3)]
    labels = spark.createDataFrame(rows, "id long, cluster string")
    count = lambda df: {r.cluster: r["count"] for r in df.groupBy("cluster").count().collect()}
    assert count(cluster.merge_small(labels, 3)) == {"r00": 5, "r011": 5, "r1": 3}
    assert count(cluster.merge_small(labels, 1)).popitem()[1] == 13 and count(cluster.merge_small(labels, 9)) == count(labels)
    assert count(cluster.at_depth(labels, 1)) == {"r0": 10, "r1": 3} and cluster.merge_small(labels.limit(0), 2).count() == 0


def test_laplacian_update_equals_a_new_one(spark):
    rng = np.random.default_rng(3)
    before = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 12, (20, 2)) if a != b]
    after = [e for e in before if 3 not in e[:2]] + [(3, 99, 2.0)]
    frame = lambda e: cluster.fuse([(spark.createDataFrame(e, "src long, dst long, w double"), 1.0)])
    touched = spark.createDataFrame([(x,) for x in {v for e in set(before) ^ set(after) for v in e[:2]}], "id long")
    got, want = ({(r.src, r.dst): r.value for r in df.collect()} for df in (cluster.update_laplacian(cluster.laplacian(frame(before)), frame(after), touched), cluster.laplacian(frame(after))))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_refresh_reports_every_state(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, text string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, ""), (3, "")], "id long, text string")
    assert {r.id: r.status for r in refresh.refresh(refresh.hashed(old), refresh.hashed(new)).collect()} == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "added"}
