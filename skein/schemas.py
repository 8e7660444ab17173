"""Fixed schemas of the logical relations; readers are given them and never infer."""

from __future__ import annotations

from pyspark.sql import types as T

SYMBOLS = T.StructType.fromDDL(
    "id string, name string, qualified_name string, kind string, file_path string, start_line int, end_line int, signature string, docstring string,"
    " is_public boolean, content_hash string, indexed_at timestamp, lang string"
)
EDGES = T.StructType.fromDDL("src string, dst string, target_name string, edge_type string, weight double, resolution_state tinyint, metadata string")
VECTORS = T.StructType.fromDDL("id string, embedding array<float>, model_version string")
COMMITS = T.StructType.fromDDL("commit string, ts timestamp, author string, file string, added long, deleted long")
SNAPSHOTS = T.StructType.fromDDL("codebase_id string, ts timestamp, files long, loc long, functions long, classes long, deps long, size_bytes long, commits_since_last long")
RANKED = T.StructType.fromDDL("factor string, id string, rn int")
FS_EVENTS = T.StructType.fromDDL("path string, op string, ts timestamp, dest string")
USAGE = T.StructType.fromDDL("tool string, ts timestamp, latency_ms double, ok boolean")

# Fixed values of the data model.
SYMBOL_KINDS = ("function", "class", "method", "variable", "constant", "import")
EDGE_KINDS = ("calls", "imports", "inherits", "instantiates", "implements")
UNRESOLVED, RESOLVED, STALE = 0, 1, 2
MAX_METADATA_CHARS = 1024
