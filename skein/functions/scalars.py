"""Scores, classes and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priors by symbol kind.
KIND_PRIORITY = {"function": 5.0, "class": 4.0, "method": 3.0, "variable": 2.0, "constant": 1.0, "import": 1.0}
KIND_BOOST = {"class": 1.0, "function": 1.0, "method": 0.8, "constant": 0.7, "variable": 0.4, "alias": 0.5, "module": 0.6}
RELEVANCE_WEIGHTS = {"semantic": 0.40, "recency": 0.15, "usage": 0.15, "kind": 0.10, "proximity": 0.10, "callgraph": 0.10}


def lookup(values: dict[str, float], column: Column, default: float) -> Column:
    """A constant map applied to a lower-cased column."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.lower(column)], F.lit(default))


def kind_priority(kind: Column) -> Column:
    return lookup(KIND_PRIORITY, kind, 0.0)


def kind_boost(kind: Column) -> Column:
    return lookup(KIND_BOOST, kind, 0.5)


def instability(fan_in: Column, fan_out: Column) -> Column:
    return F.when(fan_in + fan_out > 0, fan_out / (fan_in + fan_out)).otherwise(0.0)


def spof(fan_in: Column, unstable: Column) -> Column:
    """Single-point-of-failure score: many dependents of a stable node."""
    return F.least(F.lit(1.0), F.log1p(fan_in) * (1 - unstable) / F.log(F.lit(100.0)))


def recency(days: Column) -> Column:
    return F.when(days <= 0, 1.0).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.exp(-days / 30.0))))


def usage(references: Column, most: Column | float = 100.0) -> Column:
    top = F.greatest(F.lit(1.0), most if isinstance(most, Column) else F.lit(most))
    return F.log1p(references) / F.log1p(top)


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def proximity(path: Column, current: Column) -> Column:
    near = F.when(current.isNull() | (current == ""), 0.5).when(path == current, 1.0).when(parent_dir(path) == parent_dir(current), 0.7)
    return near.when(path.contains("src") & current.contains("src"), 0.5).otherwise(0.2)


def history_modifier(count: Column, days_since: Column) -> Column:
    """Dampens what was injected often, and fades with the days since."""
    return F.when(count >= 3, 0.8).otherwise(1.0) * F.exp(-F.greatest(days_since, F.lit(0)) / 30.0)


def relevance(parts: dict[str, Column], modifier: Column | None = None, weights: dict[str, float] = RELEVANCE_WEIGHTS) -> Column:
    if not 0.95 <= sum(weights.values()) <= 1.05:
        raise ValueError("relevance weights must sum to about 1")
    total = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total * (modifier if modifier is not None else F.lit(1.0))))


def token_estimate(signature: Column, docstring: Column) -> Column:
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return F.least(150 + F.floor(size(signature) / 4) + F.floor(size(docstring) / 4), F.lit(1000)).cast("long")


def available_budget(window: Column, existing: Column, protected: Column) -> Column:
    return F.greatest(F.lit(0), window - existing - 500 * protected)


def risk_class(direct: Column) -> Column:
    return F.when(direct >= 10, "high").when(direct >= 3, "medium").when(direct >= 1, "low").otherwise("none")


def usage_boost(calls: Column, errors: Column, days_since: Column) -> Column:
    earned = (calls - errors) / F.greatest(calls, F.lit(1)) * 0.15
    earned = earned + F.when(calls > 50, 0.03).otherwise(0.0) + F.when(calls > 200, 0.02).otherwise(0.0) - F.when(days_since > 7, 0.05).otherwise(0.0)
    return F.when(F.coalesce(calls, F.lit(0)) == 0, -0.02).otherwise(F.round(earned, 3))


def health(total: Column, missing: Column, contradictions: Column, dead: Column) -> Column:
    lost = 50.0 * missing / F.greatest(total, F.lit(1)) + F.least(2 * contradictions, F.lit(30)) + F.least(5 * dead, F.lit(20))
    return F.when(total == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 - lost, 1))))


def module_of(path: Column) -> Column:
    """``src/a/b.py`` -> ``a.b``; a package's ``__init__`` is the package."""
    dotted = F.translate(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), "/", ".")
    return F.regexp_replace(F.regexp_replace(dotted, r"^src\.", ""), r"\.?__init__$", "")


def module_prefixes(module: Column) -> Column:
    """``a.b.c`` -> [a, a.b, a.b.c], for prefix joins by equality."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def is_test_path(path: Column) -> Column:
    name = F.regexp_extract(path, "[^/]*$", 0)
    return name.startswith("test_") | name.rlike(r"_test\.[A-Za-z]+$") | path.contains("/tests/") | path.contains("/testing/")


def human_size(n: Column, most: str = "TB") -> Column:
    """A number of bytes in the largest unit that it fills, up to ``most``: one decimal, half to even as C's ``%.1f``, and no
    marks between thousands. Whole numbers throughout, so that no rounding of logarithms or quotients shows."""
    units = ("B", "KB", "MB", "GB", "TB")
    n, out = n.cast("long"), None
    for at, unit in enumerate(units[: units.index(most) + 1]):
        size = F.lit(1024**at)
        rest = (n % size) * 10
        tenth, left = F.floor(rest / size), 2 * (rest % size)
        whole = (n - n % size) / size  # exact below 2^53
        up = (left > size) | ((left == size) & (tenth % 2 == 1))
        tenths = whole.cast("long") * 10 + tenth + F.when(up, 1).otherwise(0)
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.abs(tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = text if out is None else F.when(n >= size, text).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` crosses ``/``."""
    out = []
    for c in pattern:
        out.append({"*": ".*", "?": "."}.get(c) or ("\\" + c if c in r"\.^$+{}[]()|" else c))
    return "^" + "".join(out) + "$"


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    """A parameter within its bounds; null means the default."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def cycle_severity(length: Column) -> Column:
    return F.when(length <= 3, "high").otherwise("medium")
