"""Tokens, query cleaning, redaction and intent as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"

# Words of source code that name nothing, by origin.
STOP_WORDS = frozenset(
    "import from def class return if else elif for while try except finally with as pass break continue and or not in is None True False self cls super raise yield lambda"
    " pub fn let mut use mod struct enum impl const static var func type interface package require export default extends implements public private protected void int str"
    " bool float double char string null undefined new this typeof instanceof assert namespace include define ifndef endif async await of case switch sizeof typedef template"
    " typename __init__ __str__ __repr__ __call__ println print format assert_eq Some Ok Err".split()
)
# Patterns of personal data and secrets that reports look for.
PII_PATTERNS = {
    "email": r"[\w\.\-]+@[\w\.\-]+\.\w+",
    "api_key": r"(?i)(?:api[_\-]?key|secret|token|password)\s*[:=]\s*['\"][^'\"]+['\"]",
    "file_path": r"(?:/home/|/Users/|C:\\|/var/|/etc/)[^\s]+",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9_]{36,40}",
    "private_key_marker": r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----",
}
AUDIT_SECRETS = (PII_PATTERNS["api_key"], r"[A-Za-z0-9]{32,}")
# Words that tell what a question is about, in order of precedence on ties.
INTENTS = {
    "find_usage": ("used by", "usage", "callers", "references", "who calls", "where used"),
    "impact": ("impact", "affect", "break", "depend", "dependency", "blast radius"),
    "refactor": ("rename", "replace", "change", "modify", "update", "refactor"),
    "semantic": ("similar", "like", "meaning", "concept", "find by meaning"),
    "definition": ("definition", "defined", "implementation", "source"),
    "validate": ("validate", "check", "lint", "syntax", "error"),
    "docs": ("document", "docstring", "signature", "overview", "summary"),
    "structural_search": ("pattern", "structure", "all imports", "all decorators", "all returns"),
    "find_symbol": ("find", "locate", "where is", "show me", "what does", "list"),
}
SYMBOL_WORDS = ("function", "class", "method", "variable", "constant", "interface", "type")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def identifiers(text: Column) -> Column:
    """Identifier-like words without stop-words; repeats stay."""
    stop = F.array(*(F.lit(w) for w in sorted(STOP_WORDS)))
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), lambda w: ~F.array_contains(stop, w))


def clean_query(query: Column) -> Column:
    """At most 500 characters, no boolean words, no special characters, single spaces."""
    q = F.replace(F.substring(F.coalesce(query, F.lit("")), 1, 500), F.lit('"'), F.lit('""'))
    q = F.regexp_replace(q, r"(?i)\b(OR|AND|NOT|NEAR)\b", " ")
    q = F.regexp_replace(q, r'[\\"()+\-*:<>^@]', " ")
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def redacted(text: Column, patterns: tuple[str, ...] = AUDIT_SECRETS, limit: int | None = 500) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return truncated(text, limit) if limit else text


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def intent(query: Column) -> Column:
    """The intent with most words in the query; ties go to the more specific one."""
    q = F.lower(F.coalesce(query, F.lit("")))
    scored = []
    for rank, (name, words) in enumerate(INTENTS.items()):
        hits = F.size(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(q, w)))
        if name == "find_symbol":
            hits = hits + F.when(contains_any(q, SYMBOL_WORDS) & (q.contains("find") | q.contains("where")), 2).otherwise(0)
        scored.append(F.struct(hits.alias("hits"), F.lit(-rank).alias("rank"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["name"]).otherwise("unknown")


def balanced(text: Column) -> Column:
    """Whether the text opens as many parentheses as it closes."""
    n = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return n("(") == n(")")
