"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts scores.

Everything runs as built-in SQL functions on the executors' JVM. The spans of one kind come from one
array expression: ``regexp_extract_all`` gives the matches and ``split`` by the same expression the
gaps between them, so running sums of their lengths are the positions (in code points). The gap in
front of a match also holds the words that may raise its score.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are the base: a match that passes its check stays,
whatever its score. Kinds of the method's own (``iban``: mod-97; ``ssn``: only near words that name
it) need a score of ``MIN_SCORE``.

Defined results: a null text is read as empty and has no spans; texts are read whole; equal rows get
equal spans; spans of different kinds may overlap, those of one kind never do; an empty table gives
an empty table; columns other than the key and the text are ignored (``redact`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: A span that the base does not hold is kept from this score on.
MIN_SCORE = 0.5
#: Code points in front of a match that are searched for context words.
CONTEXT_CHARS = 40

SPAN = "struct<start:int,rank:int,end:int,score:double>"

DIGITS = "regexp_replace(z.m, '[^0-9]', '')"
#: Sum of Luhn's digits from the right, as a condition on the digits ``d``.
LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + if((length({d}) - i) % 2 = 0,"
    " int(substring({d}, i, 1)), 2 * int(substring({d}, i, 1)) - if(int(substring({d}, i, 1)) > 4, 9, 0))) % 10 = 0"
)
#: ISO 13616: four leading characters move to the end, letters become 10..35, the rest mod 97 is 1.
MOD97 = (
    "aggregate(sequence(1, length({v})), 0, (a, i) -> if(substring(concat(substring({v}, 5), left({v}, 4)), i, 1) between '0' and '9',"
    " (a * 10 + ascii(substring(concat(substring({v}, 5), left({v}, 4)), i, 1)) - 48) % 97,"
    " (a * 100 + ascii(substring(concat(substring({v}, 5), left({v}, 4)), i, 1)) - 55) % 97)) = 1"
)


@dataclass(frozen=True)
class Kind:
    """``cheap`` is a condition that every text with a match meets; ``check`` sees the match as z.m."""

    name: str
    pattern: str
    cheap: str
    check: str
    score: float
    context: str
    base: bool = True


# Possessive quantifiers and the look-behinds after \G change no match: they only keep long runs of
# one class from being tried again from each of their characters, and Java's matcher from recursing.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(TEXT, '@')", "true", 0.9, "mail|contact|schreib|correo|courriel"),
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"TEXT rlike r'[0-9][.][0-9]'",
        "forall(split(z.m, '[.]'), q -> q rlike '^0*+(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')", 0.7, r"\bip\b|address|host|server|login",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"TEXT rlike r'[0-9](?:[\x20-]?[0-9]){13}'", f"length({DIGITS}) between 14 and 19 and {LUHN.format(d=DIGITS)}", 0.8, "card|visa|master|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(TEXT, '+')", f"length({DIGITS}) between 10 and 15", 0.6, "tel|phone|call|mobile|fax|anruf|appel|llam"),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", r"TEXT rlike r'[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]'",
        MOD97.format(v="replace(z.m, ' ', '')"), 0.8, "iban|konto|account|bank|cuenta|compte", False,
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"TEXT rlike r'[0-9]{3}-[0-9]{2}-[0-9]{4}'", "not z.m rlike '^(?:000|666|9)|-00-|-0000'", 0.3, r"\bssn\b|social security", False),
)


def quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def kind_spans(kind: Kind, rank: int, text: str = "text") -> Column:
    """Spans of one kind in the column ``text``, in text order."""
    p, t = quoted(kind.pattern), f"`{text}`"
    context = f"right(z.p, {CONTEXT_CHARS}) rlike {quoted('(?i)' + kind.context)}"
    score = f"least(1D, {kind.score}D + if({context}, 0.3D, 0D))"
    keep = kind.check if kind.base else f"({kind.check}) and {score} >= {MIN_SCORE}D"
    # "x" binds both arrays once, whatever the optimiser does with the columns around it.
    return F.expr(f"""
        if({kind.cheap.replace("TEXT", t)}, flatten(transform(array(struct(split({t}, {p}, -1) AS p, regexp_extract_all({t}, {p}, 0) AS m)), x ->
            aggregate(zip_with(slice(x.p, 1, size(x.m)), x.m, (p, m) -> struct(p AS p, m AS m)),
                struct(0 AS at, cast(array() AS array<{SPAN}>) AS spans),
                (acc, z) -> struct(acc.at + length(z.p) + length(z.m) AS at,
                    if({keep}, array_append(acc.spans, struct(acc.at + length(z.p) AS start, {rank} AS rank, acc.at + length(z.p) + length(z.m) AS end, {score} AS score)), acc.spans) AS spans),
                acc -> acc.spans))), cast(array() AS array<{SPAN}>))""")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, one array of spans per kind, ``base`` and ``spans``: sorted by start, then kind).

    A span is struct(start, rank, end, score); ``rank`` is the kind's place in ``KINDS``.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("key", *(kind_spans(k, i).alias(k.name) for i, k in enumerate(KINDS)))
    base = F.array_sort(F.concat(*(F.col(k.name) for k in KINDS if k.base)))
    return rows.withColumns({"base": base, "spans": F.array_sort(F.concat(*(F.col(k.name) for k in KINDS)))}).withColumnRenamed("key", key)


def span_list(column: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(column, lambda z: F.concat_ws(":", F.element_at(names, z["rank"] + 1), z["start"], z["end"])), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts of the base kinds, digest of the base spans, all spans) of each whole text."""
    found = detect(docs, key, text)
    return found.select(
        key,
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(span_list("base"), 256).alias("base_sha256"),
        span_list("spans").alias("spans"),
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if not k.base),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one.

    Of overlapping spans the first (smallest start, then kind) names the replacement. A null text
    stays null. All columns stay, in their order.
    """
    rows = docs.withColumn(text, F.col(text).cast("string"))
    spans = {k.name: kind_spans(k, i, text) for i, k in enumerate(KINDS)}
    names = "array(" + ", ".join(f"'[{k.name.upper()}]'" for k in KINDS) + ")"
    all_spans = F.array_sort(F.concat(*spans.values()))
    (held,) = fresh(docs, "spans")
    rows = rows.withColumn(held, F.when(F.col(text).isNotNull(), all_spans))
    out = F.expr(f"""
        aggregate(`{held}`, struct(0 AS at, cast(array() AS array<string>) AS parts),
            (acc, z) -> if(z.start < acc.at,
                struct(greatest(acc.at, z.end) AS at, acc.parts AS parts),
                struct(z.end AS at, concat(acc.parts, array(substring(`{text}`, acc.at + 1, z.start - acc.at), element_at({names}, z.rank + 1))) AS parts)),
            acc -> concat(array_join(acc.parts, ''), substring(`{text}`, acc.at + 1)))""")
    return rows.withColumn(text, F.when(F.size(held) > 0, out).otherwise(F.col(text))).drop(held)
