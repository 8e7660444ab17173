"""Quality rules whose cutoffs come with a guarantee.

Each rule rejects a document when its value exceeds a cutoff. For every stratum and rule, labelled
documents (quality 1: good) say how many good documents each cutoff of a fixed grid would reject.
A cutoff is certified when an exact binomial test rules out a false-rejection rate above the rule's
share of ``ALPHA`` at the level ``DELTA / (rules x strata)``: Bonferroni over rules and strata. Within
a rule the cutoffs are nested, so they are tested in fixed order from lenient to strict and need no
further correction: certified cutoffs hold together. With probability ``1 - DELTA`` the rules
together falsely reject at most ``ALPHA`` of any stratum's good documents. Among certified cutoffs
the one with the best yield (bad rejected minus ``COST`` times good rejected) is used; where none is
certified or none pays, the rule is off in that stratum.

Everything is built-in SQL functions; one pass over the texts computes all values.

Defined results: a null text is read as empty and fails the base rule; a null stratum is a stratum of
its own; unlabelled strata have no cutoffs; several labels of a document count as bad if one is 0;
equal rows get equal results, one row per input row; an empty table gives an empty table; columns
other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

ALPHA = 0.05
DELTA = 0.05
COST = 10
WINDOW = 8
#: Cutoffs of so many strata are broadcast.
BROADCAST_STRATA = 10_000

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose ``value`` (SQL over the counts) is above the cutoff."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


def grid(low: float, high: float, steps: int) -> tuple[float, ...]:
    """``steps`` + 1 values from low to high in equal ratios."""
    return tuple(round(low * (high / low) ** (i / steps), 6) for i in range(steps + 1))


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", grid(0.01, 2.0, 16)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", grid(0.1, 0.9, 12)),
    Rule("repeat_words", "n_repeat_words / greatest(n_words, 1)", grid(0.02, 0.3, 10)),
    Rule("poor_words", "1 - n_distinct_words / greatest(n_words, 1)", grid(0.3, 0.95, 14)),
    Rule("shouting", "n_upper / greatest(word_chars, 1)", grid(0.1, 0.9, 12)),
)


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, word and line counts) of each whole text."""
    rows = docs.select(F.col(key).alias("key"), *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.select(
        "key", *keep, "t",
        F.expr(f"filter(split(t, r'{SPACES}+'), w -> w <> '')").alias("words"),
        F.expr(r"filter(split(t, '\n', -1), l -> l rlike r'[^\x20\x09-\x0D]')").alias("lines"),
    )
    # One-element arrays bind a value once; the windows are compared by 64-bit hash within a text.
    repeat = f"""
        if(size(words) < {WINDOW} + 1, 0L, element_at(transform(
            array(transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64(slice(words, i + 1, {WINDOW})))), h ->
            if(size(array_distinct(h)) = size(h), 0L, element_at(transform(
                array(array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))), s ->
                aggregate(
                    array_sort(transform(filter(s, (z, k) -> z.h = get(s, k - 1).h or z.h = get(s, k + 1).h), z -> z.i)),
                    struct({-WINDOW} AS at, 0L AS n),
                    (acc, i) -> struct(i AS at, acc.n + least({WINDOW}, i - acc.at) AS n),
                    acc -> acc.n)), 1))), 1))"""
    return rows.select(
        "key", *keep,
        F.size("words").cast("long").alias("n_words"),
        F.expr(r"cast(length(translate(t, ' \t\n\u000B\u000C\r', '')) as long)").alias("word_chars"),
        F.expr(f"cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as long)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr(repeat).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("cast(size(array_distinct(words)) as long)").alias("n_distinct_words"),
        F.expr("cast(length(t) - length(regexp_replace(t, r'[\\p{Lu}]', '')) as long)").alias("n_upper"),
    )


def with_values(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"v_{r.name}": F.expr(r.value).cast("double") for r in RULES} | {"base_failed": F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")})


def binomial_tail(n: str, k: str, p: float) -> str:
    """SQL for P(Bin(n, p) <= k), summed in logarithms term by term."""
    return f"""aggregate(sequence(1, cast({k} as int)), struct({n} * ln(1 - {p}D) AS t, exp({n} * ln(1 - {p}D)) AS s),
        (acc, i) -> struct(acc.t + ln(({n} - i + 1) * {p}D / (i * (1 - {p}D))) AS t, acc.s + exp(acc.t + ln(({n} - i + 1) * {p}D / (i * (1 - {p}D)))) AS s), acc -> acc.s)"""


def certify(values: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """(stratum, rule, cutoff, n_good, good_rejected, bad_rejected, p_value, certified): every tested cutoff.

    ``values``: key, stratum, v_<rule>, base_failed; ``labels``: key, good (boolean).
    Only documents that pass the base rule count: the cutoffs decide about no others.
    """
    held = labels.filter("key is not null and good is not null").groupBy("key").agg(F.min("good").alias("good"))
    share = alpha / len(RULES)
    long = F.explode(F.array(*(
        F.struct(F.lit(i).alias("rule"), F.expr(f"size(filter(array({', '.join(f'{c}D' for c in r.cutoffs)}), c -> v_{r.name} > c))").alias("above")) for i, r in enumerate(RULES)
    )))
    seen = values.filter("not base_failed").join(held, "key").select("stratum", "good", long.alias("x")).groupBy("stratum", "x.rule", "x.above").agg(F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # A document above ``above`` cutoffs is rejected by each of them: one row per stratum and rule holds all.
    by_rule = seen.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("above", "good", "bad")).alias("bins"))
    cutoffs = F.element_at(F.array(*(F.array(*(F.lit(c) for c in r.cutoffs)) for r in RULES)), F.col("rule") + 1)
    tested = by_rule.select("stratum", "rule", "n_good", "bins", F.posexplode(cutoffs).alias("i", "cutoff")).select(
        "stratum", "rule", "n_good", "cutoff",
        F.expr("aggregate(bins, 0L, (a, b) -> a + if(b.above > i, b.good, 0L))").alias("good_rejected"),
        F.expr("aggregate(bins, 0L, (a, b) -> a + if(b.above > i, b.bad, 0L))").alias("bad_rejected"),
    )
    tail = binomial_tail("n_good", "good_rejected", share)
    p = F.expr(f"if(n_good = 0 or good_rejected >= {share}D * n_good, 1D, if(good_rejected = 0, exp(n_good * ln(1 - {share}D)), {tail}))")
    strata = seen.agg(F.count_distinct(F.struct("stratum")).alias("strata"))
    level = F.lit(delta) / (len(RULES) * F.greatest(F.col("strata"), F.lit(1)))
    return tested.withColumn("p_value", p).join(F.broadcast(strata)).withColumn("certified", F.col("p_value") <= level).drop("strata")


def choose(tested: DataFrame, cost: float = COST) -> DataFrame:
    """(stratum, cut: cutoff per rule, null where off): the certified cutoff of best yield, the most lenient on ties."""
    good = tested.filter(F.col("certified")).withColumn("gain", F.col("bad_rejected") - cost * F.col("good_rejected")).filter("gain > 0")
    return good.groupBy("stratum").agg(
        *(F.max(F.when(F.col("rule") == i, F.struct("gain", "cutoff")))["cutoff"].alias(f"cut_{r.name}") for i, r in enumerate(RULES))
    )


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text", good: str = "quality") -> DataFrame:
    """(key, stratum, counts, values, base_failed, cutoffs, kept) of each document."""
    narrow = docs.select(F.col(key).alias("key"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"))
    values = with_values(materialise(counts(narrow, "key", "text", ("stratum",)), "quality"))
    cuts = choose(certify(values, labels.select(F.col(key).alias("key"), (F.col(good) == 1).alias("good")))).withColumnRenamed("stratum", "of")
    cuts = materialise(cuts, "cutoffs")
    # Few cutoffs are broadcast; many, of strata with many values, meet their rows by shuffle.
    few = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    out = values.join(few, F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(f"v_{r.name}") > F.col(f"cut_{r.name}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).withColumnRenamed("key", key)
