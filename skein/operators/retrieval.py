"""Keyword search, vector search and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..lineage import materialise

K1, B = 1.2, 0.75
RRF_K = 60


def keyword_search(docs: DataFrame, terms: list[str], text: str = "text", every: bool = True) -> DataFrame:
    """Documents that hold all (or any) of the terms."""
    held = T.tokens(F.col(text))
    hits = [F.array_contains(held, t) for t in terms]
    condition = hits[0]
    for h in hits[1:]:
        condition = condition & h if every else condition | h
    return docs.filter(condition)


def bm25(docs: DataFrame, terms: list[str], key: str = "id", text: str = "text") -> DataFrame:
    """(key, score): BM25 of the documents that hold any term; larger is better.

    Only counts of the query's terms leave a document, so no posting is shuffled; texts are read and split once, into
    a table of those counts.
    """
    words = docs.select(key, T.tokens(F.col(text)).alias("ws"))
    tf = lambda t: (F.size("ws") - F.size(F.array_remove("ws", t))).cast("double")
    counted = materialise(words.select(key, F.size("ws").cast("double").alias("dl"), *(tf(t).alias(f"tf{i}") for i, t in enumerate(terms))), "counted")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        f = F.col(f"tf{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    any_hit = F.greatest(*(F.col(f"tf{i}") for i in range(len(terms))), F.lit(0.0)) > 0
    return counted.join(F.broadcast(stats)).filter(any_hit).select(key, score.alias("score"))  # stats is one row


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the k most similar vectors; ties by key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, V.cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def ranked(df: DataFrame, order: list[Column], limit: int, factor: str, key: str = "id") -> DataFrame:
    """(factor, id, rn): the first ``limit`` rows, numbered from one; ties by key.

    The cut comes first, as a top-k that every task makes on its own; numbering sees ``limit`` rows.
    """
    top = df.orderBy(*order, key).limit(limit)
    return top.select(F.lit(factor).alias("factor"), F.col(key).alias("id"), F.row_number().over(W.orderBy(*order, key)).alias("rn"))


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of ranked lists; absent ids add nothing."""
    both = lists[0]
    for more in lists[1:]:
        both = both.unionByName(more)
    return both.groupBy("id").agg(F.sum(1.0 / (F.col("rn") + k)).alias("score"))


def hybrid(vector: DataFrame, keyword: DataFrame, priors: list[tuple[str, DataFrame, str]], k: int) -> DataFrame:
    """Fusion of vector and keyword scores with query-independent priors, each cut to its first 2k.

    ``vector`` and ``keyword``: (id, score); priors: (name, relation, its score column). Priors put forward
    rows that need not match the query.
    """
    factors = [ranked(vector, [F.desc("score")], 2 * k, "vector"), ranked(keyword, [F.desc("score")], 2 * k, "keyword")]
    factors += [ranked(df, [F.desc_nulls_last(c)], 2 * k, name) for name, df, c in priors]
    return rrf(factors).orderBy(F.desc("score"), "id").limit(k)


def rerank_confidence(scores: DataFrame, group: str, score: str) -> DataFrame:
    """(group, confidence): sigmoid of 0.4 max + 0.3 mean of the best three + 0.3 upper median of a group's scores.

    Places in the group's order pick the rows that count; no group is collected.
    """
    place = scores.filter(F.col(score).isNotNull()).withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score))) - 1).withColumn("n", F.count("*").over(W.partitionBy(group)))
    best = place.groupBy(group).agg(
        F.max(score).alias("top"), F.avg(F.when(F.col("place") < 3, F.col(score))).alias("three"), F.max(F.when(F.col("place") == F.expr("n div 2"), F.col(score))).alias("median")
    )
    return best.select(group, (1 / (1 + F.exp(-(0.4 * F.col("top") + 0.3 * F.col("three") + 0.3 * F.col("median"))))).alias("confidence"))


def rerank(candidates: DataFrame, scorer=None, k: int = 15, most: int = 60) -> DataFrame:
    """The first ``most`` candidates (query, id, rn, text) scored by a vectorised ``scorer(query, text)``, best k.

    Without a scorer the order stays and the score is 1 / (place + 1).
    """
    first = candidates.filter(F.col("rn") <= most)
    scored = first.withColumn("score", scorer(F.col("query"), F.col("text")) if scorer else 1.0 / F.col("rn"))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k)


def tfidf_keywords(docs: DataFrame, top: int, group: str, key: str = "id", text: str = "text") -> DataFrame:
    """(group, term, score, rank): terms of the best mean tf-idf among the documents of each group that hold them.

    A document's words are counted inside its row (sorted, then cut where they change), so one shuffle of partial sums
    by (group, term) is all.
    """
    words = docs.select(group, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(T.IDENTIFIER), F.lit(0)).alias("ws"))
    # Stop-words go by a hash set, once per word.
    words = words.select(group, F.sort_array(F.filter("ws", lambda w: ~w.isin(*sorted(T.STOP_WORDS)))).alias("ws")).filter(F.size("ws") > 0)
    cut = words.select(group, "ws", F.size("ws").alias("n"), F.expr("filter(sequence(0, size(ws) - 1), i -> i = 0 or ws[i] <> ws[i - 1])").alias("at"))
    terms = cut.select(group, "n", F.explode(F.expr("transform(at, (i, k) -> struct(ws[i] AS term, coalesce(get(at, k + 1), n) - i AS c))")).alias("x"))
    held = terms.groupBy(group, "x.term").agg(F.sum(F.col("x.c") / F.col("n")).alias("share"), F.count("*").alias("df"))
    sizes = docs.groupBy(group).agg(F.count("*").alias("n"))
    score = F.round(F.col("share") / F.col("df") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1), 9)
    scored = held.join(sizes, group).select(group, "term", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), "term"))).filter(F.col("rank") <= top)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hashed_embedding(text: Column, dim: int = 384) -> Column:
    """A normalised bag of hashed tokens: the offline stand-in for a model's embedding; empty text is zero.

    One entry for each slot beside the tokens' own makes every slot occur: in sorted order a slot's run, less one, is
    its count.
    """
    slots = F.transform(T.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    every = F.sort_array(F.concat(slots, F.sequence(F.lit(0), F.lit(dim - 1))))
    ends = bound(every, lambda e: F.filter(F.transform(e, lambda x, i: F.when(F.coalesce(F.get(e, i + 1), F.lit(-1)) != x, i)), lambda i: i.isNotNull()))
    counts = bound(ends, lambda e: F.transform(e, lambda x, k: (x - F.coalesce(F.get(e, k - 1), F.lit(-1)) - 1).cast("double")))
    return bound(counts, lambda c: bound(F.greatest(V.norm(c), F.lit(1e-12)), lambda n: F.transform(c, lambda x: (x / n).cast("float"))))
