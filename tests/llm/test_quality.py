"""Counts against plain Python; cutoffs against an exact binomial computed with fractions."""

import re
from fractions import Fraction
from math import comb

from skein.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e f g h", "a b c d e f g h i a b c d e f g h", "x " * 40, "é#ü |<> & 🙂 * $%", "l1\nl1\n\n \nl2\nl1\r\nl1\r\n", "a b c d e f g h i j " * 30,
    " ".join(f"w{i % 37}" for i in range(400)), " ".join(f"w{i}" for i in range(5000)), "a\x0bb\x0cc\x1cd",
]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], None)], "doc_id long, text string, words string")
    rows = quality.counts(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.key]), TEXTS[r.key]


def test_binomial_tail(spark):
    for n, k, p in ((50, 3, 0.1), (900, 0 + 1, 0.01), (2000, 9, 0.01)):
        got = spark.range(1).selectExpr(quality.binomial_tail(f"{n}", f"{k}", p)).first()[0]
        q = Fraction(str(p))
        want = float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
        assert abs(got - want) < 1e-9 * want


def test_certified_cutoffs_reject_junk_and_keep_good(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en") for i in range(1500)]
    bad = [(10_000 + i, " ".join(f"w{i}x{j}**" for j in range(40)), "en") for i in range(100)]
    few = [(20_000 + i, " ".join(f"w{i}x{j}**" for j in range(40)), None) for i in range(3)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(None, 1), (10_000, 1)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in bad)
    assert all(kept[i] for i, *_ in few)  # a stratum without labels has no cutoffs
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0
    assert all(r.kept for r in quality.judge(docs.filter("doc_id < 10"), labels.limit(0)).collect())
