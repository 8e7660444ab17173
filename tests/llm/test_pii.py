"""PII spans against a plain Python version of the contract."""

import hashlib
import re

import pytest

from skein.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return sorted(out)


TEXTS = [
    None, "", "   ", "a@b.c", "x a@b.c_d@e.f.g, a@b.c@d.e", "mail me: jo.e+1%x@a-b.example.com.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "12345.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (30) 123-4567-89 tel", "+1", "++1 234 567 89 01 +", "é🙂 a@b.c ü 10.0.0.1\n+33 1 23 45 67 89 01",
    "card 4111111111111111 4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 DE88370400440532013000", "ssn 123-45-6789 but 123-45-6789",
    "1 " * 3000, "9" * 5000, "a" * 5000 + "@", "." * 500 + "@x.y", "1.1.1.1" * 50, "no-reply@x.y" * 20, "+1((((((((((((2 3", "4" * 19, "0" * 14,
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, TEXTS[5], None)]
    return {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string, n_email string")).collect()}


def test_base_spans_equal_brute_force(found):
    for i, text in enumerate(TEXTS):
        want = brute(text)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest()
        assert found[i].base_sha256 == digest, (text[:80], want, found[i].spans)
        counts = [sum(w[3] == k for w in want) for k, _ in BASE]
        assert [found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone] == counts


def test_repeated_row_and_method_spans(found):
    assert found[100].spans == found[5].spans != ""
    iban = found[TEXTS.index("GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 DE88370400440532013000")]
    assert [s for s in iban.spans.split(",") if s.startswith("iban")] == ["iban:0:27", "iban:32:54"]
    ssn = found[TEXTS.index("ssn 123-45-6789 but 123-45-6789")]
    assert ssn.spans.split(",")[0] == "ssn:4:15"


def test_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "to a@b.cc or 10.0.0.1 now", 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, extra int")
    assert [tuple(r) for r in pii.redact(docs).orderBy("doc_id").collect()] == [(1, "to [EMAIL] or [IP] now", 7), (2, None, 8), (3, "clean", 9)]
    assert pii.digest(docs.limit(0)).count() == 0


def test_redact_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.example", 7, 8)], "doc_id long, text string, __spans int, __pii_spans int")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "mail [EMAIL]", 7, 8)]
