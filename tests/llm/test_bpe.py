import random

import pytest
from tokenizers import Tokenizer

from skein.llm import bpe

TEXTS = [
    None, "", "  \n", "Hello world! it's Don'T", "<|endoftext|> a<|startoftext|>b<|endoftext|", "ΣΟΦΟΣ Σ", "a\x1cb\x85c​d", "é É ﬁ ½ ² 123", "a" * 300, "日本語テキスト 🙂🙂", "İstanbul ß ẞ",
    "a\x00b", "!!!???...", "ab " * 5000, "don't we'll they've I'd", "x9y8z7" * 50,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def random_texts(n):
    rng = random.Random(4)
    pool = "abcdefgz  \n'.,éßñ€漢🙂09" + "́ ſΣς"
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_equals_the_library(library):
    mine = bpe.load(None)
    for text in TEXTS + random_texts(300):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert mine.encode(text) == want, text
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False)


def test_merges_leftmost_lowest_rank_first():
    ranks = {("a", "a"): 0, ("aa", "aa"): 1, ("a", "b"): 2}
    assert bpe.merge_symbols(list("aaaaab"), ranks.get) == ["aaaa", "ab"]

    def plain(symbols):
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
            if not found:
                return symbols
            i = min(found)[1]
            symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2 :]

    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice("ab") for _ in range(rng.randrange(40))]
        assert bpe.merge_symbols(list(s), ranks.get) == plain(s)


def test_documents(spark, library):
    import hashlib

    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.token_digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.encode_documents(docs).filter("doc_id = 3").count() == 2
    assert bpe.token_digests(docs.limit(0)).count() == 0
