"""Properties over generated inputs of the parts that run without Spark."""

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import numpy as np

from skein.llm import bpe, omh, warc
from skein.llm import suffix_dedup as sd


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=120))
def test_suffix_array(data):
    sa, rank = sd.larsson_sadakane(np.frombuffer(data, np.uint8))
    assert list(sa) == sorted(range(len(data)), key=lambda i: data[i:])
    assert all(rank[i] == k for k, i in enumerate(sa))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=90), max_size=8))
def test_least_ids_of_windows(texts):
    segments = [t.encode() for t in texts if len(t) >= sd.LENGTH]
    if not segments:
        return
    count = np.array([len(s) - sd.LENGTH + 1 for s in segments])
    got = sd.least_ids(np.frombuffer(b"".join(segments), np.uint8), count, np.arange(len(segments)), block=100)
    seen = {}
    for i, s in enumerate(segments):
        for k in range(len(s) - sd.LENGTH + 1):
            seen.setdefault(s[k : k + sd.LENGTH], i)
    assert list(got) == [seen[s[k : k + sd.LENGTH]] for s in segments for k in range(len(s) - sd.LENGTH + 1)]


LIBRARY = Tokenizer.from_file(bpe.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.load(None).encode(text) == ids
    assert bpe.load(None).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=50), min_size=1, max_size=6))
def test_seek_table_round_trip(parts):
    packed = [zstandard.ZstdCompressor().compress(p) for p in parts]
    archive = b"".join(packed) + warc.seek_table([(len(c), len(p)) for c, p in zip(packed, parts, strict=True)])
    assert [warc.read_frame(archive, k) for k in range(len(parts))] == parts


words = st.lists(st.integers(1, 4), max_size=25)


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_alignment(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    most = np.array([max(len(a), len(b))])
    assert omh.distances([np.array(a, np.uint64)], [np.array(b, np.uint64)], most)[0] == row[-1]
