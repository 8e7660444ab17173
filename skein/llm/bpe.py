"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

Every word is a row of symbols. Leaf ``i`` of the tree holds the merge rank of the pair that
starts at symbol ``i`` (joined with ``i`` so that the smaller position wins a tie); an inner node
holds the minimum of its children. The root therefore names the leftmost pair of lowest rank. A
merge changes at most three leaves, each update climbs ``log n`` levels, and the loop ends when the
root holds no mergeable pair. Words are encoded once per worker and remembered in a bounded cache,
because a corpus repeats its vocabulary.

Defined results: a null text encodes as the empty text (no ids, empty decoding); texts of any
length are read whole; equal rows give equal results; an empty table gives an empty table; columns
other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank of a pair that cannot merge.
NEVER = 1 << 62
#: Bits of a tree value that hold the position.
POS_BITS = 32
#: Words remembered in each of the two cache generations of a worker.
CACHE_WORDS = 250_000

# The library's tables are those of Unicode 16 for classes and 17 for lower case; the modules used here may be
# older or newer. What follows evens that out.

#: Unicode White_Space, as the tokenizer file's ``\\s`` means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that became letters or numbers after Unicode 16, as ranges.
NEWER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959"
    " 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff"
    " 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de"
    " 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
NEWER_CLASS = "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (x.split("-") for x in NEWER.split()))
#: Capitals whose lower case came after Unicode 15.1, first those of regular blocks.
LATE_LOWER = {chr(c): chr(c + 0x20) for c in range(0x10D50, 0x10D66)} | {chr(c): chr(c + 0x1B) for c in range(0x16EA0, 0x16EB9)}
LATE_LOWER |= {chr(c): chr(c + 1) for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)} | {chr(0xA7CB): chr(0x264), chr(0xA7DC): chr(0x19B)}
#: Lower case goes character by character: a final sigma keeps its plain form.
ONE_BY_ONE = re.compile("[Σ" + "".join(LATE_LOWER) + "]")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable Latin-1, else 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def merge_symbols(symbols: list[str], rank_of) -> list[str]:
    """Apply merges to ``symbols`` until none is left; ``rank_of((a, b))`` gives a rank or None."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        r = rank_of((symbols[i], symbols[i + 1]))
        if r is not None:
            tree[size + i] = (r << POS_BITS) | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    if tree[1] == NEVER:
        return symbols
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    mask = (1 << POS_BITS) - 1

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while tree[1] != NEVER:
        i = tree[1] & mask
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        k = after[j]
        after[i] = k
        if j < n - 1:
            put(j, NEVER)
        if k < n:
            before[k] = i
            r = rank_of((parts[i], parts[k]))
            put(i, NEVER if r is None else (r << POS_BITS) | i)
        else:
            put(i, NEVER)
        h = before[i]
        if h >= 0:
            r = rank_of((parts[h], parts[i]))
            put(h, NEVER if r is None else (r << POS_BITS) | h)
    return [p for p in parts if p is not None]


class WordBpe:
    """A tokenizer read from a ``tokenizers`` JSON file of the kind "BPE with word ends"."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank_of = {tuple(p): r for r, p in enumerate(pairs)}.get
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", SPACE)
        self.words, self.newer = regex.compile(pattern), re.compile(f"[{NEWER_CLASS}]")
        for c in "LN":
            pattern = pattern.replace(rf"\p{{{c}}}", rf"[\p{{{c}}}--[{NEWER_CLASS}]]")
        self.words_with_newer = regex.compile("(?V1)" + pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bytes = byte_alphabet()
        self.limit, self.young, self.old = cache_words, {}, {}

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(LATE_LOWER.get(c) or c.lower() for c in text) if ONE_BY_ONE.search(text) else text.lower()

    def split(self, piece: str) -> list[str]:
        """Normalised pre-tokens of a text without special tokens."""
        try:
            piece.encode("latin-1")  # such texts are composed already and hold none of the special cases
            return self.words.findall(piece.lower())
        except UnicodeEncodeError:
            piece = self.normalise(piece)
            return (self.words_with_newer if self.newer.search(piece) else self.words).findall(piece)

    def encode_word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, tokens joined by spaces) of one pre-token."""
        symbols = [self.bytes[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        tokens = [t for t in merge_symbols(symbols, self.rank_of) if t in self.vocab]
        return len(tokens), " ".join(str(self.vocab[t]) for t in tokens), " ".join(tokens)

    def _missing(self, word: str) -> tuple[int, str, str]:
        got = self.old.get(word) or self.encode_word(word)
        if len(word) <= 64:
            if len(self.young) >= self.limit:
                self.young, self.old = {}, self.young
            self.young[word] = got
        return got

    def encode_parts(self, text: str) -> list[tuple[int, str, str]]:
        out: list[tuple[int, str, str]] = []
        pieces = self.cut.split(text) if "<|" in text else (text,)
        for piece in pieces:
            if piece in self.special:
                out.append((1, str(self.special[piece]), piece))
                continue
            for w in self.split(piece):
                out.append(self.young.get(w) or self._missing(w))
        return [p for p in out if p[0]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.encode_parts(text or "") for i in p[1].split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, tokens are joined by one space; unknown ids vanish."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def load(path: str | None) -> WordBpe:
    """One tokenizer per worker and path, so its word cache outlives a task."""
    return WordBpe(path or default_path())


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string): the tokens of each whole text and their decoding."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):  # ids as Python integers weigh ten times their text
                batch = whole.slice(at, 128)
                ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["key", "ids", "decoded"]
                )

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {key_type}, ids array<int>, decoded string").withColumnRenamed("key", key)


def token_digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text, by the same encoder.

    The id and token strings of a word come joined from the cache; only digests leave the worker.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = hashlib.sha256
        for batch in batches:
            n, ids, decoded = [], [], []
            for value in batch.column(1):
                parts = bpe.encode_parts(value.as_py() or "")
                n.append(sum([p[0] for p in parts]))
                ids.append(sha(" ".join([p[1] for p in parts]).encode()).hexdigest())
                decoded.append(sha(" ".join([p[2] for p in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
