"""Token counts: a broadcast table of frequent pre-token lengths, and worker caches for the rest.

A byte-level BPE never merges across a blank, so the tokens of a text are the sum over its pre-tokens, here runs without white space together with
the blank before them. A few frequent pre-tokens make up most of any text: their lengths travel to every worker in one compact broadcast of bounded
size. The others are encoded by the tokenizer in the worker that meets them and kept in a cache of bounded size. No pre-token is ever shuffled.
Each piece of some MB of text is split and counted by distinct pre-token in Arrow, so Python sees each distinct one once a piece.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results; other columns of the input do not
matter. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from pageledger.llm.common import pieces, text_column

#: At most so many pre-tokens of at most so many characters are broadcast: under 4 MB whatever the input.
TABLE_SIZE, TABLE_CHARS = 60_000, 24
#: Rows of the sample that proposes frequent pre-tokens. It decides speed only; any table gives the same counts.
SAMPLE_ROWS = 2_000
#: Entries of each half of a worker's cache; longer pre-tokens are encoded each time.
CACHE_SIZE, CACHE_CHARS = 500_000, 64

SPLIT = regex.compile(public_tokenizers.PATTERN)
#: Outside these ranges Unicode versions of this pattern and of the tokenizer's may differ: such texts are encoded whole.
ODD = re.compile("[^\x00-ԯ‐-⁞ぁ-ゖァ-ヺ一-龥가-힣]")
#: Texts with longer runs of white space, or others than blanks and line feeds, are split by the full pattern.
UNEVEN = r"[ \n][ \n]|^[ \n]|[ \n]\z|[\t\r\x0b\x0c\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(4)
def special_pattern(path: str) -> re.Pattern | None:
    """Added tokens, which the library finds inside texts before it splits them."""
    with open(path, encoding="utf-8") as f:
        names = sorted((t["content"] for t in json.load(f)["added_tokens"]), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


class Cache(dict):
    """What ``make`` gives for a key, kept in two halves of bounded size: when one is full it replaces the older."""

    def __init__(self, make: Callable, size: int = CACHE_SIZE, chars: int = CACHE_CHARS, frequent: dict | None = None):
        super().__init__()
        self.make, self.size, self.chars, self.older, self.frequent = make, size, chars, {}, frequent or {}

    def __missing__(self, key: str):
        value = self.frequent.get(key)
        if value is not None:
            return value
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.chars:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def split_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of even texts, and for each the number of its text; a line's first has no blank before it, the others have."""
    parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01"), "\x01")
    return parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)


class TokenCounter:
    """Counts the tokens of texts."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.encoder, self.special = tokenizer(path), special_pattern(path)
        self.uneven = UNEVEN + (f"|{self.special.pattern}" if self.special else "")
        self.lengths = Cache(self.encode, frequent=frequent)

    def encode(self, piece: str) -> int:
        return len(self.encoder.encode(piece, add_special_tokens=False).ids)

    def one(self, text: str) -> int:
        if ODD.search(text):
            return self.encode(text)
        parts = self.special.split(text) if self.special else [text]
        return len(parts) // 2 + sum(sum(map(self.lengths.__getitem__, SPLIT.findall(p))) for p in parts[::2])

    def many(self, texts: list[str]) -> np.ndarray:
        array = pa.array(texts, pa.large_string())
        even = pc.invert(pc.match_substring_regex(array, self.uneven))
        units, owner = split_units(pc.if_else(even, array, ""))
        coded = units.dictionary_encode()
        own = np.fromiter(map(self.lengths.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        n = np.bincount(owner, own[coded.indices.to_numpy(zero_copy_only=False)], len(texts)).astype(np.int64)
        newline = self.lengths["\n"]
        return np.array([k + newline * t.count("\n") if e else self.one(t) for t, e, k in zip(texts, even.to_pylist(), n)], np.int64)


def pack_table(words: list[str], path: str) -> tuple[bytes, bytes]:
    """Frequent pre-tokens as one byte string, and a byte of length for each; only those up to 255 tokens fit."""
    sizes = [len(e.ids) for e in tokenizer(path).encode_batch(words, add_special_tokens=False)]
    kept = [(w, n) for w, n in zip(words, sizes) if 0 < n < 256 and "\0" not in w]
    return "\0".join(w for w, _ in kept).encode(), bytes(n for _, n in kept)


def unpack_table(packed: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(packed[0].decode().split("\0"), packed[1])) if packed[1] else {}


def frequent_pretokens(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The most frequent pre-tokens of a bounded sample of rows."""
    part = docs.select("text").sample(fraction=min(1.0, 1.2 * sample_rows / max(docs.count(), 1)), seed=7)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for b in pieces(batches):
            own.update({w: n for w, n in map(lambda x: x.values(), pc.value_counts(split_units(text_column(b))[0]).to_pylist()) if n > 1 and len(w) <= TABLE_CHARS})
        top = own.most_common(TABLE_SIZE // 4)
        yield pa.RecordBatch.from_pydict({"piece": [w for w, _ in top], "n": [c for _, c in top]}, pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    best = part.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE_SIZE)
    return [r.piece for r in best.collect()]


def token_counts(docs: DataFrame, path: str, limit: int = 512, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``."""
    packed = docs.sparkSession.sparkContext.broadcast(pack_table(frequent_pretokens(docs, sample_rows), path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(packed, path)
        for b in pieces(batches):
            texts = text_column(b)
            n = counter.many(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


_counters: dict = {}


def worker_counter(packed, path: str) -> TokenCounter:
    """One counter for a worker process and table, so that its cache outlives a task."""
    key = (zlib.crc32(packed.value[0]), path)
    if key not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(path, unpack_table(packed.value))
    return _counters[key]
