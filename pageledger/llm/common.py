"""Helpers shared by the corpus operators: words as Arrow and numpy arrays, stored stages, table names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageledger.session import shared_dir

#: The six white-space characters that end a word, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_array(c: Column) -> Column:
    """Words of a text, an empty array for null."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 4096, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds some MB of text; a single longer text makes a piece alone."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = min(max(at + 1, int(np.searchsorted(sizes, before + limit, "right"))), at + rows)
            yield batch.slice(at, end - at)
            at = end


def text_column(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words start (one more entry than texts)."""
    parts = pc.ascii_split_whitespace(texts)
    flat, owner = parts.flatten(), pc.list_parent_indices(parts)
    full = pc.not_equal(flat, "")
    flat, owner = flat.filter(full), owner.filter(full).to_numpy(zero_copy_only=False)
    return flat, np.searchsorted(owner, np.arange(len(texts) + 1))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each distinct word of the array is hashed once."""
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n words over a whole array (runs across texts included; the caller leaves them out)."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix(out * M1 + words[k : k + m] + M3)
    return out


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path behind a folder's address, for tasks that write or read binary files in the shared folder."""
    return pafs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share."""
    uri = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = open_fs(uri)
    fs.create_dir(path)
    return uri


class SharedFile:
    """A binary file that appears under its name only when complete: a task that is run twice replaces it by the same bytes."""

    def __init__(self, folder: str, name: str):
        self.fs, path = open_fs(folder)
        self.name = f"{path}/{name}"
        self.draft = f"{path}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.name)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def has_repeats(docs: DataFrame) -> bool:
    """Whether some doc_id stands in more than one row."""
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
