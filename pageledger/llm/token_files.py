"""Token-id files with keyed access through a minimal perfect hash.

``write_ids`` sorts documents by key over range partitions; every task encodes its range and writes one shard. A shard is a header, the raw
ids of its documents one after another (2 or 4 bytes each, little-endian) and a directory of keys and lengths. The index has one file for each bucket of
keys: a minimal perfect hash (levels of bit sets; a key sits at the first level where no other key has its place, its slot is the rank of that bit) and
for each slot a fingerprint of the key, the shard, the place and the length. A lookup takes the same few steps whatever the number of keys.

Defined results: null and empty texts hold the end id only. Null keys sort first; they are in the shards, not in the index. Of rows with the same key, ordered by
hash of the text, the index gives the first; the directory has them all. An empty table gives no shard. Other columns do not matter.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pageledger.llm.common import SharedFile, mix, new_folder, open_fs, pieces, split_words, text_column
from pageledger.llm.tokens import Cache, special_pattern, tokenizer
from pageledger.session import materialize

MAGIC = b"PLIDS001"
HEADER, HEADER_SIZE, FOOTER, FOOTER_SIZE = "<8sII", 16, "<QQ8s", 24
GAMMA = 1.5
KEYS_PER_BUCKET = 50_000
DIRECTORY = "shard int, offset long, doc_id long, n_tokens long"


#: Normalizer and pre-tokenizer of a tokenizer whose words may be cut here: it lower-cases, and merges within letters, a digit, or other signs.
CUT_HERE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: Words of these characters have one normal form, and their cuts are those of the pattern above.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
PIECES_KEPT = 200_000


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level model."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


BYTE_LETTERS = byte_letters()


class Encoder:
    """Ids of texts: words between ASCII white space are encoded apart, which this kind of tokenizer (white space dropped, merges within words) allows.

    Where the tokenizer's own rules are those of ``CUT_HERE``, a plain word is cut into its pieces here and only the merges are left to the library; pieces are fewer than
    words. Every other word goes to the library whole.
    """

    def __init__(self, path: str, end_id: int):
        self.encoder, self.end_id = tokenizer(path), end_id
        self.model = self.encoder.model
        self.type = np.dtype("<u2" if self.encoder.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.pieces = Cache(self.word), Cache(self.piece, PIECES_KEPT)
        rules = json.loads(self.encoder.to_str())
        self.cuts = (rules["normalizer"], rules["pre_tokenizer"]) == CUT_HERE and rules["model"]["type"] == "BPE"
        self.added = special_pattern(path)

    def word(self, word: str) -> bytes:
        if self.cuts and PLAIN.fullmatch(word) and not (self.added and self.added.search(word)):
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(word.lower())))
        return self.packed(self.encoder.encode(word, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return self.packed([t.id for t in self.model.tokenize(shown)])

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.type.char}", *ids)

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with their end ids, and the number for each text."""
        words, starts = split_words(texts)
        coded = words.dictionary_encode()
        known = [self.words[w] for w in coded.dictionary.to_pylist()]
        ids = np.frombuffer(b"".join(known), self.type)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.type.itemsize
        at = np.cumsum(sizes) - sizes
        use = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[use] if len(use) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(at[use] - ends[:-1], n) + np.arange(ends[-1])] if len(use) else ids
        per_text = ends[starts]
        return np.insert(out, per_text[1:], self.end_id), np.diff(per_text) + 1


_encoders: dict = {}


def worker_encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


@dataclass
class Written:
    folder: str
    directory: DataFrame
    starts: DataFrame
    buckets: int


def write_shards(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Write the shards and return the directory: a row for each document with its place."""
    order = ["doc_id", "_tie"]
    sorted_docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, file, at = worker_encoder(path, end_id), TaskContext.get().partitionId(), None, 0
        keys, sizes = [], []
        for b in (p for batch in batches for p in pieces([batch])):
            if file is None:
                file = SharedFile(folder, f"shard-{shard:07d}.ids")
                file.write(struct.pack(HEADER, MAGIC, encoder.type.itemsize, 1))
            ids, n = encoder.many(text_column(b))
            file.write(ids.astype(encoder.type).tobytes())
            key = b.column("doc_id").cast(pa.int64())
            keys.append(key)
            sizes.append(n)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), pa.array(before), key, pa.array(n)], names=["shard", "offset", "doc_id", "n_tokens"])
        if file is not None:
            all_keys, all_sizes = pa.concat_arrays(keys), np.concatenate(sizes).astype("<u8")
            file.write(all_keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            file.write(all_keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
            file.write(all_sizes.tobytes())
            file.write(struct.pack(FOOTER, at, len(all_sizes), MAGIC))
            file.close()

    return materialize(sorted_docs.select("doc_id", "text").mapInArrow(run, DIRECTORY))


def level_places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys * np.uint64(2 * level + 1) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x165667B19E3779F9)) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit sets of the levels for distinct 64-bit keys."""
    levels = []
    while len(keys):
        size = max(8, int(GAMMA * len(keys)))
        at = level_places(keys, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
    return levels


def slots_of(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of each key, -1 for a key that no level has."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        at = level_places(keys[left], k, len(bits))
        hit = bits[at]
        out[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        left, base = left[~hit], base + int(bits.sum())
    return out


ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets))


def write_index(directory: DataFrame, folder: str) -> int:
    """Write one index file for each bucket of keys; returns the number of buckets."""
    first = directory.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("shard", "offset", "n_tokens")).alias("p")).select("doc_id", "p.*")
    buckets = max(1, -(-directory.count() // KEYS_PER_BUCKET))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, keys = int(pdf.bucket.iloc[0]), pdf.doc_id.to_numpy(np.int64).view(np.uint64)
        levels = build_hash(keys)
        slot = slots_of(keys, levels)
        entries = np.zeros(len(keys), ENTRY)
        for name, values in (("print", fingerprints(keys)), ("shard", pdf.shard), ("offset", pdf.offset), ("n", pdf.n_tokens)):
            entries[name][slot] = values
        file = SharedFile(folder, f"index-{bucket:07d}.mph")
        file.write(struct.pack(f"<II{len(levels)}Q", len(keys), len(levels), *map(len, levels)))
        for bits in levels:
            file.write(np.packbits(bits, bitorder="little").tobytes())
        file.write(entries.tobytes())
        file.close()
        return pd.DataFrame({"bucket": [bucket], "keys": [len(keys)]})

    first.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(build, "bucket long, keys long").agg(F.sum("keys")).collect()
    return buckets


def read_index(folder: str, bucket: int) -> tuple[list[np.ndarray], np.ndarray]:
    fs, path = open_fs(folder)
    with fs.open_input_stream(f"{path}/index-{bucket:07d}.mph") as f:
        data = f.read()
    n, count = struct.unpack_from("<II", data)
    sizes, at, levels = struct.unpack_from(f"<{count}Q", data, 8), 8 + 8 * count, []
    for size in sizes:
        step = -(-size // 8)
        levels.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=size, bitorder="little").astype(bool))
        at += step
    return levels, np.frombuffer(data, ENTRY, n, at)


def write_ids(docs: DataFrame, path: str, end_id: int) -> Written:
    """Write shards and index for ``docs(doc_id, text)`` into a new folder below the shared one."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    directory = write_shards(docs, path, end_id, folder)
    totals = directory.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return Written(folder, directory, materialize(starts), write_index(directory, folder))


def lookup(keys: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Add ``k_shard, k_offset, k_n`` to rows of ``doc_id, shard, offset``: the index entry of each key, null if the index has no such key."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf.doc_id.to_numpy(np.int64).view(np.uint64)
        levels, entries = read_index(folder, int(pdf.bucket.iloc[0]))
        slot = slots_of(key, levels)
        found = slot >= 0
        found[found] = entries["print"][slot[found]] == fingerprints(key[found])
        e = entries[np.where(found, slot, 0)]
        out = pdf.drop(columns="bucket")
        for name, column in (("shard", "k_shard"), ("offset", "k_offset"), ("n", "k_n")):
            out[column] = pd.array(e[name].astype(np.int64), "Int64")
            out.loc[~found, column] = pd.NA
        return out

    schema = ", ".join(f"{n} {t}" for n, t in keys.dtypes) + ", k_shard long, k_offset long, k_n long"
    return keys.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(find, schema)


def read_directory(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Rows of the shards' own directories, read from the files: ``shard, offset, doc_id, n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for b in batches:
            for shard in b.column(0).to_pylist():
                with fs.open_input_file(f"{path}/shard-{shard:07d}.ids") as f:
                    size = f.size()
                    total, n, magic = struct.unpack(FOOTER, f.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
                    if magic != MAGIC:
                        raise ValueError(f"shard {shard} is not complete")
                    data = f.read_at(17 * n, size - FOOTER_SIZE - 17 * n)
                keys, gone, sizes = np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n), np.frombuffer(data, "<u8", n, 9 * n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.cumsum(sizes) - sizes), pa.array(keys, mask=gone.astype(bool)), pa.array(sizes)], names=["shard", "offset", "doc_id", "n_tokens"]
                )

    return shards.select("shard").repartition("shard").mapInArrow(run, DIRECTORY)


def read_ids(written: Written) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    Each key of the shards' directories is looked up in the index, and its ids are read from where the index says. A repeated key's later rows, and rows without a
    key, are read from where the directory says.
    """
    folder, spark = written.folder, written.directory.sparkSession
    rows = read_directory(spark, folder, written.starts)
    keyed = lookup(rows.where("doc_id IS NOT NULL"), folder, written.buckets)
    here = (F.col("k_shard") == F.col("shard")) & (F.col("k_offset") == F.col("offset"))
    repeat = F.struct("k_shard", "k_offset") < F.struct(F.col("shard").cast("long").alias("k_shard"), F.col("offset").alias("k_offset"))
    shard = F.when(here, F.col("k_shard").cast("int")).when(repeat, F.col("shard")).otherwise(F.raise_error(F.lit("a key is not in the index")).cast("int"))
    checked = keyed.select("doc_id", shard.alias("shard"), F.when(here, F.col("k_offset")).otherwise(F.col("offset")).alias("offset"), F.when(here, F.col("k_n")).otherwise(F.col("n_tokens")).alias("n_tokens"))
    located = checked.unionByName(rows.where("doc_id IS NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        now, file, width = None, None, 0
        for b in batches:
            crc = []
            for shard, offset, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "n_tokens"))):
                if shard != now:
                    if file is not None:
                        file.close()
                    now, file = shard, fs.open_input_file(f"{path}/shard-{shard:07d}.ids")
                    width = struct.unpack(HEADER, file.read_at(HEADER_SIZE, 0))[1]
                ids = np.frombuffer(file.read_at(n * width, HEADER_SIZE + offset * width), f"<u{width}")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), b.column("offset"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "shard", "offset", "n_tokens", "ids_crc32"])

    read = located.select("doc_id", "shard", "offset", "n_tokens").repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(run, "doc_id long, shard int, offset long, n_tokens long, ids_crc32 long")
    return read.join(written.starts, "shard").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
