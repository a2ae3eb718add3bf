"""Language-model scores by a hierarchical Pitman-Yor model of two levels, its seating sampled by Gibbs.

* Every word that comes before another one in training has a context restaurant. All share one parent, the root restaurant, whose base is uniform; one customer for
  each table of a context restaurant sits in the root.
* A sweep draws, for every word of every restaurant, the number of tables of its customers from the conditional distribution given the rest (their seating is
  integrated out by generalised Stirling numbers), then the root's. Words are dealt to buckets; the totals of a restaurant are those of the sweep before, as in
  distributed Gibbs samplers. Totals of the restaurants of frequent words (at least ``SHARE`` of the training tokens, so at most 1 / SHARE of them) pass the driver. Those
  of all others are summed in each sweep by the bucket of the context, which sends them to the buckets that hold pairs of it.
* A word's score is its predictive probability averaged over the sampled seatings.

Texts are tokenised once, into chunks of some MB that stay in the shared folder. A chunk sends its distinct words and pairs to the buckets and gets back
their counts and probabilities. Words are known by 64-bit hashes. A pair goes to the bucket of its word, if that is frequent to the bucket of its context, and if both are
to that of the pair, so no bucket holds more than its part.

Defined results: null and empty texts have the end token only. Rows without doc_id are training rows (crc32 of nothing). Repeated rows are learnt and scored each by
itself. An empty table gives an empty table. Other columns do not matter.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageledger.llm.common import SharedFile, mix, new_folder, open_fs, pieces, split_words, text_column, word_hashes
from pageledger.session import materialize

#: Least share of the training tokens of a word whose totals are sent to all; the totals of others are exchanged between buckets.
SHARE = 1 / 20_000
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 20 << 20
#: Stirling numbers are exact up to so many customers of a word; later customers are seated one block after another, each as large as all before.
EXACT_CUSTOMERS = 128
END = xxhash.xxh3_64_intdigest(b"")


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))  # noqa: S301  written by this module only


def save(folder: str, name: str, *arrays) -> None:
    f = SharedFile(folder, name)
    f.write(pack(*arrays))
    f.close()


def load(folder: str, name: str) -> tuple:
    fs, path = open_fs(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return unpack(f.read())


# ---------------------------------------------------------------- seating


@lru_cache(8)
def log_stirling(discount: float, most: int = EXACT_CUSTOMERS) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: ways, by weight, to seat c customers of a word at t tables."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = s[c] + np.log(np.maximum(c - discount * t, 0))
        s[c + 1] = np.logaddexp(np.where(np.isnan(stay), -np.inf, stay), np.concatenate([[-np.inf], s[c][:-1]]))
    return s


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each word given its customers and the weight of a new table: p(t) in proportion to ``weight ** t`` times the Stirling number."""
    out = np.minimum(customers, 1).astype(np.int64)
    many = np.flatnonzero(customers > 1)
    if not len(many):
        return out
    stirling, head = log_stirling(discount), np.minimum(customers[many], EXACT_CUSTOMERS)
    order = np.argsort(head, kind="stable")
    many, head = many[order], head[order]
    for c, a, b in zip(*np.unique(head, return_index=True), np.append(np.unique(head, return_index=True)[1][1:], len(head))):
        for at in range(a, b, max(1, (1 << 20) // int(c))):
            part = many[at : min(b, at + max(1, (1 << 20) // int(c)))]
            t = np.arange(1, c + 1)
            score = stirling[c, 1 : c + 1] + t * np.log(weight[part])[:, None]
            score = np.exp(score - score.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[part] = 1 + (score < rng.random(len(part))[:, None] * score[:, -1:]).sum(axis=1)
    rest = np.flatnonzero(customers > EXACT_CUSTOMERS)
    seated = np.full(len(rest), EXACT_CUSTOMERS, np.int64)
    while len(rest):
        block = np.minimum(seated, customers[rest] - seated)
        new = weight[rest] / (weight[rest] + seated + block / 2 - discount * out[rest])
        out[rest] += rng.binomial(block, np.clip(new, 0, 1))
        seated += block
        left = seated < customers[rest]
        rest, seated = rest[left], seated[left]
    return out


# ---------------------------------------------------------------- chunks


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def chunk_of(batch: pa.RecordBatch) -> tuple:
    """Sorted distinct word hashes, tokens as places in them, place of each text's first token, doc_ids, held-out flags."""
    words, starts = split_words(pc.ascii_lower(text_column(batch)))
    hashed = np.insert(word_hashes(words), starts[1:], np.uint64(END))
    vocabulary, tokens = np.unique(hashed, return_inverse=True)
    keys = batch.column("doc_id").to_pylist()
    return vocabulary, tokens.astype(np.uint32), starts + np.arange(len(starts)), keys, np.array([is_held_out(k) for k in keys], bool)


def bucket_slices(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def write_chunks(docs: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Write the chunks; rows of ``bucket, chunk, data``: each chunk's training words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task, number, size = TaskContext.get().partitionId(), 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            vocabulary, tokens, starts, keys, out = chunk_of(joined)
            chunk = (task << 24) | number
            save(folder, f"chunk-{chunk}", vocabulary, tokens, starts, keys, out)
            counts = np.bincount(tokens[~np.repeat(out, np.diff(starts))], minlength=len(vocabulary))
            parts = dict(bucket_slices((vocabulary % np.uint64(buckets)).astype(np.int64), buckets))
            parts.setdefault(chunk % buckets, np.zeros(0, np.int64))  # this bucket lists the chunk
            rows = [(b, chunk, pack(vocabulary[at], counts[at].astype(np.uint32))) for b, at in parts.items()]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pydict({"bucket": [r[0] for r in rows], "chunk": [r[1] for r in rows], "data": pa.array([r[2] for r in rows], pa.binary())})

        for b in (p for batch in batches for p in pieces([batch], limit=CHUNK_BYTES // 4)):
            held.append(b)
            size += pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
            if size >= CHUNK_BYTES:
                yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, chunk long, data binary")


def entries(vocabulary: np.ndarray, tokens: np.ndarray, starts: np.ndarray, out: np.ndarray, frequent: np.ndarray, buckets: int) -> tuple:
    """Distinct pairs of a chunk by bucket, and where each token finds its pair.

    Gives the number of each word among the frequent ones (-1: rare), the place of each token's pair, and for the distinct pairs: word, context, training count
    and bucket. A context is a frequent word's number, or the number of these and a place among the chunk's words.
    """
    contexts = max(len(frequent), 1)
    at = np.minimum(np.searchsorted(frequent, vocabulary), contexts - 1)
    number = np.where(frequent[at] == vocabulary, at, -1) if len(frequent) else np.full(len(vocabulary), -1)
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = np.searchsorted(vocabulary, np.uint64(END))
    train = ~np.repeat(out, np.diff(starts))
    rank, width = np.where(number >= 0, number, contexts + np.arange(len(vocabulary))), contexts + len(vocabulary)
    codes, pair = np.unique(tokens.astype(np.int64) * width + rank[before], return_inverse=True)
    word, ctx = codes // width, codes % width
    count = np.bincount(pair, train, len(codes)).astype(np.int64)
    key = np.where(
        number[word] < 0, vocabulary[word], np.where(ctx < contexts, mix(vocabulary[word] ^ mix(ctx.astype(np.uint64) + np.uint64(1))), vocabulary[np.maximum(ctx - contexts, 0)])
    )
    return number, pair, word, ctx, count, (key % np.uint64(buckets)).astype(np.int64)


def send_pairs(ids: DataFrame, folder: str, frequent, buckets: int) -> DataFrame:
    """Rows of ``bucket, chunk, data``: a chunk's rare words and rare contexts, and its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in (c for b in batches for c in b.column(0).to_pylist()):
            vocabulary, tokens, starts, _, out = load(folder, f"chunk-{chunk}")
            number, _, word, ctx, count, pair_bucket = entries(vocabulary, tokens, starts, out, frequent.value, buckets)
            rare = np.flatnonzero(number < 0)
            rare_of = dict(bucket_slices((vocabulary[rare] % np.uint64(buckets)).astype(np.int64), buckets))
            pairs_of = dict(bucket_slices(pair_bucket, buckets))
            rows = []
            none, contexts = np.zeros(0, np.int64), max(len(frequent.value), 1)
            for b in sorted({*rare_of, *pairs_of}):
                own, at = rare[rare_of.get(b, none)], pairs_of.get(b, none)
                is_rare = number[word[at]] < 0
                others = np.unique(ctx[at][ctx[at] >= contexts])
                short = np.where(ctx[at] < contexts, ctx[at], contexts + np.searchsorted(others, ctx[at])).astype(np.uint32)
                r, f = at[is_rare], at[~is_rare]
                rows.append(pack(
                    vocabulary[own], vocabulary[others - contexts], np.searchsorted(own, word[r]).astype(np.uint32), short[is_rare], count[r].astype(np.uint32), number[word[f]].astype(np.uint32),
                    short[~is_rare], count[f].astype(np.uint32),
                ))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(sorted({*rare_of, *pairs_of}), pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "data": pa.array(rows, pa.binary())})

    return ids.mapInArrow(run, "bucket long, chunk long, data binary")


# ---------------------------------------------------------------- buckets

#: Rows with totals for the driver, and rows from one bucket (``origin``) to the bucket of rare contexts.
TOTALS = "bucket long, origin long, data binary, totals array<array<long>>, n array<long>"
REPLIES = "bucket long, home long, data binary"


def with_parts(bucket: int, totals: list, n: list[int], others: np.ndarray, buckets: int, *values: np.ndarray) -> pd.DataFrame:
    """Rows of ``TOTALS``: the bucket's totals, and for each bucket of its rare contexts their values; itself gets a row in any case, so that it gets a reply."""
    parts = dict(bucket_slices((others % np.uint64(buckets)).astype(np.int64), buckets))
    parts.setdefault(bucket, np.zeros(0, np.int64))
    rows = [(b, bucket, pack(*(v[at] for v in values)), None, None) for b, at in parts.items()]
    return pd.DataFrame([(bucket, bucket, None, [np.asarray(t).astype(np.int64).tolist() for t in totals], n), *rows], columns=["bucket", "origin", "data", "totals", "n"])


def first_replies(folder: str):
    """The bucket of rare contexts sums their customers and tables over all buckets, and remembers who holds which."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d) for d in pdf.data]
        known, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        customers, tables = (np.bincount(place, np.concatenate([p[k] for p in parts]), len(known)).astype(np.int64) for k in (1, 2))
        holders = dict(zip(pdf.origin.tolist(), np.split(place.astype(np.uint32), np.cumsum([len(p[0]) for p in parts])[:-1])))
        home = int(pdf.bucket.iloc[0])
        save(folder, f"home-{home}", len(known), holders)
        return pd.DataFrame([(origin, home, pack(customers[at], tables[at])) for origin, at in holders.items()], columns=["bucket", "home", "data"])

    return run


def later_replies(folder: str):
    """The same with the tables of a sweep."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home = int(pdf.bucket.iloc[0])
        known, holders = load(folder, f"home-{home}")
        tables = np.zeros(known, np.int64)
        for origin, data in zip(pdf.origin, pdf.data):
            tables += np.bincount(holders[origin], unpack(data)[0], known).astype(np.int64)
        return pd.DataFrame([(origin, home, pack(tables[at])) for origin, at in holders.items()], columns=["bucket", "home", "data"])

    return run


def received(pdf: pd.DataFrame, others: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The values of a bucket's rare contexts, from the replies."""
    parts = dict(bucket_slices((others % np.uint64(buckets)).astype(np.int64), buckets))
    replies = {h: unpack(d) for h, d in zip(pdf.home, pdf.data)}
    out = [np.zeros(len(others), np.int64) for _ in next(iter(replies.values()))]
    for home, at in parts.items():
        for o, v in zip(out, replies[home]):
            o[at] = v
    return out


def merge_words(folder: str, buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d) for d in pdf.data]
        words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        bucket = int(pdf.bucket.iloc[0])
        save(folder, f"words-{bucket}", words, counts)
        own = [int(c) for c in pdf.chunk if c % buckets == bucket]
        return pd.DataFrame({"bucket": [bucket], "types": [int((counts > 0).sum())], "tokens": [int(counts.sum())], "chunks": [own]})

    return run


def merge_pairs(folder: str, contexts: int, buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, chunks = int(pdf.bucket.iloc[0]), pdf.chunk.tolist()
        parts = [unpack(d) for d in pdf.data]
        words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        others, other_place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        ends, other_ends = np.cumsum([0] + [len(p[0]) for p in parts]), np.cumsum([0] + [len(p[1]) for p in parts])
        width = contexts + len(others)
        # contexts: numbers of frequent words, then places among the bucket's rare contexts
        full = lambda at, c: np.append(np.arange(contexts), contexts + other_place[at : at + max(int(c.max(initial=0)) - contexts + 1, 0)])[c]
        rare, rare_at = np.unique(np.concatenate([place[a:][p[2]] * width + full(o, p[3]) for a, o, p in zip(ends, other_ends, parts)]), return_inverse=True)
        rare_n = np.bincount(rare_at, np.concatenate([p[4] for p in parts]), len(rare)).astype(np.int64)
        often, often_at = np.unique(np.concatenate([p[5].astype(np.int64) * width + full(o, p[6]) for o, p in zip(other_ends, parts)]), return_inverse=True)
        often_n = np.bincount(often_at, np.concatenate([p[7] for p in parts]), len(often)).astype(np.int64)
        save(folder, f"pairs-{bucket}", words, others, rare // width, rare % width, rare_n, often // width, often % width, often_n)
        # what each chunk asked, in its order, as differences of rising places
        cut = lambda at, k: np.split(at, np.cumsum([len(p[k]) for p in parts])[:-1])
        asked = [tuple(np.diff(x, prepend=0).astype(np.int32) for x in three) for three in zip(cut(place, 0), cut(rare_at, 2), cut(often_at, 5))]
        save(folder, f"asked-{bucket}", chunks, asked)
        n, u, w = np.concatenate([rare_n, often_n]), np.concatenate([rare % width, often % width]), often // width
        customers, tables = np.bincount(u, n, width), np.bincount(u[n > 0], minlength=width)
        totals = [customers[:contexts], tables[:contexts], np.bincount(w[often_n > 0], minlength=contexts)]
        root = np.bincount(rare // width, rare_n > 0, len(words)).astype(np.int64)
        few = [int((n == 1).sum()), int((n == 2).sum()), int((root == 1).sum()), int((root == 2).sum()), int(root.sum()), int((root > 0).sum())]
        return with_parts(bucket, totals, few, others, buckets, others, customers[contexts:].astype(np.int64), tables[contexts:])

    return run


def summed(rows: DataFrame, contexts: int) -> tuple[np.ndarray, list[int]]:
    """Sums over all buckets of their vectors (a row for each restaurant) and numbers."""
    rows = rows.where("totals IS NOT NULL").select("totals", "n")
    spots = rows.select(F.posexplode("totals").alias("k", "v")).select("k", F.posexplode("v").alias("i", "x")).where("x <> 0").groupBy("k", "i").agg(F.sum("x").alias("x"))
    numbers = rows.select(F.posexplode("n").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros((3, contexts), np.int64)
    for r in spots.collect():  # at most 1 / SHARE for each vector
        out[r.k, r.i] = r.x
    return out, [r.x for r in numbers.orderBy("i").collect()]


class Seating:
    """What a sweep knows of the whole: totals by frequent word's restaurant, the frequent words' places in the root, the root's totals."""

    def __init__(self, customers, tables, often_root, often_tables, root_customers, root_tables, types, discount, root_discount):
        self.customers, self.tables, self.often_root, self.often_tables = customers, tables, often_root, often_tables
        self.root_customers, self.root_tables, self.types, self.discount, self.root_discount = root_customers, root_tables, types, discount, root_discount

    def new_root_table(self) -> float:
        """Weight of a new table for any word in the root."""
        return (STRENGTH + self.root_discount * self.root_tables) / (self.types + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.root_discount * tables + self.new_root_table()) / (STRENGTH + self.root_customers)

    def predictive(self, customers: np.ndarray, tables: np.ndarray, all_customers: np.ndarray, all_tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        mass = STRENGTH + all_customers
        return (customers - self.discount * tables) / mass + (STRENGTH + self.discount * all_tables) / mass * parent


def sweep(folder: str, step: int, state, contexts: int, buckets: int):
    """Draw the tables of all pairs and rare words of a bucket, given the totals of its rare contexts; stores them and gives the totals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf.bucket.iloc[0])
        s: Seating = state.value
        rng = np.random.default_rng([step, bucket])
        words, others, rw, ru, rn, fw, fu, fn = load(folder, f"pairs-{bucket}")
        *customers, other_tables = received(pdf, others, buckets)
        if step:
            root, tables, _, _ = load(folder, f"tables-{step - 1}-{bucket}")
            save(folder, f"context-{step - 1}-{bucket}", other_tables)
        else:
            root = np.bincount(rw, rn > 0, len(words)).astype(np.int64)
            tables = np.minimum(root, 1)
            save(folder, f"customers-{bucket}", *customers)
        weight = STRENGTH + s.discount * np.append(s.tables, other_tables)
        rt = draw_tables(rn, weight[ru] * s.root(root, tables)[rw], s.discount, rng)
        ft = draw_tables(fn, weight[fu] * s.root(s.often_root, s.often_tables)[fw], s.discount, rng)
        root = np.bincount(rw, rt, len(words)).astype(np.int64)
        tables = draw_tables(root, np.full(len(root), s.new_root_table()), s.root_discount, rng)
        save(folder, f"tables-{step}-{bucket}", root, tables, rt, ft)
        width = contexts + len(others)
        by_context = np.bincount(ru, rt, width) + np.bincount(fu, ft, width)
        return with_parts(bucket, [by_context[:contexts], np.bincount(fw, ft, contexts)], [int(root.sum()), int(tables.sum())], others, buckets, by_context[contexts:].astype(np.int64))

    return run


def answers(folder: str, states, sampled: list[int], buckets: int):
    """Rows of ``chunk, bucket, data``: for what a chunk asked, counts of rare words, and log10 of the mean predictive probability of pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf.bucket.iloc[0])
        words, others, rw, ru, rn, fw, fu, fn = load(folder, f"pairs-{bucket}")
        known, counts = load(folder, f"words-{bucket}") if len(words) else (words, np.zeros(0, np.int64))
        at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
        count = np.where(known[at] == words, counts[at], 0) if len(known) else np.zeros(len(words), np.int64)
        (last,), (other_customers,) = received(pdf, others, buckets), load(folder, f"customers-{bucket}")
        rare, often = np.zeros(len(rw)), np.zeros(len(fw))
        for step in sampled:
            s: Seating = states.value[step]
            root, tables, rt, ft = load(folder, f"tables-{step}-{bucket}")
            (other_tables,) = (last,) if step == sampled[-1] else load(folder, f"context-{step}-{bucket}")
            customers, all_tables = np.append(s.customers, other_customers), np.append(s.tables, other_tables)
            rare += s.predictive(rn, rt, customers[ru], all_tables[ru], s.root(root, tables)[rw]) / len(sampled)
            often += s.predictive(fn, ft, customers[fu], all_tables[fu], s.root(s.often_root, s.often_tables)[fw]) / len(sampled)
        rare, often = np.log10(rare), np.log10(often)
        chunks, asked = load(folder, f"asked-{bucket}")
        rows = []
        for chunk, three in zip(chunks, asked):
            w, r, f = (np.cumsum(x, dtype=np.int64) for x in three)
            rows.append((chunk, bucket, pack(count[w].astype(np.uint32), rare[r].astype(np.float32), often[f].astype(np.float32))))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "data"])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunk(folder: str, known, buckets: int, types: int, total: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frequent, often_count = known.value
        vocabulary, tokens, starts, keys, out = load(folder, f"chunk-{int(pdf.chunk.iloc[0])}")
        number, pair, word, _, _, pair_bucket = entries(vocabulary, tokens, starts, out, frequent, buckets)
        count, score = np.zeros(len(vocabulary), np.int64), np.zeros(len(word))
        often = np.flatnonzero(number >= 0)
        count[often] = often_count[number[often]]
        rare = np.flatnonzero(number < 0)
        rare_of, pairs_of, none = dict(bucket_slices((vocabulary[rare] % np.uint64(buckets)).astype(np.int64), buckets)), dict(bucket_slices(pair_bucket, buckets)), np.zeros(0, np.int64)
        for bucket, data in zip(pdf.bucket, pdf.data):
            c, r, f = unpack(data)
            own, at = rare[rare_of.get(bucket, none)], pairs_of.get(bucket, none)
            count[own] = c
            is_rare = number[word[at]] < 0
            score[at[is_rare]], score[at[~is_rare]] = r, f
        c = count[tokens]
        sums = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731  every text has its end token
        return pd.DataFrame({
            "doc_id": pd.array(keys, "Int64"), "held_out": out, "n_tokens": np.diff(starts), "n_known": sums((c > 0).astype(np.int64)), "train_tokens": total,
            "base_score": sums(np.log10((c + 0.5) / (total + 0.5 * (types + 1)))), "score": sums(score[pair]),
        })

    return run


def untrained(docs: DataFrame) -> DataFrame:
    """Without a training token every word has the uniform base's only place, probability 1."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))) + 1
    zero = F.lit(0.0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("held_out"), n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))


def discount_of(once: int, twice: int) -> float:
    """The usual estimate from the words seen once and twice."""
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))


def scores(docs: DataFrame, share: float = SHARE, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    share_all = spark.sparkContext.broadcast
    folder = new_folder(spark, "language-model")
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    counted = materialize(write_chunks(docs, folder, buckets).groupBy("bucket").applyInPandas(merge_words(folder, buckets), "bucket long, types long, tokens long, chunks array<long>"))
    types, total = (x or 0 for x in counted.agg(F.sum("types"), F.sum("tokens")).collect()[0])
    chunks = counted.select(F.explode("chunks").alias("chunk")).repartition(4 * buckets)
    bucket_ids = counted.select("bucket").repartition(buckets)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in (c for b in batches for c in b.column(0).to_pylist()):
            words, counts = load(folder, f"words-{bucket}")
            at = np.flatnonzero(counts >= max(total * share, 1))
            yield pa.RecordBatch.from_pydict({"word": pa.array(words[at].view(np.int64)), "n": pa.array(counts[at])})

    rows = bucket_ids.mapInArrow(often, "word long, n long").collect()  # at most 1 / share
    found = np.array([r.word for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    frequent, often_count = found[order], np.array([r.n for r in rows], np.int64)[order]
    contexts = max(1, len(frequent))
    all_frequent = share_all(frequent)

    merged = materialize(send_pairs(chunks, folder, all_frequent, buckets).groupBy("bucket").applyInPandas(merge_pairs(folder, contexts, buckets), TOTALS))
    if not types:
        return spark.createDataFrame([], SCORES) if merged.isEmpty() else untrained(docs)
    (customers, tables, often_root), (one, two, root_one, root_two, root_customers, root_tables) = summed(merged, contexts)
    state = Seating(
        customers, tables, often_root, np.minimum(often_root, 1), root_customers + int(often_root.sum()), root_tables + int((often_root > 0).sum()), types,
        discount_of(one, two), discount_of(root_one, root_two),
    )
    replies = merged.where("data IS NOT NULL").groupBy("bucket").applyInPandas(first_replies(folder), REPLIES)
    states, steps = {}, burn_in + samples
    for step in range(steps):
        drawn = materialize(replies.groupBy("bucket").applyInPandas(sweep(folder, step, share_all(state), contexts, buckets), TOTALS))
        (tables, often_root, _), (rare_customers, rare_tables) = summed(drawn, contexts)
        often_tables = draw_tables(often_root, np.full(contexts, state.new_root_table()), state.root_discount, np.random.default_rng([step]))
        state = Seating(customers, tables, often_root, often_tables, rare_customers + int(often_root.sum()), rare_tables + int(often_tables.sum()), types, state.discount, state.root_discount)
        states[step] = state
        replies = drawn.where("data IS NOT NULL").groupBy("bucket").applyInPandas(later_replies(folder), REPLIES)
    sampled = list(range(burn_in, steps))
    kept = share_all({k: states[k] for k in sampled})
    found = replies.groupBy("bucket").applyInPandas(answers(folder, kept, sampled, buckets), "chunk long, bucket long, data binary")
    return found.groupBy("chunk").applyInPandas(score_chunk(folder, share_all((frequent, often_count)), buckets, types, total), SCORES)
