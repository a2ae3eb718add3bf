"""Substring dedup: paragraph MinHash, exact verification, and removal of all but one copy of a repeated passage.

A passage that was pasted into another text is seldom a paragraph of its own, so every run of ``size`` words is a paragraph here. A paragraph's MinHash over its
runs of five words is one of these runs; neighbouring paragraphs mostly have the same, so a text of w words has about 2 w / size different ones for each hash
function. Two paragraphs of similarity 0.8 collide under one of two functions in 96 % of the cases, equal ones always, and a passage has many paragraphs.

* Colliding paragraphs are joined to the first one (smallest doc_id and place) of their hash only; collisions on one diagonal of the same two texts make a chain.
* The words of both sides are fetched and compared: a chain is extended word by word, and accepted if the exact Jaccard similarity of its runs of five words
  is 0.8 or more; otherwise its equal runs are taken one by one.
* Then every run of ``size`` words that has a MinHash in common with another place and lies in no counted span is compared by a hash of all its words: equal ones are joined
  to the first of them and go the same way. So of an exact repeat nothing is missed, whatever the first place of its MinHash is.
* Spans that touch on one diagonal of two texts are joined, and only those of at least ``size`` words count. Counted spans of a text that touch are one passage and removed.
* Passages and the places they repeat are clustered to components, for the report.

Since each span repeats a strictly smaller (doc_id, place), one copy of everything stays.

Defined results: null, empty and short texts have no passages. Repeated rows with the same doc_id are one document (any of equal texts; of different ones the
last by text). Rows without doc_id take no part. Words are compared with A-Z lower-cased. Other columns do not matter. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pageledger.llm.common import WORD, has_repeats, mix, pieces, shingle_hashes, split_words, table_of, text_column, word_hashes
from pageledger.llm.components import components
from pageledger.session import drop_tables, materialize, tables_made

SIZE, SHINGLE, FUNCTIONS = 50, 5, 2
#: Shorter equal runs are not taken apart from a chain.
LEAST_RUN = 20
#: Places asked of a repeated text are widened to multiples of this, so that many spans share a request.
GRID = 64


def sliding(a: np.ndarray, width: int, fn: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each window of ``width`` values, by doubling."""
    have, out = 1, a
    while have * 2 <= width:
        out, have = fn(out[:-have], out[have:]), have * 2
    return fn(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def paragraph_minima(hashes: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Places of values that are the minimum of some window of ``width`` values; a window starts at i only if ``i + width <= ends[i]``."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    low = sliding(hashes, width, np.minimum)
    low = np.where(np.arange(len(low)) + width <= ends[: len(low)], low, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    chosen = (sliding(padded, width, np.maximum) == hashes) & (hashes > 0)
    chosen[1:] &= hashes[1:] != hashes[:-1]
    return np.flatnonzero(chosen)


def seeds(docs: DataFrame, size: int = SIZE, functions: int = FUNCTIONS) -> DataFrame:
    """``h, doc_id, pos``: the MinHashes of all paragraphs with the place of their run of words."""
    width = size - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words, starts = split_words(pc.ascii_lower(text_column(b)))
            runs = shingle_hashes(word_hashes(words), SHINGLE)
            n = np.diff(starts)
            owner = np.repeat(np.arange(len(n)), n)[: len(runs)]
            ends = starts[1:][owner] - SHINGLE + 1
            keys = b.column("doc_id").cast(pa.int64())
            for k in range(functions):
                own = runs if k == 0 else mix(runs ^ np.uint64(0x165667B19E3779F9 * k))
                at = paragraph_minima(own, ends, width)
                doc = owner[at]
                yield pa.RecordBatch.from_arrays([pa.array(own[at].view(np.int64)), keys.take(pa.array(doc)), pa.array((at - starts[doc]).astype(np.int32))], names=["h", "doc_id", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long, pos int")


def repeated(found: DataFrame) -> DataFrame:
    """``found`` with the first place (``r_doc, r_pos``) of each hash; only hashes that stand more than once."""
    first = found.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("n")).where("n > 1").select("h", F.col("f.doc_id").alias("r_doc"), F.col("f.pos").alias("r_pos"))
    return found.join(first, "h")


def chains(met: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, r_doc, diag, lo, hi``: collisions with the first paragraph of a hash, joined along a diagonal; lo and hi are places of the first and last one."""
    met = met.where("doc_id <> r_doc OR pos <> r_pos").select("doc_id", "pos", "r_doc", (F.col("pos") - F.col("r_pos")).alias("diag"))
    w = Window.partitionBy("doc_id", "r_doc", "diag").orderBy("pos")
    cut = F.coalesce((F.col("pos") - F.lag("pos").over(w) > 2 * size).cast("int"), F.lit(1))
    linked = met.withColumn("cut", cut).withColumn("chain", F.sum("cut").over(w))
    return linked.groupBy("doc_id", "r_doc", "diag", "chain").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).drop("chain")


def open_runs(docs: DataFrame, met: DataFrame, spans: DataFrame, size: int = SIZE) -> DataFrame:
    """``h, doc_id, pos``: hash and place of the runs of ``size`` words whose first MinHash stands elsewhere too and that lie in none of the spans."""
    met = met.groupBy("doc_id").agg(F.collect_set("h").alias("met"))
    covered = islands(spans, ["doc_id"]).groupBy("doc_id", "i_start").agg(F.max("end").alias("end")).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("i_start").alias("start"), "end")).alias("covered"))
    joined = docs.select("doc_id", "text").join(met, "doc_id").join(covered, "doc_id", "left")
    width = size - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words, starts = split_words(pc.ascii_lower(text_column(b)))
            runs = shingle_hashes(word_hashes(words), SHINGLE)
            for key, a, e, hashes, spans in zip(b.column("doc_id").to_pylist(), starts[:-1], starts[1:], b.column("met"), b.column("covered").to_pylist()):
                if e - a < size:
                    continue
                own = runs[a : e - SHINGLE + 1]
                free = np.isin(sliding(own, width, np.minimum), np.asarray(hashes.values).view(np.uint64))
                for s in spans or []:
                    free[s["start"] : max(s["end"] - size + 1, s["start"])] = False
                at = np.flatnonzero(free)
                acc = np.zeros(len(at), np.uint64)
                for k in [*range(0, size - SHINGLE, SHINGLE), size - SHINGLE]:
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + own[at + k])
                yield pa.RecordBatch.from_arrays([pa.array(acc.view(np.int64)), pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32))], names=["h", "doc_id", "pos"])

    return joined.mapInArrow(run, "h long, doc_id long, pos int")


def slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, start, end, words``: the words of the wanted places of each text, joined by blanks."""
    asked = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("asked"))
    joined = docs.select("doc_id", "text").join(asked, "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.string())])
        for b in pieces(batches, rows=256):
            words, starts = split_words(pc.ascii_lower(text_column(b)))
            for i, (key, places) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("asked").to_pylist())):
                own = words.slice(starts[i], starts[i + 1] - starts[i]).to_pylist()
                for at in range(0, len(places), 512):
                    yield table_of([(key, p["start"], p["end"], " ".join(own[p["start"] : p["end"]])) for p in places[at : at + 512]], schema)

    return joined.mapInArrow(run, "doc_id long, start int, end int, words string")


def jaccard_runs(a: list[str], b: list[str]) -> float:
    x = {tuple(a[i : i + SHINGLE]) for i in range(len(a) - SHINGLE + 1)}
    y = {tuple(b[i : i + SHINGLE]) for i in range(len(b) - SHINGLE + 1)}
    return len(x & y) / len(x | y) if x and y else float(a == b)


def verified_spans(a: list[str], b: list[str], lo: int, hi: int, shift: int, threshold: float) -> list[tuple[int, int]]:
    """Spans ``[start, end)`` of a that repeat b on the diagonal ``a[i] ~ b[i - shift]``; the chain covers ``[lo, hi)``."""
    left, right = max(0, shift), min(len(a), len(b) + shift)
    lo, hi = max(lo, left), min(hi, right)
    while lo > left and a[lo - 1] == b[lo - 1 - shift]:
        lo -= 1
    while hi < right and a[hi] == b[hi - shift]:
        hi += 1
    if hi - lo >= SHINGLE and jaccard_runs(a[lo:hi], b[lo - shift : hi - shift]) >= threshold:
        return [(lo, hi)]
    spans, start = [], None
    for i in range(lo, hi + 1):
        same = i < hi and a[i] == b[i - shift]
        if same and start is None:
            start = i
        elif not same and start is not None:
            spans += [(start, i)] * (i - start >= LEAST_RUN)
            start = None
    return spans


def verify(docs: DataFrame, found: DataFrame, size: int = SIZE, threshold: float = 0.8) -> DataFrame:
    """``doc_id, start, end, r_doc, r_start``: the spans of chains that repeat the other text."""
    margin = F.lit(size)
    asked = found.select(
        "*", F.greatest(F.lit(0), F.col("lo") - margin).alias("start"), (F.col("hi") + F.lit(SHINGLE) + margin).alias("end"),
        (F.floor(F.greatest(F.lit(0), F.col("lo") - F.col("diag") - margin) / GRID) * GRID).cast("int").alias("r_from"),
        (F.ceil((F.col("hi") - F.col("diag") + F.lit(SHINGLE) + margin) / GRID) * GRID).cast("int").alias("r_to"),
    )
    asked = materialize(asked)
    own = asked.select("doc_id", "start", "end")
    other = asked.select(F.col("r_doc").alias("doc_id"), F.col("r_from").alias("start"), F.col("r_to").alias("end"))
    words = materialize(slices(docs, own.union(other)))
    both = asked.join(words.withColumnRenamed("words", "a"), ["doc_id", "start", "end"]).join(
        words.select(F.col("doc_id").alias("r_doc"), F.col("start").alias("r_from"), F.col("end").alias("r_to"), F.col("words").alias("b")), ["r_doc", "r_from", "r_to"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("r_doc", pa.int64()), ("r_start", pa.int32())])
        for b in batches:
            rows = []
            for doc, r_doc, diag, lo, hi, start, r_from, a, r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "r_doc", "diag", "lo", "hi", "start", "r_from", "a", "b"))):
                shift = diag - start + r_from
                for x, y in verified_spans(a.split(" "), r.split(" "), lo - start, hi + SHINGLE - start, shift, threshold):
                    rows.append((doc, x + start, y + start, r_doc, x + start - diag))
            yield table_of(rows, schema)

    return both.select("doc_id", "r_doc", "diag", "lo", "hi", "start", "r_from", "a", "b").mapInArrow(run, "doc_id long, start int, end int, r_doc long, r_start int")


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``i_start``: where the run of touching spans that a span belongs to starts."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    head = F.when(before.isNull() | (before < F.col("start")), F.col("start"))
    return spans.withColumn("head", head).withColumn("i_start", F.last("head", ignorenulls=True).over(w)).drop("head")


def full_spans(spans: DataFrame, size: int) -> DataFrame:
    """Spans that touch on one diagonal of two texts joined; of these the ones of ``size`` words or more."""
    one = islands(spans.distinct().withColumn("diag", F.col("start") - F.col("r_start")), ["doc_id", "r_doc", "diag"])
    joined = one.groupBy("doc_id", "r_doc", "diag", "i_start").agg(F.max("end").alias("end")).where(F.col("end") - F.col("i_start") >= size)
    return joined.select("doc_id", F.col("i_start").alias("start"), "end", "r_doc", (F.col("i_start") - F.col("diag")).alias("r_start"))


def repeated_passages(docs: DataFrame, size: int = SIZE, threshold: float = 0.8) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, kept_doc_id, kept_start_word``: the passages to remove, words counted from 0, end excluded."""
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text").groupBy("doc_id").agg(F.max("text").alias("text")) if has_repeats(docs) else docs.where("doc_id IS NOT NULL")
    found = materialize(seeds(docs, size))
    places = tables_made[-1:]
    # read by both rounds; nothing else reads the places after it
    met = materialize(repeated(found))
    drop_tables(docs.sparkSession, places)
    before = len(tables_made)
    spans = materialize(full_spans(verify(docs, chains(met, size), size, threshold), size))
    drop_tables(docs.sparkSession, tables_made[before:-1])
    # places of a chain are those of its runs of five words
    rest = chains(repeated(materialize(open_runs(docs, met, spans, size))), size).withColumn("hi", F.col("hi") + F.lit(size - SHINGLE))
    joined = islands(spans.union(full_spans(verify(docs, rest, size, threshold), size)), ["doc_id"])
    longest = F.max(F.struct((F.col("end") - F.col("start")).alias("n"), F.col("r_doc"), F.col("r_start"), F.col("start").alias("s"))).alias("m")
    passage = joined.groupBy("doc_id", "i_start").agg(F.max("end").alias("end"), longest)
    return passage.select(
        "doc_id", F.col("i_start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("i_start")).alias("n_words"), F.col("m.r_doc").alias("kept_doc_id"), F.col("m.r_start").alias("kept_start_word"),
        F.col("m.n").alias("kept_words"),
    )


def node(doc: str, start: str):
    return F.format_string("%020d:%010d", F.col(doc), F.col(start))


def with_components(passages: DataFrame) -> DataFrame:
    """Add ``component_id`` and ``component_doc_id``: passages that repeat each other, directly or by others, with the smallest place of the component."""
    passages = materialize(passages)
    own = passages.select("doc_id", F.col("start_word").alias("start"), F.col("end_word").alias("end"))
    source = passages.select(F.col("kept_doc_id").alias("doc_id"), F.col("kept_start_word").alias("start"), (F.col("kept_start_word") + F.col("kept_words")).alias("end"))
    places = materialize(islands(own.union(source).distinct(), ["doc_id"]).select("doc_id", "start", "end", node("doc_id", "i_start").alias("node")))
    a = places.select(F.col("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("node").alias("a"))
    b = places.select(F.col("doc_id").alias("kept_doc_id"), F.col("start").alias("kept_start_word"), F.col("end").alias("kept_end"), F.col("node").alias("b"))
    edges = materialize(passages.withColumn("kept_end", F.col("kept_start_word") + F.col("kept_words")).join(a, ["doc_id", "start_word", "end_word"]).join(b, ["kept_doc_id", "kept_start_word", "kept_end"]))
    labels = components(edges.select("a", "b")).select(F.col("id").alias("a"), "component")
    return edges.join(labels, "a", "left").select(
        "doc_id", "start_word", "end_word", "n_words", "kept_doc_id", "kept_start_word", F.coalesce("component", "a").alias("component_id"),
        F.split(F.coalesce("component", "a"), ":")[0].cast("long").alias("component_doc_id"),
    )


SPOT = re.compile(WORD)


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space before them."""
    places = [m.span() for m in SPOT.finditer(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : places[start - 1][1] if start else 0])
        at = places[min(end, len(places)) - 1][1]
    return "".join([*out, text[at:]])


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents, all columns kept, without the words of the passages. Of rows with one doc_id only those with the text that was searched are cut."""
    cuts = passages.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("cuts"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    if has_repeats(docs):
        cuts = cuts.join(docs.groupBy("doc_id").agg(F.max("text").alias("searched")), "doc_id")
    else:
        cuts = cuts.withColumn("searched", F.lit(None).cast("string"))
    cuts = materialize(cuts)

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None or t is None else cut_text(t, [(x["start_word"], x["end_word"]) for x in s]))

    joined = rows.join(cuts, "doc_id", "left")
    whole = F.col("cuts").isNull() | (F.col("searched") != F.col("text"))
    text = F.when(whole, F.col("text")).otherwise(cut("text", "cuts"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])
