"""Near duplicates by circulant MinHash, banding and exact Jaccard.

* A text's set is that of its distinct runs of ``n`` words, kept as 64-bit hashes. Documents with equal sets make one class; only one of a class goes on.
* Circulant MinHash: one permutation spreads the shingles over 32 bits; a second one, shifted by k places for coordinate k, gives all coordinates. Both are
  bijections of the 32-bit integers.
* Bands of a few coordinates are compared by equi-join. In every bucket each class is paired with one hub only, never with all others. Pairs are
  confirmed on the full sets. Buckets whose classes are not yet one component are paired with the class that has least of its own (most of what its copies
  share), as a copy near any other one is mostly near that one.
* What is then left in mixed buckets is joined by prefixes: with shingles ordered from rare to frequent, two sets of the threshold's similarity share one of
  the first few. Shingles that only one component has cannot be shared by a new link and come first of all. Set sizes and places in the order are bounds
  without error, so no pair at the threshold is left out: every two classes of a bucket end in one component, compared, or proven too far apart.
* Links are joined to components with minimum labels.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; a text with fewer words than ``n`` has its whole sequence as only
shingle. Repeated rows belong to one class. Rows of one doc_id with different texts are one document: a link of any of its texts is its link, and all its rows
get one component. Rows without doc_id are left as they are: they take no part, and their own component is null. Other columns do not matter.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pageledger.llm.common import mix, pieces, shingle_hashes, split_words, text_column, word_hashes
from pageledger.llm.components import components
from pageledger.session import materialize

#: Bands and coordinates of each: a pair of similarity 0.85 is missed by all bands once in 1.3 million, one of 0.8 once in 13 thousand.
BANDS, ROWS = 24, 5
TILE = 1024
#: Set sizes of one class of sizes differ by less than this share.
SIZE_STEP = 1 / 32


def first_permutation(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def second_permutation(x: np.ndarray) -> np.ndarray:
    """In place, to keep a tile in the cache."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Minimum over a set of the second permutation at the first one's place, shifted once for each coordinate."""
    place = first_permutation((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32))
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), TILE):
        np.minimum(out, second_permutation(place[None, at : at + TILE] + shift).min(axis=1), out=out)
    return out


def text_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    words, starts = split_words(pc.ascii_lower(texts))
    hashed = word_hashes(words)
    runs = shingle_hashes(hashed, n)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        else:  # the whole sequence, with its length
            own = np.full(1, b - a, np.uint64)
            for h in hashed[a:b]:
                own = mix(own * np.uint64(0x9E3779B97F4A7C15) + h)
            out.append(own[: min(1, b - a)])
    return out


def set_digest(s: np.ndarray) -> bytes:
    """128 bits of a sorted set."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"


def sketches(docs: DataFrame, n: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, set digest and band hashes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = text_sets(text_column(b), n)
            keys = np.zeros((len(sets), bands), np.uint64)
            for k, s in enumerate(sets):
                sig = circulant_signature(s, bands * rows).astype(np.uint64).reshape(bands, rows)
                acc = np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
                keys[k] = acc
            flat = pa.array(keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat),
                ],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` with ``texts(id, text)``: all pairs, with whether ``100 * intersection >= percent * union`` on the full sets.

    A pair comes once for every two texts of its documents.
    """
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = (None, None), None
        for b in batches:
            for part in pieces([b], "text_a"):
                sets = text_sets(text_column(part, "text_a"), n)
                ok = []
                for s, key, text in zip(sets, part.column("b").to_pylist(), part.column("text_b")):
                    if (key, text) != last:  # rows come by hub
                        last, last_set = (key, text), text_sets(pa.array([text.as_py() or ""]), n)[0]
                    both = len(np.intersect1d(s, last_set, assume_unique=True))
                    ok.append(bool(both) and 100 * both >= percent * (len(s) + len(last_set) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs ``a > b`` of a bucket's hub, the ``id`` with the smallest ``rank``, with all that are not yet in its component. Aggregated map-side; the join splits hot buckets."""
    hubs = buckets.groupBy("band").agg(F.min(F.struct("rank", F.col("id").alias("hub"), F.col("component").alias("main"))).alias("m")).select("band", "m.hub", "m.main")
    return buckets.join(hubs, "band").where("component <> main").select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()


def unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows with their component, of the buckets that hold more than one component."""
    named = buckets.select("band", "id").join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return named.join(mixed, "band")


def shingle_rows(texts: DataFrame, n: int) -> DataFrame:
    """``id, part, component, n, shingle`` of ``texts(id, component, text)``; ``part`` tells the texts of a document apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=1 << 20):
            sets = text_sets(text_column(b), n)
            sizes = np.array([len(s) for s in sets], np.int64)
            own = np.array([int.from_bytes(set_digest(s)[:8], "little", signed=True) for s in sets], np.int64)
            columns = [np.repeat(c, sizes) for c in (b.column("id").to_numpy(), own, b.column("component").to_numpy(), sizes)]
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, flat)], names=["id", "part", "component", "n", "shingle"])

    return texts.select("id", "component", "text").mapInArrow(run, "id long, part long, component long, n long, shingle long")


def least_own(rows: DataFrame) -> DataFrame:
    """``id, rank``: the share of a document's shingles that no other one of ``rows`` has."""
    once = rows.groupBy("shingle").agg(F.count("*").alias("f"), F.min("id").alias("id")).where("f = 1").groupBy("id").agg(F.count("*").alias("own"))
    return rows.groupBy("id").agg(F.count("*").alias("all")).join(once, "id", "left").select("id", (F.coalesce("own", F.lit(0)) / F.col("all")).alias("rank"))


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(np.log1p(SIZE_STEP)))


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """``lo, hi, shingle, id, component, n, size, left``: the places by which a set can be found from sets of other components.

    ``lo, hi`` are the size classes of the two sets to meet, ``size`` the set's own one, and ``left`` the number of its shingles from that place on.
    """
    shared = rows.groupBy("shingle").agg(F.count("*").alias("f"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("shingle", "f")
    # shingles of one component alone stand first; they are only counted
    sets = rows.join(shared, "shingle").groupBy("id", "part", "component", "n").agg(F.collect_list(F.struct("f", "shingle")).alias("s"))
    sets = sets.where(100 * F.size("s") >= percent * F.col("n")).withColumn("s", F.sort_array("s")).withColumn("size", size_class(F.col("n")))
    least, most = F.ceil(percent * F.col("n") / 100), F.floor(100 * F.col("n") / percent)
    met = sets.withColumn("other", F.explode(F.sequence(size_class(least), size_class(most))))
    smallest = F.greatest(F.floor(F.pow(F.lit(1 + SIZE_STEP), F.col("other"))) - 1, least)
    common = F.ceil(percent * (F.col("n") + smallest) / (100 + percent))  # shingles that a link to a set of that size needs
    first = F.greatest(F.col("n") - common + 1 - (F.col("n") - F.size("s")), F.lit(0)).cast("int")
    placed = met.select("id", "component", "n", "size", F.least("size", "other").alias("lo"), F.greatest("size", "other").alias("hi"), F.size("s").alias("k"), F.posexplode(F.slice("s", F.lit(1), first)))
    return placed.select("lo", "hi", "col.shingle", "id", "component", "n", "size", (F.col("k") - F.col("pos")).alias("left"))


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a > b`` of different components that can reach the threshold. The largest component of a key is not paired within itself."""
    key = ["lo", "hi", "shingle"]
    places = materialize(prefixes(rows, percent))
    main = places.groupBy(*key, "component").count().groupBy(*key).agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    full = materialize(places.join(main.select(*key, F.col("m.component").alias("main")), key))
    outer = full.where("component <> main").select(*key, *[F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "size", "left")])
    sizes = (100 * F.least("n", "x_n") >= percent * F.greatest("n", "x_n")) & ((F.col("lo") == F.col("hi")) | (F.col("size") != F.col("x_size")))
    enough = (100 + percent) * F.least("left", "x_left") >= percent * (F.col("n") + F.col("x_n"))
    # a pair of two that are both outside the largest component is made once
    once = (F.col("component") == F.col("main")) | (F.col("x_component") < F.col("component"))
    joined = outer.join(full, key).where((F.col("x_component") != F.col("component")) & sizes & enough & once)
    return joined.select(F.greatest("x_id", "id").alias("a"), F.least("x_id", "id").alias("b")).distinct()


def near_classes(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    sketch = materialize(sketches(docs, n, bands, rows))
    full = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("id")))
    reps = full.join(classes, [full.digest == classes.digest, full.doc_id == classes.id], "left_semi").select(F.col("doc_id").alias("id"), "bands")
    buckets = reps.select("id", F.explode("bands").alias("band")).distinct()
    shared = buckets.groupBy("band").count().where("count > 1").select("band")
    buckets = materialize(buckets.join(shared, "band"))

    # only texts of classes that share a bucket are needed again
    used = buckets.select("id").distinct()
    texts = materialize(docs.select(F.col("doc_id").alias("id"), "text").join(used, "id", "left_semi").dropDuplicates(["id", "text"]))

    # classes that meet in a document are one component
    owned = full.join(classes, "digest").select("doc_id", "id")
    several = owned.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("hi")).where("b < hi").select("doc_id", "b")
    links = materialize(owned.join(several, "doc_id").where("id > b").select(F.col("id").alias("a"), "b").distinct())

    rest = buckets.withColumn("component", F.col("id"))
    pairs = hub_pairs(rest.withColumn("rank", F.lit(0)))
    seen, labels = None, None
    for step in ("hub", "middle", "rest"):
        if step != "hub":
            rest = materialize(unsettled(rest, labels))
            if rest.isEmpty():
                break
            rows = materialize(shingle_rows(texts.join(rest.select("id", "component").distinct(), "id"), n))
            pairs = hub_pairs(rest.join(least_own(rows), "id")) if step == "middle" else prefix_pairs(rows, percent)
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        done = materialize(confirmed(pairs, texts, n, percent))
        seen = pairs if seen is None else seen.union(pairs)
        links = links.union(done.where("linked").select("a", "b"))
        labels = components(links)
    return (
        sketch.select("doc_id", "n_shingles", "digest")
        .join(classes, "digest", "left")
        .join(labels, "id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
