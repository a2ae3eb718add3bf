"""Packing by optimal length buckets.

The lengths of all documents make one histogram. Dynamic programming over it chooses the bucket boundaries with the least padding. Within a bucket
documents are numbered in a shuffled but fixed order and cut into batches of a token budget.

A length is the words of a text and one end token. The histogram has a bin for every length that occurs, so the boundaries are the best of all for the true
lengths. A corpus of W words has no more than sqrt(2 W) different lengths (100,000 for 30 GB, 6 million for 100 TB), and only these go to the driver.

Defined results: null, empty and blank texts have length 1 (the end token). A document longer than the token budget makes a batch alone. Repeated rows are
packed each by itself. An empty table gives an empty table. Other columns are kept out of the result.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageledger.llm.common import word_array
from pageledger.session import materialize

BUCKETS, TOKEN_BUDGET = 16, 16_384
#: Documents of a bucket that one task numbers.
CHUNK_ROWS = 100_000


def length(text: Column) -> Column:
    return (F.size(word_array(text)) + 1).cast("long")


def best_boundaries(sizes: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over sorted sizes with the least padding in all, by dynamic programming.

    With one bucket more, the best start ``i`` of the bucket that ends at ``j`` is the least of the lines ``cost[i] + mass[i] - many[i] * size``; slopes fall with i and sizes
    rise with j, so the lower hull is walked once and a round takes time in proportion to the number of sizes.
    """
    n = len(sizes)
    many, mass = array("q", [0]), array("q", [0])
    for size, count in zip(sizes, counts):
        many.append(many[-1] + count)
        mass.append(mass[-1] + size * count)
    # one bucket for all up to j
    cost = array("q", [0] + [sizes[j - 1] * many[j] - mass[j] for j in range(1, n + 1)])
    choices = [array("i", [0]) * (n + 1)]
    for _ in range(1, min(buckets, n)):
        new, choice = array("q", [0]), array("i", [0])
        hull, at = [], 0  # (i, height, slope)
        for j in range(1, n + 1):
            i, height, slope = j - 1, cost[j - 1] + mass[j - 1], many[j - 1]
            while len(hull) - at >= 2:
                (_, h1, s1), (_, h2, s2) = hull[-2], hull[-1]
                if (height - h1) * (s2 - s1) > (h2 - h1) * (slope - s1):
                    break
                hull.pop()
            hull.append((i, height, slope))
            size = sizes[j - 1]
            while at + 1 < len(hull) and hull[at + 1][1] - hull[at + 1][2] * size < hull[at][1] - hull[at][2] * size:
                at += 1
            new.append(hull[at][1] - hull[at][2] * size + size * many[j] - mass[j])
            choice.append(hull[at][0])
        cost = new
        choices.append(choice)
    ends, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        ends.append(int(sizes[j - 1]))
        j = choice[j]
    return ends[::-1]


def boundaries(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bucket ends for a table of ``n_tokens``, from the histogram of all rows."""
    sizes, counts = array("q"), array("q")
    for row in lengths.groupBy("n_tokens").count().orderBy("n_tokens").toLocalIterator():
        sizes.append(row["n_tokens"])
        counts.append(row["count"])
    return best_boundaries(sizes, counts, buckets) if sizes else []


def packed(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """``doc_id, n_tokens, bucket, padded_length, batch_id, slot``: where every document goes; batches of a bucket are numbered from 0."""
    # the order within a bucket is that of a hash of the row, so neighbours in the corpus are spread
    rows = materialize(docs.select("doc_id", length(F.col("text")).alias("n_tokens"), F.xxhash64("doc_id", "text").alias("_order")))
    ends = boundaries(rows, buckets)
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    number, end = F.lit(len(ends) - 1), F.lit(ends[-1] if ends else 1)
    for k in range(len(ends) - 2, -1, -1):
        number, end = F.when(F.col("n_tokens") <= ends[k], k).otherwise(number), F.when(F.col("n_tokens") <= ends[k], ends[k]).otherwise(end)
    width = 2.0**64 / chunks
    chunk = F.least(F.floor((F.col("_order").cast("double") + F.lit(2.0**63)) / F.lit(width)), F.lit(chunks - 1)).cast("long")
    placed = rows.select("doc_id", "n_tokens", "_order", number.cast("int").alias("bucket"), end.cast("long").alias("padded_length"), chunk.alias("_chunk"))
    counts = placed.groupBy("bucket", "_chunk").agg(F.count("*").alias("n"))
    before = counts.select("bucket", "_chunk", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("bucket", "_chunk").orderBy("_order", "doc_id", "n_tokens")) - 1
    ranked = placed.withColumn("_rank", own).join(before, ["bucket", "_chunk"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    capacity = F.greatest(F.floor(F.lit(token_budget) / F.col("padded_length")), F.lit(1))
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "padded_length", F.floor(F.col("_rank") / capacity).cast("long").alias("batch_id"), F.pmod(F.col("_rank"), capacity).cast("long").alias("slot")
    )
