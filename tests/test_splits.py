"""Successor graphs against plain walks."""

import random

from pyspark.sql import functions as F

from pageledger.operators import segment as S
from pageledger.operators.splits import reached, successors


def test_successors_are_the_least_places(spark):
    rnd = random.Random(4)
    starts = [(d, a) for d in ("x", "y", None) for a in rnd.sample(range(200), 60)]
    ends = [(d, r, r + 1 + rnd.randrange(40)) for d in ("x", "y", None) for r in rnd.choices(range(-5, 220), k=80)] + [("x", None, 3)]
    got = {(r.d, r.at): r.next for r in successors(spark.createDataFrame(starts, "d string, at long"), spark.createDataFrame(ends, "d string, reach long, place long"), ["d"]).collect()}
    assert got == {(d, a): min((p for e, r, p in ends if e == d and r is not None and r >= a), default=None) for d, a in starts}


def test_reached_follows_long_chains(spark):
    """A chain of 600 steps, one that is entered in the middle, one that nothing leads to, and a null key."""
    edges = [("a", n, n + 3 if n < 1800 else None, n == 0) for n in range(0, 1801)] + [("b", n, n + 1, n in (5, 20)) for n in range(30)] + [("c", 1, 2, False), ("c", 2, None, False), (None, 1, 4, True), (None, 4, None, False)]
    got = {tuple(r) for r in reached(spark.createDataFrame(edges, "d string, at long, next long, marked boolean"), ["d"]).collect()}
    assert got == {("a", n) for n in range(0, 1801, 3)} | {("b", n) for n in range(5, 30)} | {(None, 1), (None, 4)}


def test_many_headings_in_one_document(spark):
    """Every page opens with a heading that splits only after 400 characters."""
    line = "SM12 Visual Testing"
    pages = spark.range(1, 3001).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page_num"), F.concat(F.lit(line + "\n"), F.expr("repeat('x', cast(id % 7 * 30 as int))")).alias("text"))
    want, start, at, before = 0, None, 0, None
    for n in range(1, 3001):
        if start is None or before - start > 400:
            want, start = want + 1, at
        size = n % 7 * 30
        before = at + len(line) + (1 + size if size else 0)
        at += len(line) + 1 + (size + 1 if size else 0)
    assert S.segment_blocks(pages)[0].count() == want


def test_one_document_of_many_pages(spark):
    """Groups of three pages: the codes of a page change with every third page."""
    pages = spark.range(1, 6001).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page_num"), F.expr("concat('AB', 10 + cast((id - 1) / 3 as int) % 7, ' CD', 10 + cast((id - 1) / 3 as int) % 5)").alias("text"))
    groups = S.density_split(pages)
    assert groups.where("group_no <> cast((page_num + 2) / 3 as int)").count() == 0 and groups.count() == 6000
