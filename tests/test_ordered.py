"""Chunked calculations must equal plain windows, however small the chunks."""

import random

from pyspark.sql import Window, functions as F

import pytest

from pageledger import session
from pageledger.operators.ordered import chunk_totals, following, previous, renumber, running_last, running_max, running_sum, width_for, with_ordinal, with_running


def plain(df):
    w = Window.partitionBy("k").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*", F.coalesce(F.sum("v").over(upto), F.lit(0)), F.coalesce(F.sum("v").over(before), F.lit(0)), F.max("v").over(upto),
        F.last("v", ignorenulls=True).over(before), F.lag("v").over(w), F.lead("v").over(w),
    )


def chunked(df, chunk):
    return with_running(
        df, ["k"], "i", chunk=chunk, s=running_sum(F.col("v")), s0=running_sum(F.col("v"), inclusive=False), m=running_max(F.col("v")),
        l=running_last(F.col("v"), inclusive=False), p=previous(F.col("v")), n=following(F.col("v")),
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# a chunk of 3 of up to 40 rows takes several levels; one of 100 takes none
@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_chunks_equal_plain_windows(spark, chunk):
    rnd = random.Random(7)
    rows = [(k, i, rnd.choice([None, 1, 2, 5]), rnd.random() < 0.2) for k in ("a", "b", None) for i in range(1, rnd.randint(20, 40))]
    df = spark.createDataFrame(rows, "k string, i int, v int, f boolean")
    assert rows_of(chunked(df, chunk)) == rows_of(plain(df))


def test_ordinals_far_apart_and_uneven(spark):
    """Chunks have about as many rows as wanted whether ordinals are 1 or 1,000 apart, and where most of them lie close together."""
    rows = [("even", i * 1000, i % 3) for i in range(4000)] + [("close", (1 << 30) + i, i % 5) for i in range(3000)] + [("close", -i * 100_000, 1) for i in range(1, 300)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    width, totals = chunk_totals(df, ["k"], "i", 50, width_for(df, ["k"], "i", 50), {"s": running_sum(F.col("v"))})
    assert totals.agg(F.max("_rows")).first()[0] <= 200
    assert rows_of(chunked(df, 50)) == rows_of(plain(df))
    even = df.where("k = 'even'")
    _, totals = chunk_totals(even, ["k"], "i", 50, width_for(even, ["k"], "i", 50), {"s": running_sum(F.col("v"))})
    assert totals.count() <= 2 * 4000 / 50


def test_rows_are_not_stored(spark):
    """What is stored is a row for each chunk, nothing at all where keys are short."""
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.col("id").alias("v"))
    before = len(session.tables_made)
    chunked(df, 2000)
    assert len(session.tables_made) == before
    chunked(df, 100)
    made = session.tables_made[before:]
    assert sum(spark.read.parquet(p).count() for p in made) <= 20


@pytest.mark.parametrize("chunk", [5, 10, 1000])
def test_hot_keys_get_the_same_ordinal(spark, chunk):
    rows = [("hot" if i % 3 else "cold", i, i * 7 % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, x int")
    want = {tuple(r) for r in df.select("*", F.row_number().over(Window.partitionBy("k").orderBy("i"))).collect()}
    assert {tuple(r) for r in with_ordinal(df, ["k"], ["i"], "n", chunk).collect()} == want


def test_renumber_closes_gaps(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.5, "y"), ("a", 4.0, "z")], "k string, i double, v string")
    assert [tuple(r) for r in renumber(df, ["k"], "i", "i").orderBy("i").collect()] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z")]
