"""The Merkle manifest against a tree built in one list."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pageledger.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes):
    """The root, and for each node the siblings (before, after) of every level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(at):
            first = p - p % 3
            paths[k].append((level[first:p], level[p + 1 : first + 3]))
            at[k] = p // 3
        level = [H(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def brute_force(rows):
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        rows_of = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        made[s] = rows_of, *climb([leaf(r, r[4]) for r in rows_of])
    root, above = climb([made[s][1] for s in names])
    for s, upper in zip(names, above):
        rows_of, subroot, paths = made[s]
        for r, path in zip(rows_of, paths):
            path = path + upper
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            now = leaf(r, r[4] if odd or r[4] is None else r[4].replace("\n", ""))
            for before, after in path:
                now = H(*before, now, *after)
            out.append((r[0], leaf(r, r[4]), subroot, root, H(*(x for b, a in path for x in b + a)), now, now == root))
    return sorted(out, key=repr)


def documents(n, hot):
    rnd, rows = random.Random(n), []
    for k in range(n):
        source = "hot" if rnd.random() < hot else rnd.choice((None, "", "a", "é", "Z", "src10", "src9"))
        rows.append((k, source, rnd.choice(("en", None)), rnd.choice((k, None)), rnd.choice((f"one\ntwo {k}", f"plain {k}", "", None, "\n", "ñ\n中"))))
    return rows


def checked(spark, rows, height):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "place", "n", "node", "path", "leaf", "changed", "block", "root", "all", "_at", "_part", "met"):
        df = df.withColumn(name, F.lit("clash"))
    return sorted((tuple(r) for r in merkle.tamper_check(df, height).collect()), key=repr)


# one block, blocks of three leaves with many rounds and short last runs, and a source with several blocks of the usual height
@pytest.mark.parametrize("n, hot, height", [(40, 0.5, 7), (100, 0.8, 1), (247, 0.99, 1), (83, 0.6, 2), (4600, 0.99, 7)])
def test_manifest_against_brute_force(spark, n, hot, height):
    rows = documents(n, hot)
    assert checked(spark, rows, height) == brute_force(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 55])
def test_sizes_around_powers(spark, n):
    rows = [(k, "s", "en", k, f"{k}\n") for k in range(n)]
    assert checked(spark, rows, 1) == brute_force(rows)


def test_awkward_rows(spark):
    rows = [(1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "other"), (None, None, None, None, None), (None, "a", None, 0, "t\n"), (5, "a", "en", 9, "long\n" * 100_000), (-7, "b", "en", 1, "n\n")]
    assert checked(spark, rows, 1) == brute_force(rows)


def test_empty_table(spark):
    assert merkle.tamper_check(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_group_of_the_exchange_grows(spark):
    units = spark.range(200).select(F.lit("t").alias("tree"), F.lit(200).cast("long").alias("n"), F.col("id").alias("place"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    out = merkle.butterfly(units, 200).collect()
    want, paths = climb([H(str(k)) for k in range(200)])
    assert len(out) == 200 and {r.node for r in out} == {want}
    assert {r.place: [(list(s.before), list(s.after)) for s in r.path] for r in out} == dict(enumerate(paths))
