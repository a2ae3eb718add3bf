"""Merkle manifest of a dataset, built by a butterfly exchange.

Every document is a leaf; the leaves of a source, in order of doc_id, form a tree of runs of three, and the sources' roots form another one above. The leaves
of a source are cut into aligned blocks of 3^7. A task hashes its block to one node. Then blocks exchange nodes round by round: in round r a block meets the blocks that stand
at the same place of the neighbouring subtrees of height r, at most three in all, so a group of the shuffle never has more rows. All three hash their parent, redundantly, and each keeps
its own siblings. After the last round each block has the source's root and its whole upper proof; nothing is passed down again. Where the last
subtree of a run is missing, its place is filled with a copy of the last one there, so that each node always has one row for each block below it (at most three times the
blocks). The sources' roots go through the same exchange and reach the blocks of a source by one join.

Texts are hashed where they are read and never move; what moves is a key and two digests a document. A document's row number comes from the sorted partitions and the counts before
them. Group sizes: 2187 leaves, three nodes; the table of counts has a row for each source and partition.

Defined results: nulls count as ``-``, rows without a source form a source of their own, before all others. Rows without doc_id come first in their source; rows of one doc_id are
ordered by leaf, and equal rows are leaves of their own. An empty table gives no row. Other columns do not matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pageledger.session import materialize

FANOUT = 3
#: Levels of the tree inside a block.
LEVELS = 7
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: array<string>, after: array<string>>>"


def _encoded(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(text: Column) -> Column:
    """The digest of a row with that text."""
    return F.sha2(F.concat(*(_encoded(F.col(c)) for c in LEAF_COLUMNS[:-1]), _encoded(text)), 256)


def hashed(nodes: list[str]) -> list[str]:
    """The level above a list of nodes."""
    return [hashlib.sha256("".join(nodes[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(nodes), FANOUT)]


def levels(leaves: list[str], height: int | None) -> list[list[str]]:
    """All levels of a block, leaves first: up to that height, whatever its size, or (None) up to its only node."""
    out = [leaves]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        out.append(hashed(out[-1]))
    return out


def rounds(n: int) -> int:
    """Exchanges until n nodes are one."""
    r = 0
    while FANOUT**r < n:
        r += 1
    return r


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add ``place`` (from 0, within its tree) and ``n`` (rows of the tree). The sorted rows are stored, so that their numbers stay whatever is run again."""
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    ordered = materialize(ordered)
    counts = ordered.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    w = Window.partitionBy(tree).orderBy("_part")
    counts = counts.select(tree, "_part", "_first", (F.sum("_rows").over(w) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy(tree)).alias("n"))
    return ordered.join(counts, [tree, "_part"]).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "n")


def butterfly(units: DataFrame, most: int) -> DataFrame:
    """``units(tree, n, place, node)``, one row for each of a tree's n nodes: replace ``node`` by the tree's root and add ``path``, the siblings met on the way up.

    ``most`` is the largest n. Rows with ``place >= n`` that stand in for missing subtrees are gone again at the end.
    """
    state = units.select("tree", "n", "place", "node", F.array().cast(PATH).alias("path"))
    for r in range(rounds(most)):
        width = F.lit(FANOUT**r).cast("long")
        live = F.col("n") > width
        run = F.when(live, F.floor(F.col("place") / (FANOUT * width))).otherwise(F.col("place"))
        digits = F.when(live, F.col("place") % width).otherwise(F.lit(-1))
        child = F.floor(F.col("place") / width) % FANOUT
        met = state.groupBy("tree", "n", run.alias("run"), digits.alias("digits")).agg(F.array_sort(F.collect_list(F.struct(child.alias("child"), "place", "node", "path"))).alias("met"))
        parent = F.sha2(F.array_join(F.transform("met", lambda x: x.node), ""), 256)
        many = F.size("met")
        met = met.withColumn("parent", F.when(live, parent).otherwise(F.col("met")[0]["node"]))
        each = met.select("tree", "n", "run", "digits", "met", "parent", F.explode(F.when(live, F.sequence(F.lit(0), F.lit(FANOUT - 1))).otherwise(F.array(F.lit(0)))).alias("k"))
        own = F.least(F.col("k"), many - 1)
        nodes = F.transform("met", lambda x: x.node)
        step = F.struct(F.slice(nodes, F.lit(1), own).alias("before"), F.slice(nodes, own + 2, F.lit(FANOUT)).alias("after"))
        path = F.col("met")[own]["path"]
        state = each.select(
            "tree", "n", F.when(live, F.col("run") * (FANOUT * width) + F.col("k") * width + F.col("digits")).otherwise(F.col("run")).alias("place"), F.col("parent").alias("node"),
            F.when(live, F.array_append(path, step)).otherwise(path).alias("path"),
        )
    return state.where("place < n")


def proofs(docs: DataFrame, others: dict[str, Column] | None = None, height: int = LEVELS) -> DataFrame:
    """``height`` is the number of levels inside a block. A row for each document: ``doc_id, leaf, subroot, root, path`` and the columns of ``others``. ``path`` has for each level the siblings before and after the node, from the leaf's run up to
    the root."""
    others, block = others or {}, FANOUT**height
    rows = docs.select(
        F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"),
        *(c.alias(n) for n, c in others.items()),
    )
    leaves = placed(rows, "tree", ["doc_id", "leaf"]).withColumn("block", F.floor(F.col("place") / block))

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n = table["n"][0].as_py()
        node = levels(table["leaf"].to_pylist(), None if n <= block else height)[-1][0]
        return pa.table({"tree": table["tree"][:1], "n": [-(-n // block)], "place": table["block"][:1], "node": [node]})

    blocks = materialize(leaves.select("tree", "block", "place", "n", "leaf").groupBy("tree", "block").applyInArrow(top, "tree string, n long, place long, node string"))
    most = blocks.agg(F.max("n")).first()[0] or 0
    uppers = materialize(butterfly(blocks, most))
    roots = placed(uppers.where("place = 0").select(F.lit("").alias("all"), "tree", "node"), "all", ["tree"])
    sources = roots.select(F.col("all").alias("tree"), "n", "place", "node")
    # a source is known by its place while its root travels
    there = butterfly(sources, sources.count()).select("place", F.col("node").alias("root"), F.col("path").alias("above"))
    there = roots.select("tree", "place").join(there, "place").select("tree", "root", "above")
    heads = uppers.join(there, "tree").select("tree", F.col("place").alias("block"), F.col("node").alias("subroot"), "root", F.concat("path", "above").alias("path"))
    kept = ["doc_id", "leaf", *others]
    fields = pa.struct([("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])

    def whole(table: pa.Table, head: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n = table["n"][0].as_py()
        tree, upper = levels(table["leaf"].to_pylist(), None if n <= block else height), head["path"][0].as_py()
        paths = []
        for k in range(table.num_rows):
            path = []
            for level in tree[:-1]:
                first = k - k % FANOUT
                path.append({"before": level[first:k], "after": level[k + 1 : first + FANOUT]})
                k //= FANOUT
            paths.append(path + upper)
        same = {c: pa.array(head[c].to_pylist() * table.num_rows, pa.string()) for c in ("subroot", "root")}
        return pa.table({**{c: table[c] for c in kept}, **same, "path": pa.array(paths, pa.list_(fields))})

    types = dict(leaves.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "subroot string", "root string", f"path {PATH}"])
    return leaves.groupBy("tree", "block").cogroup(heads.groupBy("tree", "block")).applyInArrow(whole, schema)


def folded(start: str) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate("path", F.col(start), lambda node, x: F.sha2(F.concat(F.array_join(x.before, ""), node, F.array_join(x.after, "")), 256))


def proof_digest() -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform("path", lambda x: F.concat(x.before, x.after))), ""), 256)


def tamper_check(docs: DataFrame, height: int = LEVELS) -> DataFrame:
    """Delete the line ends of every document whose id has an even checksum, and see whether its proof still leads to the root."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(F.translate("text", "\n", ""))).otherwise(leaf(F.col("text")))
    found = proofs(docs, {"changed": changed}, height)
    checked = found.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded("changed").alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
