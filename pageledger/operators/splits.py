"""Splits of a document where each depends on the one before.

Where the next part begins depends only on where the present one began, so every possible beginning has one successor. Successors are found for all of them at once; the
true splits are what the first beginning reaches. No document is walked: successors come from a running calculation, the reached ones from pointer doubling, which takes as many rounds as
the longest chain has binary digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pageledger.operators.ordered import running_max, with_running
from pageledger.session import drop_tables, materialize, tables_made


def successors(starts: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``starts(keys, at)`` with ``next``: the least ``place`` of ``ends(keys, reach, place)`` whose ``reach`` is not below ``at``.

    Both are put in one falling order, places before the starts that they reach; the least place so far is the answer.
    """
    k = list(keys)
    near = ends.where("reach IS NOT NULL").groupBy(*k, "reach").agg(F.min("place").alias("place"))
    rows = near.select(*k, (-2 * F.col("reach") - 1).cast("long").alias("_pos"), F.col("place").cast("long").alias("_place"), F.lit(None).cast("long").alias("at"))
    rows = rows.unionByName(starts.select(*k, (-2 * F.col("at")).cast("long").alias("_pos"), F.lit(None).cast("long").alias("_place"), F.col("at").cast("long").alias("at")))
    found = with_running(rows, k, "_pos", _least=running_max(-F.col("_place"))).where("at IS NOT NULL")
    return found.select(*k, "at", (-F.col("_least")).alias("next"))


def reached(graph: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, at`` of all nodes of ``graph(keys, at, next, marked)`` that the marked ones lead to, these included.

    In round r every node knows the node 2^r steps on, and all nodes less than 2^r steps from a marked one are marked. A round is two equi-joins; its result is stored.
    """
    k = list(keys)
    on = lambda a, b: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in k]) & (F.col(a) == F.col(b))
    # an edge to a node that is marked already tells nothing
    known = graph.where("marked").select(*[F.col(c).alias(f"_{c}") for c in k], F.col("at").alias("_at"), F.lit(True).alias("_known"))
    state = graph.join(known, on("next", "_at"), "left").select(*k, "at", F.when(F.col("_known").isNull(), F.col("next")).alias("next"), "marked")
    before = len(tables_made)
    state = materialize(state)
    while not state.where("marked AND next IS NOT NULL").isEmpty():
        old = tables_made[before:]
        hop = state.select(*[F.col(c).alias(f"_{c}") for c in k], F.col("at").alias("_at"), F.col("next").alias("_next"))
        hit = state.where("marked AND next IS NOT NULL").select(*[F.col(c).alias(f"_{c}") for c in k], F.col("next").alias("_at")).distinct().withColumn("_hit", F.lit(True))
        further = state.join(hop, on("next", "_at"), "left").select(*k, "at", F.col("_next").alias("next"), "marked")
        marked = F.col("marked") | F.coalesce("_hit", F.lit(False))
        state = materialize(further.join(hit, on("at", "_at"), "left").select(*k, "at", "next", marked.alias("marked")))
        drop_tables(graph.sparkSession, old)
    return state.where("marked").select(*k, "at")
