"""Ordered calculations that never need a whole group in one task.

A window over ``(doc, machine, variant)`` puts one key into one task. The helpers here cut long keys into chunks of about equal numbers of rows, run the window inside a chunk
and add what earlier chunks carry over, itself a running calculation over the chunks' totals. Where no key is longer than a chunk, which one look at keys and ordinals tells, a
plain window is all there is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageledger.session import materialize

CHUNK = 8192
UNKNOWN = -1


@dataclass(frozen=True)
class Running:
    """One ordered column: ``kind`` is sum, max, last (not null), prev or next. With ``peers`` an inclusive column sees all rows that share the row's ordinal."""

    kind: str
    expr: Column
    inclusive: bool = True
    peers: bool = False


def running_sum(c: Column, inclusive: bool = True) -> Running:
    return Running("sum", c, inclusive)


def running_max(c: Column, inclusive: bool = True, peers: bool = False) -> Running:
    return Running("max", c, inclusive, peers)


def running_last(c: Column, inclusive: bool = True, peers: bool = False) -> Running:
    return Running("last", c, inclusive, peers)


def previous(c: Column) -> Running:
    return Running("prev", c)


def following(c: Column) -> Running:
    return Running("next", c)


def _chunk_total(r: Running, order: str) -> Column:
    if r.kind == "sum":
        return F.sum(r.expr)
    if r.kind == "max":
        return F.max(r.expr)
    if r.kind == "last":
        return F.max(F.when(r.expr.isNotNull(), F.struct(F.col(order), r.expr.alias("v"))))
    pick = F.max if r.kind == "prev" else F.min
    return pick(F.struct(F.col(order), r.expr.alias("v")))


def _given(r: Running, total: Column) -> Running:
    """What a chunk is given by the chunks before it (after it, for ``next``)."""
    kind = {"sum": "sum", "max": "max", "last": "max", "prev": "prev", "next": "next"}[r.kind]
    return Running(kind, total, inclusive=False)


def _local(r: Running, order: str, part: Sequence[str]) -> Column:
    w = Window.partitionBy(*part).orderBy(order)
    frame = w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if r.inclusive and r.peers else w.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
    if r.kind == "sum":
        return F.sum(r.expr).over(frame)
    if r.kind == "max":
        return F.max(r.expr).over(frame)
    if r.kind == "last":
        return F.last(r.expr, ignorenulls=True).over(frame)
    boxed = F.struct(r.expr.alias("v"))
    return (F.lag(boxed) if r.kind == "prev" else F.lead(boxed)).over(w)


def _merge(r: Running, local: Column, carry: Column) -> Column:
    if r.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if r.kind == "max":
        return F.greatest(local, carry)
    if r.kind == "last":
        return F.coalesce(local, carry["v"])
    return F.when(local.isNotNull(), local["v"]).otherwise(carry["v"])


def _alone(r: Running, local: Column) -> Column:
    if r.kind == "sum":
        return F.coalesce(local, F.lit(0))
    return local["v"] if r.kind in ("prev", "next") else local


def width_for(df: DataFrame, keys: Sequence[str], order: str, chunk: int = CHUNK) -> int | None:
    """How many units of the ordinal make a chunk of about ``chunk`` rows, however far apart the ordinals are; None if no key has more rows than that.

    Reads keys and ordinal only.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(order) - F.min(order) + 1).alias("span"))
    n, span = per_key.where(F.col("n") > chunk).agg(F.sum("n"), F.sum("span")).first()
    return chunk * max(1, int(span / n)) if n else None


def chunk_totals(df: DataFrame, keys: Sequence[str], order: str, chunk: int, width: int, cols: dict[str, Running]) -> tuple[int, DataFrame]:
    """Totals of each chunk, stored, and the width that they have in the end.

    Ordinals may lie closer in one place than in another: chunks are narrowed until none has more than four times the rows wanted, which they cannot have at a width of ``chunk``.
    """
    while True:
        totals = df.groupBy(*keys, _chunk_of(order, width).alias(f"_chunk_{order}")).agg(F.count("*").alias("_rows"), *[_chunk_total(r, order).alias(f"_t_{n}") for n, r in cols.items()])
        totals = materialize(totals)
        if width <= chunk or totals.agg(F.max("_rows")).first()[0] <= 4 * chunk:
            return width, totals
        width = max(chunk, width // 4)


def _chunk_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def with_running(
    df: DataFrame, keys: Sequence[str], order: str, chunk: int = CHUNK, width: int | None = UNKNOWN, **cols: Running
) -> DataFrame:
    """Add ordered columns over ``keys`` in the order of the integer column ``order`` (unique within a key). ``width`` is what ``width_for`` gave for the same rows, if they
    were looked at before.

    A scan of several levels: rows run inside their chunk, the chunks' totals run by this same function (their totals in turn, and so on, until no key has more totals than
    a chunk has rows), and what a chunk is given is joined to its rows. Only totals are stored, a row for each chunk; the rows themselves pass once, with one shuffle by key and chunk.
    """
    width = width_for(df, keys, order, chunk) if width == UNKNOWN else width
    kept = [c for c in df.columns if c not in cols]
    if width is None:
        return df.select(*kept, *[_alone(r, _local(r, order, keys)).alias(n) for n, r in cols.items()])
    width, totals = chunk_totals(df, keys, order, chunk, width, cols)
    given = {f"_c_{n}": _given(r, F.col(f"_t_{n}")) for n, r in cols.items()}
    at = f"_chunk_{order}"  # levels have names of their own
    carry = with_running(totals.drop("_rows"), keys, at, chunk, **given)
    part = [*keys, at]
    carry = carry.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in given])).select(*[F.col(c).alias(f"_k_{c}") for c in part], *given)
    d = df.withColumn(at, _chunk_of(order, width)).withColumns({f"_l_{n}": _local(r, order, part) for n, r in cols.items()})
    d = d.join(carry, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part]), "left")
    return d.select(*kept, *[_merge(r, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, r in cols.items()])


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, chunk: int = CHUNK) -> DataFrame:
    """Dense 1-based position within ``keys`` for rows that have no ordinal yet; ``order`` begins with a number.

    Long keys are cut by that number, wide enough for about ``chunk`` rows: such chunks follow one another in any order that begins with it. Rows are numbered
    inside a chunk and moved by the rows of the chunks before it.
    """
    width = width_for(df, keys, order[0], chunk)
    if width is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    d = df.withColumn("_chunk", _chunk_of(order[0], width))
    counts = materialize(d.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n")))
    before = with_running(counts, keys, "_chunk", chunk, _before=running_sum(F.col("_n"), inclusive=False))
    before = before.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "_chunk")], "_before")
    numbered = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, "_chunk")])
    return numbered.join(before, same).select(*df.columns, (F.col("_rn") + F.col("_before")).cast("int").alias(name))


def renumber(df: DataFrame, keys: Sequence[str], order: str, name: str, width: int | None = UNKNOWN) -> DataFrame:
    """Close the gaps of an ordinal after rows were removed or inserted."""
    out = with_running(df, keys, order, width=width, _pos=running_sum(F.lit(1)))
    return out.withColumn(name, F.col("_pos").cast("int")).drop("_pos")
