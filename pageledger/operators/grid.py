"""Ragged text tables to long parameters.

A table row is one array of cells, so splitting, filling and picking columns happen inside the row. Only finding a grid's
header and letting later rows win need an aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import filled, once, plain_spaces, strip

GRID = ("doc_id", "page_num")
ALNUM = r"[^\p{L}\p{N}_]"


def _split_row(line: Column) -> Column:
    """Cells of a line in plain spaces: split at two or more spaces, or at single ones if there are no wider gaps."""
    gap = "\x01"
    return F.when(F.contains(line, F.lit("  ")), F.split(F.regexp_replace(line, " {2,}", gap), gap)).otherwise(F.split(line, " "))


def _is_table_line(line: Column) -> Column:
    return line.rlike(r"\d\D*\d") & (line.rlike("[^ ] +[^ ]+ +[^ ]") | line.rlike(r"(?i)\d+ *[-to]+ *\d+"))


def grid_rows(pages: DataFrame, keys: Sequence[str] = GRID) -> DataFrame:
    """Lines that look like table rows as cell arrays; a page needs two of them to be a grid."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), plain_spaces), _is_table_line)
    rows = F.filter(F.transform(lines, _split_row), lambda r: F.size(r) >= 2)
    return (
        once(pages.select(*keys, "text"), rows, "_rows")
        .filter(F.size("_rows") >= 2)
        .select(*keys, F.posexplode("_rows").alias("pos", "cells"))
        .select(*keys, (F.col("pos") + 1).alias("row_idx"), "cells")
    )


def grid_cells(rows: DataFrame, keys: Sequence[str] = GRID) -> DataFrame:
    return rows.select(*keys, "row_idx", F.posexplode("cells").alias("col_idx", "value"))


def rows_from_cells(cells: DataFrame, keys: Sequence[str] = GRID) -> DataFrame:
    """Long cells back to one array per row, in column order."""
    boxed = F.array_sort(F.collect_list(F.struct("col_idx", "value")))
    return cells.groupBy(*keys, "row_idx").agg(F.transform(boxed, lambda x: x["value"]).alias("cells"))


def _bare(cell: Column) -> Column:
    return F.regexp_replace(F.upper(cell), ALNUM, "")


def _looks_like_variant(cell: Column) -> Column:
    bare = _bare(cell)
    return (
        F.length(bare).between(3, 12) & bare.rlike("[A-Z]") & bare.rlike(r"\d") & ~bare.isin(*P.GENERIC_HEADER_WORDS)
    )


def _with_known(rows: DataFrame, known: DataFrame | None, by: Sequence[str]) -> DataFrame:
    if known is None:
        return rows.withColumn("_known", F.array().cast("array<string>"))
    # the variants of one document are capped at eight
    listed = known.groupBy(*by).agg(F.collect_set(_bare(F.col("variant"))).alias("_known"))
    return rows.join(listed, list(by), "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))


def header_row(
    rows: DataFrame, known: DataFrame | None = None, keys: Sequence[str] = GRID, by: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Per grid the first row with a known variant, or with two cells that look like variants."""
    with_known = _with_known(rows, known, by)
    bare = F.filter(F.transform("cells", _bare), lambda x: x != "")
    is_header = F.arrays_overlap(bare, F.col("_known")) | (F.size(F.filter("cells", _looks_like_variant)) >= 2)
    first = with_known.filter(is_header).groupBy(*keys).agg(F.min(F.struct("row_idx", "cells", "_known")).alias("h"))
    return first.select(*keys, F.col("h.row_idx").alias("row_idx"), F.col("h.cells").alias("cells"), F.col("h._known").alias("known"))


def fill_right(cells: Column, start: Column) -> Column:
    """Empty cells take the last filled value to their left, from index ``start`` (0-based) on."""

    def value(x: Column, i: Column) -> Column:
        seen = F.filter(F.slice(cells, start + 1, F.greatest(i - start + 1, F.lit(0))), lambda y: strip(y) != "")
        last = strip(F.try_element_at(seen, F.lit(-1)))
        return F.when((i >= start) & (strip(x) == ""), F.coalesce(last, x)).otherwise(x)

    return F.transform(cells, value)


def forward_fill(rows: DataFrame, start: int | Column = 1) -> DataFrame:
    return rows.withColumn("cells", fill_right(F.col("cells"), F.lit(start) if isinstance(start, int) else start))


def variant_params(
    rows: DataFrame, known: DataFrame | None = None, keys: Sequence[str] = GRID, by: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """(keys, variant, param, value): each row's filled value under each variant column; the last row wins."""
    heads = header_row(rows, known, keys, by).filter(F.size("cells") >= 2)
    columns = F.filter(
        F.transform("cells", lambda c, i: F.struct(c.alias("name"), i.alias("idx"))),
        lambda s: (s["idx"] > 0) & (_looks_like_variant(s["name"]) | F.array_contains("known", _bare(s["name"]))),
    )
    heads = heads.select(*keys, F.col("cells").alias("_head"), columns.alias("_cols")).filter(F.size("_cols") > 0)
    start = F.array_min(F.transform("_cols", lambda s: s["idx"]))
    data = rows.join(heads, list(keys)).filter((F.col("cells") != F.col("_head")) & (F.size("cells") >= 2))
    data = data.withColumn("_start", start).withColumn("_filled", fill_right(F.col("cells"), F.col("_start")))
    # a repeated header name means its first column
    entries = F.transform(
        "_cols",
        lambda s: F.struct(
            F.upper(strip(s["name"])).alias("variant"), s["idx"].alias("idx"),
            strip(F.get("_filled", F.array_min(F.transform(F.filter("_cols", lambda o: o["name"] == s["name"]), lambda o: o["idx"])))).alias("value"),
        ),
    )
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(P.PARAMETER_NAMES.items())])
    label = F.upper(strip(F.get("cells", 0)))
    long = data.select(*keys, "row_idx", F.coalesce(F.try_element_at(names, label), label).alias("param"), F.explode(entries).alias("e"))
    return (
        long.select(*keys, "row_idx", "param", "e.*")
        .filter(filled(F.col("value")) & filled(F.col("variant")) & ~F.upper("value").isin(*P.NOT_APPLICABLE))
        .groupBy(*keys, "variant", "param")
        .agg(F.max_by("value", F.struct("row_idx", "idx")).alias("value"))
    )


def combine_grids(params: DataFrame, order: Sequence[str] = ("page_num",), by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Several grids of a document: the later one overrides per (variant, param)."""
    return params.groupBy(*by, "variant", "param").agg(F.max_by("value", F.struct(*order)).alias("value"))


def fill_weak(specs: DataFrame, params: DataFrame, fields: Sequence[str], on: Sequence[str] = ("variant",)) -> DataFrame:
    """Fill absent or weak spec values from table parameters; variants without specs are not added."""
    wide = params.filter(F.col("param").isin(*fields)).groupBy(*on).agg(
        *[F.max(F.when(F.col("param") == f, F.col("value"))).alias(f"_t_{f}") for f in fields]
    )
    weak = lambda c: ~filled(c) | c.isin(*P.WEAK_VALUES)
    out = specs.join(wide, list(on), "left")
    for f in fields:
        out = out.withColumn(f, F.when(weak(F.col(f)), F.coalesce(f"_t_{f}", f)).otherwise(F.col(f)))
    return out.select(*specs.columns)
