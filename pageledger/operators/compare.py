"""Cell-by-cell comparison of a generated sheet with its reference.

``cells(sheet, row_no, col_no, value)``, one row per cell. The join key is the cell itself, so a sheet of any size spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import strip

CELL = ["sheet", "row_no", "col_no"]


def sheets(ref: DataFrame, gen: DataFrame) -> DataFrame:
    """All sheets with the side(s) they exist on."""
    sides = ref.select("sheet", F.lit(1).alias("side")).union(gen.select("sheet", F.lit(2)))
    return sides.groupBy("sheet").agg(
        F.bool_or(F.col("side") == 1).alias("in_ref"), F.bool_or(F.col("side") == 2).alias("in_gen")
    )


def _verdicts(ref: DataFrame, gen: DataFrame) -> DataFrame:
    def side(df, name):
        return df.select(*CELL, strip(F.col("value").cast("string")).alias(name)).filter(F.length(name) > 0)

    verdict = (
        F.when(F.col("ref_value").isNull(), "extra").when(F.col("gen_value").isNull(), "missing")
        .when(F.col("ref_value") == F.col("gen_value"), "correct").otherwise("wrong")
    )
    return side(ref, "ref_value").join(side(gen, "gen_value"), CELL, "full").withColumn("verdict", verdict)


def compare_cells(ref: DataFrame, gen: DataFrame) -> DataFrame:
    """Trimmed text per cell of the sheets both sides have: correct, wrong, missing or extra."""
    both = sheets(ref, gen).filter("in_ref AND in_gen").select("sheet")
    return _verdicts(ref, gen).join(both, "sheet", "left_semi").select(*CELL, "ref_value", "gen_value", "verdict")


def accuracy(ref: DataFrame, gen: DataFrame, threshold: float = P.PASS_PERCENT) -> DataFrame:
    """Per sheet: counts, percent of the non-empty reference cells that are correct, and PASS, FAIL or an error."""
    both = ref.select(*CELL, F.col("value").cast("string").alias("value"), F.lit(False).alias("is_gen")).union(gen.select(*CELL, F.col("value").cast("string"), F.lit(True)))
    return accuracy_of(both.repartition(*CELL), threshold)


def accuracy_of(cells: DataFrame, threshold: float = P.PASS_PERCENT) -> DataFrame:
    """``accuracy`` of cells that tell by ``is_gen`` which side they are of.

    Cells are counted by value, then by place, then by sheet: cells that lie together by sheet, or by place, are not dealt out again. What stands twice at a place is compared
    with each of the other side, as a join would; a place that is not known meets nothing.
    """
    text = strip(F.col("value"))
    by_value = cells.select(*CELL, F.when(F.length(text) > 0, text).alias("v"), "is_gen").groupBy(*CELL, "v").agg(
        F.count_if(~F.col("is_gen")).alias("r"), F.count_if("is_gen").alias("g")
    )
    some = lambda c: F.sum(F.when(F.col("v").isNotNull(), c).otherwise(0))
    by_cell = by_value.groupBy(*CELL).agg(
        some(F.col("r")).alias("r"), some(F.col("g")).alias("g"), some(F.col("r") * F.col("g")).alias("same"), F.bool_or(F.col("r") > 0).alias("in_ref"), F.bool_or(F.col("g") > 0).alias("in_gen")
    )
    r, g, meets = F.col("r"), F.col("g"), F.col("row_no").isNotNull() & F.col("col_no").isNotNull()
    kinds = {
        "correct": F.when(meets, F.col("same")), "wrong": F.when(meets, r * g - F.col("same")), "missing": F.when(~meets | (g == 0), r), "extra": F.when(~meets | (r == 0), g),
    }
    counts = by_cell.groupBy("sheet").agg(*[F.sum(c).alias(k) for k, c in kinds.items()], F.bool_or("in_ref").alias("in_ref"), F.bool_or("in_gen").alias("in_gen"))
    n = {k: F.when(F.col("sheet").isNotNull(), F.coalesce(k, F.lit(0))).otherwise(0) for k in kinds}
    total = n["correct"] + n["wrong"] + n["missing"]
    percent = F.when(total > 0, n["correct"] / total * 100).otherwise(0.0)
    status = (
        F.when(~F.col("in_ref"), "ERROR: not in reference").when(~F.col("in_gen"), "ERROR: not in generated")
        .when(percent >= threshold, "PASS").otherwise("FAIL")
    )
    ok = F.col("in_ref") & F.col("in_gen")
    return counts.select("sheet", *[F.when(ok, n[k]).alias(k) for k in kinds], F.when(ok, total).alias("total"), F.when(ok, percent).alias("percent"), status.alias("status"))


def diff_samples(diff: DataFrame) -> DataFrame:
    """The first wrong (50), missing (30) and extra (30) cells of each sheet in row-major order.

    The rank limit is pushed below the shuffle, so each task sends at most 50 rows per group.
    """
    w = Window.partitionBy("sheet", "verdict").orderBy("row_no", "col_no")
    limit = F.when(F.col("verdict") == "wrong", P.WRONG_SAMPLES).otherwise(P.MISSING_SAMPLES)
    return (
        diff.filter("verdict <> 'correct'")
        .withColumn("sample_no", F.row_number().over(w))
        .filter(F.col("sample_no") <= P.WRONG_SAMPLES)
        .filter(F.col("sample_no") <= limit)
    )
