"""Sinks: cells, reply cache, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageledger.functions.text import filled


def safe_name(c: Column) -> Column:
    return F.translate(c, "/ ", "__")


def workbook_names(cells: DataFrame) -> DataFrame:
    """Adds ``workbook``, ``consolidated`` and ``sheet`` to ``cells(extraction_id, machine, variant, …)``.

    The variant part is left out where it equals the machine; sheet titles have 31 characters.
    """
    machine, variant = safe_name(F.col("machine")), safe_name(F.coalesce("variant", F.lit("")))
    prefix = F.concat(F.col("extraction_id"), F.lit("_"), machine)
    own = F.when((variant == "") | (variant == machine), prefix).otherwise(F.concat(prefix, F.lit("_"), variant))
    return cells.withColumns(
        {
            "workbook": F.concat(own, F.lit(".xlsx")), "consolidated": F.concat(prefix, F.lit("_All_CatID.xlsx")),
            "sheet": F.left(F.when(filled(F.col("variant")), F.col("variant")).otherwise(F.col("machine")), F.lit(31)),
        }
    )


def family_names(families: DataFrame) -> DataFrame:
    """Workbook of a family and sheet title of a model."""
    return families.withColumns(
        {
            "workbook": F.concat(F.regexp_replace("label", r"[^\p{L}\p{N}_\-]", "_"), F.lit(".xlsx")),
            "sheet": F.left(F.regexp_replace("code", r"[\\/*?:\[\]]", "_"), F.lit(31)),
        }
    )


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells partitioned by run; the workbook stays a column, so no run makes thousands of tiny partitions. Runs that are written again
    replace what they wrote before, others stay."""
    workbook_names(cells).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("extraction_id").parquet(path)


WORKBOOK_ROWS = "extraction_id string, workbook string, sheet string, row_no long, col_no int, value string"


def workbook_rows(cells: DataFrame) -> DataFrame:
    """Each cell twice: in its variant's own workbook, and on its variant's sheet of the machine's consolidated workbook."""
    each = F.explode(F.array(F.col("workbook"), F.col("consolidated")))
    return workbook_names(cells).select("extraction_id", each.alias("workbook"), "sheet", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("int").alias("col_no"), "value")


def response_cache(replies: DataFrame, families: DataFrame) -> DataFrame:
    """Replies enriched with label, title list and page range, so that a replay needs nothing else.

    ``replies(family, tables)`` with the tables as JSON text, ``families(family, label, title_submachines, first_page, last_page)``.
    """
    joined = replies.join(families, "family")
    head = F.to_json(
        F.struct(F.col("label").alias("family_label"), "title_submachines", F.array("first_page", "last_page").alias("page_range")), {"ignoreNullFields": "false"}
    )
    body = F.concat(F.left(head, F.length(head) - 1), F.lit(', "tables": '), F.coalesce("tables", F.lit("[]")), F.lit("}"))
    return joined.select("family", body.alias("body"))


def write_response_cache(cache: DataFrame, path: str, mode: str = "overwrite") -> None:
    cache.write.mode(mode).parquet(path)


def run_records(runs: DataFrame) -> DataFrame:
    """Status of a run: ``failed`` with an error, else ``completed`` with any output file, else ``no_output``."""
    error = filled(F.col("error")) if "error" in runs.columns else F.lit(False)
    return runs.withColumn("status", F.when(error, "failed").when(F.size("files") > 0, "completed").otherwise("no_output"))


def write_run(runs: DataFrame, path: str) -> None:
    """Append the records of runs that are not recorded yet, so a repeated write adds nothing."""
    spark = runs.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        runs = runs.join(spark.read.parquet(path).select("extraction_id"), "extraction_id", "left_anti")
    run_records(runs).write.mode("append").parquet(path)
