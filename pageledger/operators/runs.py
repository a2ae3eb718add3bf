"""Run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def list_runs(runs: DataFrame) -> DataFrame:
    """Newest first; runs without a time stamp (failed ones) last."""
    return runs.orderBy(F.col("ts").desc_nulls_last())


def get_run(runs: DataFrame, extraction_id: str) -> DataFrame:
    return runs.filter(F.col("extraction_id") == extraction_id)


def run_files(runs: DataFrame) -> DataFrame:
    """(extraction_id, pos, filename) of the files that carry their run's id in front."""
    return runs.select("extraction_id", F.posexplode("files").alias("pos", "filename")).filter(
        F.startswith("filename", "extraction_id")
    )


def resolve_downloads(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Answer ``requests(extraction_id, filename)``: ok, forbidden (another run's file) or not_found."""
    known = run_files(runs).select("extraction_id", "filename", F.lit(True).alias("_known"))
    answer = (
        F.when(~F.startswith("filename", "extraction_id"), "forbidden").when(F.col("_known"), "ok").otherwise("not_found")
    )
    return requests.join(known, ["extraction_id", "filename"], "left").select("extraction_id", "filename", answer.alias("answer"))


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("n_runs"), F.coalesce(F.sum("num_machines"), F.lit(0)).alias("n_machines"))


def run_outputs(runs: DataFrame) -> DataFrame:
    """Per machine and variant of a run: the consolidated file and the variant's own file, first match in file order.

    Files and summary belong to one run, so all of it happens inside the row.
    """
    rows = runs.select("extraction_id", "files", F.explode_outer("machine_summary").alias("m"))
    rows = rows.select("extraction_id", "files", "m.machine", F.explode_outer("m.variants").alias("variant"))
    own = F.concat(F.lit("_"), F.col("machine"), F.lit("_"), F.col("variant"), F.lit(".xlsx"))
    tail = F.concat(F.lit("_"), F.col("variant"), F.lit(".xlsx"))
    whole = F.concat(F.lit("_"), F.col("machine"), F.lit("_All_CatID"))
    first = lambda test: F.get(F.filter("files", test), 0)
    return rows.select(
        "extraction_id", "machine", "variant",
        first(lambda f: F.contains(f, F.lit("_All_CatID"))).alias("run_file"),
        first(lambda f: F.contains(f, whole)).alias("machine_file"),
        first(lambda f: F.contains(f, own) | F.endswith(f, tail)).alias("variant_file"),
    )


def drop_runs(runs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The runs that stay; the caller overwrites the affected partitions with them."""
    return runs.join(dropped.select("extraction_id"), "extraction_id", "left_anti")
