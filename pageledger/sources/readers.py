"""Sources: page folders, stored replies, run records, requests (page bundles: ``bundles``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageledger.functions.text import filled, strip

RUN = (
    "extraction_id string, original_filename string, num_pages int, num_machines int, machines array<string>, excel_files array<string>,"
    " machine_summary array<struct<machine:string,status:string,variants:array<string>,flags:map<string,struct<spec_flags:array<string>,step_flag_count:int>>>>,"
    " user_input map<string,array<string>>, status string, timestamp string"
)


def read_page_folders(spark: SparkSession, path: str) -> DataFrame:
    """Unpacked bundles ``<doc>/<n>.txt``: document and page number come from the file path."""
    raw = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("p"))
    name = F.regexp_extract("p", r"([^/]+)$", 1)
    number = F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    return raw.select(F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("doc_id"), number.alias("page_num"), F.col("value").alias("text"))


def read_model_responses(df: DataFrame) -> DataFrame:
    """Stored replies, kept as raw text. Empty ones are dropped."""
    return df.filter(filled(F.col("body")))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records (one JSON document per file); unreadable files are skipped."""
    raw = spark.read.schema(f"{RUN}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.filter("_corrupt_record IS NULL AND extraction_id IS NOT NULL").drop("_corrupt_record")


def read_requested(requests: DataFrame) -> DataFrame:
    """``requests(doc_id, body)`` holding {machine: [variants]} to (doc_id, machine, variant): trimmed, upper case, blanks dropped, a machine
    without variants gives one row with NULL. Invalid JSON is an error."""
    parsed = F.from_json(F.when(filled(F.col("body")), F.col("body")).otherwise("{}"), "map<string,array<string>>", {"mode": "FAILFAST"})
    clean = lambda c: F.upper(strip(c))
    rows = requests.select("doc_id", F.explode(F.map_entries(parsed)).alias("e")).select("doc_id", clean(F.col("e.key")).alias("machine"), "e.value")
    variants = F.filter(F.transform(F.coalesce("value", F.array().cast("array<string>")), clean), lambda v: v != "")
    return rows.filter("machine <> ''").select("doc_id", "machine", F.explode_outer(variants).alias("variant"))
