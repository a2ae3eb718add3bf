"""The corpus pipeline as a query; it needs corpus_pipeline.py, which the operators do without."""

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
ORACLES = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
