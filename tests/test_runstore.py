"""Commits of run rows: failed jobs, jobs at once, runs written again and dropped."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pageledger.sources import runstore as RS

ROWS = "extraction_id string, n long"


def rows(spark, runs, n):
    return spark.createDataFrame([(r, n) for r in runs], ROWS)


def read(spark, path):
    return sorted(map(tuple, RS.read_runs_rows(spark, path, ROWS).collect()))


def test_last_commit_of_a_run_counts(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert read(spark, path) == []
    RS.write_runs_rows(rows(spark, "aabc", 1).repartition(3), path)
    RS.write_runs_rows(rows(spark, "bd", 2), path)
    assert read(spark, path) == [("a", 1), ("a", 1), ("b", 2), ("c", 1), ("d", 2)]
    RS.drop_runs(spark.createDataFrame([("a",), ("d",), ("unknown",)], "extraction_id string"), path, ROWS)
    assert read(spark, path) == [("b", 2), ("c", 1)]
    RS.write_runs_rows(rows(spark, "d", 3), path)
    RS.purge(spark, path, ROWS)
    assert read(spark, path) == [("b", 2), ("c", 1), ("d", 3)]
    stored = spark.read.parquet(f"{path}/data")
    assert sorted(r.n for r in stored.collect()) == [1, 2, 3]


def test_a_failed_job_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}"
    RS.write_runs_rows(rows(spark, "ab", 1), path)
    bad = spark.range(0, 100, 1, 4).select(F.lit("a").alias("extraction_id"), F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(Exception):
        RS.write_runs_rows(bad, path)
    assert read(spark, path) == [("a", 1), ("b", 1)]
    assert len(list((tmp_path / "data").glob("*.parquet"))) == len(RS._manifests(path)[0][1]["add"])


def test_jobs_at_once_all_count(spark, tmp_path):
    path = f"file://{tmp_path}"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: RS.write_runs_rows(rows(spark, [f"run{k}"], k), path), range(8)))
    assert read(spark, path) == [(f"run{k}", k) for k in range(8)]
    assert [n for n, _ in RS._manifests(path)] == list(range(1, 9))


def test_purge_gives_way_to_another_commit(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}"
    RS.write_runs_rows(rows(spark, "a", 1), path)
    found = RS.read_runs_rows

    def late(*args):
        out = found(*args)
        RS.write_runs_rows(rows(spark, "b", 2), path)
        return out

    monkeypatch.setattr(RS, "read_runs_rows", late)
    with pytest.raises(Exception, match="another commit"):
        RS.purge(spark, path, ROWS)
    monkeypatch.undo()
    assert read(spark, path) == [("a", 1), ("b", 2)]
