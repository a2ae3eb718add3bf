"""Totals of runs that are recorded, recorded again, dropped and replayed."""

from pageledger.streaming import ingest as ST


def test_totals_follow_the_newest_change_of_each_run(spark, tmp_path):
    path, checkpoint, totals = (str(tmp_path / n) for n in ("changes", "checkpoint", "totals"))
    batches = (
        [("a", 2, False, 1), ("b", 3, False, 1), ("c", None, False, 1)],
        [("a", 7, False, 2), ("b", 3, True, 2)],
        [("a", 2, False, 1), ("b", 3, False, 1), ("a", 9, False, 2)],  # old ones, and another one with a number seen already
    )
    for rows, want in zip(batches, ((3, 5), (2, 7), (2, 7))):
        spark.createDataFrame(rows, ST.CHANGES).coalesce(1).write.mode("append").parquet(path)
        ST.run_totals_stream(spark.readStream.schema(ST.CHANGES).parquet(path), checkpoint, totals).awaitTermination()
        assert tuple(ST.run_totals_table(spark, totals).first()) == want
    assert "extraction_id" in spark.read.parquet(totals).columns  # a batch stores its runs' records, which no per-key Python makes
