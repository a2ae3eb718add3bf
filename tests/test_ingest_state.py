"""The state of documents has no more partitions than the session has cores, and the session keeps its own number."""

import os
import zipfile

from pageledger.streaming import ingest as ST


def test_few_state_partitions(spark, tmp_path):
    landing, checkpoint = tmp_path / "landing", tmp_path / "checkpoint"
    landing.mkdir()
    for d in range(3):
        with zipfile.ZipFile(landing / f"d{d}.pdf", "w") as z:
            z.writestr("1.txt", f"page of {d}")
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", cores + 5)
    try:
        for _ in range(2):  # outcomes come back with the next batch
            ST.ingest_stream(spark, f"file://{landing}", f"file://{checkpoint}", ST.append_pages(f"file://{tmp_path}/pages")).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(cores + 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in os.listdir(checkpoint / "state" / "0") if p.isdigit()]) == cores
    assert {(r.doc_id, r.status, r.n_pages) for r in ST.document_steps(spark, f"file://{checkpoint}").collect()} == {(f"d{d}", "recorded", 1) for d in range(3)}
