"""Documents and runs that arrive one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pageledger.session import materialize
from pageledger.sources.bundles import unpack_bundles

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
OUTCOMES = "doc_id string, status string, n_pages long, error string"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RECEIVED, RECORDED, FAILED = "received", "recorded", "failed"
STEPS = "doc_id string, status string, path string, n_pages long, error string"


class DocumentSteps(StatefulProcessor):
    """What has become of a document: received, then recorded or failed. Its first bundle alone is taken, also when others land later or after a restart; a failed document may be
    sent once more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.step = handle.getValueState("step", "status string, path string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events = sorted(rows, key=lambda r: (r.status is None, r.path or ""))  # outcomes first: they belong to what was received before
        for event in events:
            status, path = self.step.get() if self.step.exists() else (None, None)
            if event.status is not None and status == RECEIVED:
                self.step.update((event.status, path))
                yield Row(doc_id=key[0], status=event.status, path=path, n_pages=event.n_pages, error=event.error)
            elif event.status is None and (status is None or (status == FAILED and event.path != path)):
                self.step.update((RECEIVED, event.path))
                yield Row(doc_id=key[0], status=RECEIVED, path=event.path, n_pages=None, error=None)

    def close(self) -> None:
        pass


def document_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def ingest_stream(
    spark: SparkSession, landing: str, checkpoint: str, handle: Callable[[DataFrame, int], None], max_files: int = 1000
) -> StreamingQuery:
    """Take every document of the landing folder and its sub-folders once: ``handle(pages, batch_id)`` runs the batch plan on each batch's pages.

    The steps that documents take are kept in keyed state and stored under ``<checkpoint>/steps`` (see ``document_steps``). What became of a batch's documents comes back to the state
    as a second input, from ``<checkpoint>/outcomes``, with the next batch. A batch may be repeated after a failure, so ``handle`` should write under its batch id, as the stream does itself.
    A bundle that cannot be read, or has no pages, fails alone.
    """
    spark.conf.set(*STATE_STORE)
    outcomes, steps = f"{checkpoint}/outcomes", f"{checkpoint}/steps"
    target = spark._jvm.org.apache.hadoop.fs.Path(outcomes)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).load(landing)
    nothing = {"status": "string", "n_pages": "long", "error": "string"}
    landed = files.select(document_name(F.col("path")).alias("doc_id"), "path", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    known = spark.readStream.schema(OUTCOMES).option("recursiveFileLookup", True).parquet(outcomes).select("doc_id", F.lit(None).cast("string").alias("path"), *nothing)
    taken = landed.unionByName(known).groupBy("doc_id").transformWithState(DocumentSteps(), STEPS, "Update", "None")

    def each(batch: DataFrame, n: int) -> None:
        # read several times below, and state must not move again
        batch.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{steps}/batch={n}")
        now = spark.read.schema(STEPS).parquet(f"{steps}/batch={n}")
        received = now.where(F.col("status") == RECEIVED).select("doc_id", "path")
        if received.isEmpty():
            return
        pages = materialize(unpack_bundles(received))
        found = pages.groupBy("doc_id").agg(F.count("page_num").alias("n_pages"), F.max("error").alias("error"))
        found = received.select("doc_id").join(found, "doc_id", "left")
        error = F.when(F.col("n_pages").isNull(), "no pages").otherwise(F.col("error"))
        found = found.select("doc_id", F.when(error.isNull(), RECORDED).otherwise(FAILED).alias("status"), F.when(error.isNull(), F.col("n_pages")).alias("n_pages"), error.alias("error"))
        found = materialize(found)
        handle(pages.join(found.where(F.col("status") == RECORDED).select("doc_id"), "doc_id", "left_semi").drop("path", "error"), n)
        found.write.mode("overwrite").parquet(f"{outcomes}/batch={n}")

    return start_narrow(spark, taken.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True))


def start_narrow(spark: SparkSession, stream: DataStreamWriter) -> StreamingQuery:
    """Start a stream whose state has no more partitions than the session has cores: each partition starts a Python worker and opens its store in every batch, however few rows come.

    A stream that was started before keeps the number of partitions in its checkpoint.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        return stream.start()  # takes the settings of this moment
    finally:
        spark.conf.set(name, before)


def document_steps(spark: SparkSession, checkpoint: str, wait: str = "1 hour") -> DataFrame:
    """The latest step of each document. One that was received longer than ``wait`` ago and has had no outcome since has failed."""
    steps = spark.read.schema(f"{STEPS}, at timestamp, batch long").parquet(f"{checkpoint}/steps")
    last = F.max_by(F.struct("status", "n_pages", "error", "at"), F.struct("batch", F.col("status") != RECEIVED)).alias("s")
    late = (F.col("status") == RECEIVED) & (F.col("at") < F.current_timestamp() - F.expr(f"INTERVAL {wait}"))
    error = F.when(late, "no outcome in time").otherwise(F.col("error"))
    return steps.groupBy("doc_id").agg(last).select("doc_id", "s.*").select("doc_id", F.when(late, FAILED).otherwise(F.col("status")).alias("status"), "n_pages", error.alias("error"))


def append_pages(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that stores pages; repeating a batch overwrites its own folder only."""
    return lambda pages, n: pages.write.mode("overwrite").parquet(f"{path}/batch={n}")


CHANGES = "extraction_id string, num_machines int, dropped boolean, change_no long"


def run_totals_stream(changes: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Keep the number of runs and machines current under ``changes(extraction_id, num_machines, dropped, change_no)``: records, records written again, and deletions.

    The state holds a run's newest change, a built-in aggregate; of equal change numbers the one that came first counts, so a change that is not newer than the last one seen changes
    nothing, and a dropped run does not come back by a late replay. Each batch stores the records of the runs it names under its own number, so a batch that is repeated replaces its own
    rows; ``run_totals_table`` adds up the last record of each run.
    """
    changes.sparkSession.conf.set(*STATE_STORE)
    came = -F.unix_micros(F.current_timestamp())  # the time of the batch
    kept = F.when(~F.coalesce("dropped", F.lit(False)), F.coalesce("num_machines", F.lit(0)).cast("long"))
    timed = changes.select("extraction_id", F.struct("change_no", came.alias("came"), kept.alias("n_machines")).alias("c"))
    newest = timed.groupBy("extraction_id").agg(F.max("c").alias("c"))

    def each(batch: DataFrame, n: int) -> None:
        batch.select("extraction_id", "c.n_machines").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return newest.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_totals_table(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("extraction_id string, n_machines long, batch long").parquet(path)
    last = rows.groupBy("extraction_id").agg(F.max(F.struct("batch", "n_machines")).alias("r")).select("r.n_machines")
    return last.agg(F.count("n_machines").alias("n_runs"), F.coalesce(F.sum("n_machines"), F.lit(0)).alias("n_machines"))
