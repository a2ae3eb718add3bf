"""A table of rows that belong to runs, with commits.

``df.write.format("runstore")`` writes part files that nobody sees until the job commits: the driver then names them in a new manifest, ``<path>/manifests/<n>.json``, which is created only if
no one else has created that number (else the next one is tried). A job that fails names nothing, so the manifests before it stay what they were; two jobs at once both get a number.

A run that is written again replaces its rows, a run that is dropped (``drop_runs``) has none: of each run only the rows of its last commit count. ``purge`` writes what counts into new
files under a manifest that outdates all before it, and then deletes the old files; it gives up if another commit comes in between.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

RUN, DROPPED = "extraction_id", "_dropped"


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


def _manifests(path: str) -> list[tuple[int, dict]]:
    """All manifests from the last one that outdates those before it, oldest first."""
    fs, base = pafs.FileSystem.from_uri(path)
    folder = fs.get_file_info(pafs.FileSelector(f"{base}/manifests", allow_not_found=True))
    out = []
    for name in sorted((f.path for f in folder if re.search(r"/\d+\.json$", f.path)), reverse=True):
        with fs.open_input_stream(name) as f:
            out.append((int(name.rsplit("/", 1)[-1].split(".")[0]), json.loads(f.read())))
        if out[-1][1]["reset"]:
            break
    return out[::-1]


def _claim(path: str, number: int, manifest: dict) -> bool:
    """Publish a manifest under its number unless the number is taken. It is written under a name of its own first, so it is never seen in part."""
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(f"{base}/manifests")
    if isinstance(fs, pafs.LocalFileSystem):
        import os

        draft = f"{base}/manifests/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(manifest).encode())
        try:
            os.link(draft, f"{base}/manifests/{number:012d}.json")  # fails if it is there
        except FileExistsError:
            return False
        finally:
            fs.delete_file(draft)
        return True
    draft, target = f"{base}/manifests/.{uuid.uuid4().hex}", f"{base}/manifests/{number:012d}.json"
    with fs.open_output_stream(draft) as f:
        f.write(json.dumps(manifest).encode())
    try:
        fs.move(draft, target)  # HDFS does not move onto a file that is there
    except OSError:
        fs.delete_file(draft)
        return False
    return True


class RunStoreWriter(DataSourceArrowWriter):
    def __init__(self, path: str, based_on: int | None):
        self.path, self.based_on, self.job = path, based_on, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{base}/data")
        out, name = None, f"{self.job}-{uuid.uuid4().hex}.parquet"
        draft, target = f"{base}/data/.{name}", f"{base}/data/{name}"
        try:
            for rows in iterator:
                if out is None:
                    out = pq.ParquetWriter(draft, rows.schema, filesystem=fs)
                out.write_batch(rows)
            if out is None:
                return Written()
            out.close()
            if not self._aborted(fs, base):
                fs.move(draft, target)
        finally:
            self._remove(fs, draft)
        # the job may have been aborted in between, and has looked for files already
        if self._aborted(fs, base):
            self._remove(fs, target)
            raise RuntimeError("the job was aborted")
        return Written([name])

    def _aborted(self, fs: pafs.FileSystem, base: str) -> bool:
        return fs.get_file_info(f"{base}/data/.{self.job}.aborted").type != pafs.FileType.NotFound

    def _remove(self, fs: pafs.FileSystem, path: str) -> None:
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_file(path)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        if self.based_on is not None:
            if not _claim(self.path, self.based_on + 1, {"add": files, "reset": True}):
                raise RuntimeError("another commit came in between")
            return
        known = _manifests(self.path)
        number = known[-1][0] + 1 if known else 1
        while not _claim(self.path, number, {"add": files, "reset": False}):
            number += 1

    def abort(self, messages: list[Written | None]) -> None:
        """Other tasks may still run: a mark tells them to leave nothing, then what is there is deleted."""
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{base}/data")
        with fs.open_output_stream(f"{base}/data/.{self.job}.aborted") as f:
            f.write(b"")
        for f in fs.get_file_info(pafs.FileSelector(f"{base}/data")):
            if f.base_name.startswith(self.job):
                self._remove(fs, f.path)


class RunStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runstore"

    def writer(self, schema: StructType, overwrite: bool) -> RunStoreWriter:
        based_on = self.options.get("basedOn")
        return RunStoreWriter(self.options["path"], None if based_on is None else int(based_on))


def write_runs_rows(rows: DataFrame, path: str, **options: str) -> None:
    """Commit ``rows``: they replace what their runs had before."""
    rows.sparkSession.dataSource.register(RunStore)
    flagged = rows if DROPPED in rows.columns else rows.withColumn(DROPPED, F.lit(False))
    flagged.write.format("runstore").options(**options).mode("append").save(path)


def drop_runs(runs: DataFrame, path: str, schema: str) -> None:
    """Commit the deletion of ``runs(extraction_id)`` from the store whose rows have ``schema``."""
    columns = [F.col(RUN) if f.name == RUN else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    write_runs_rows(runs.select(*columns, F.lit(True).alias(DROPPED)), path)


def _committed(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """All rows that some manifest names, with the number of their commit, and the last number."""
    known = _manifests(path)
    named = [(f, n) for n, m in known for f in m["add"]]
    if not named:
        return spark.createDataFrame([], f"{schema}, {DROPPED} boolean, _file string, _commit long"), known[-1][0] if known else 0
    files = spark.createDataFrame(named, "_file string, _commit long")
    rows = spark.read.schema(f"{schema}, {DROPPED} boolean").parquet(*[f"{path}/data/{f}" for f, _ in named]).select("*", F.col("_metadata.file_name").alias("_file"))
    return rows.join(files, "_file"), known[-1][0]


def read_runs_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that count: those of each run's last commit, unless that dropped the run."""
    rows, _ = _committed(spark, path, schema)
    last = rows.groupBy(RUN).agg(F.max("_commit").alias("_commit"))
    return rows.join(last, [RUN, "_commit"]).where(f"NOT {DROPPED}").select(*StructType.fromDDL(schema).names)


def purge(spark: SparkSession, path: str, schema: str) -> None:
    """Leave only the files of rows that count."""
    known = _manifests(path)
    if not known:
        return
    old = [f for _, m in known for f in m["add"]]
    write_runs_rows(read_runs_rows(spark, path, schema), path, basedOn=str(known[-1][0]))
    fs, base = pafs.FileSystem.from_uri(path)
    for f in old:
        fs.delete_file(f"{base}/data/{f}")
