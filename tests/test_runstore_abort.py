"""A task that outlives its job's abort, or breaks, leaves no file."""

import pyarrow as pa
import pytest

from pageledger.sources.runstore import RunStoreWriter

BATCH = pa.RecordBatch.from_pylist([{"extraction_id": "a", "n": 1}])


def left(path):
    return sorted(f.name for f in (path / "data").iterdir() if f.name.endswith(".parquet"))


def test_a_task_that_ends_after_the_abort(tmp_path):
    writer = RunStoreWriter(f"file://{tmp_path}", None)

    def batches():
        yield BATCH
        writer.abort([])
        yield BATCH

    with pytest.raises(RuntimeError):
        writer.write(batches())
    assert left(tmp_path) == []


def test_a_task_that_breaks(tmp_path):
    writer = RunStoreWriter(f"file://{tmp_path}", None)

    def batches():
        yield BATCH
        raise ValueError("no")

    with pytest.raises(ValueError):
        writer.write(batches())
    assert left(tmp_path) == []
    assert left(tmp_path) != writer.write(iter([BATCH])).files == left(tmp_path)
