"""The bundle source: what is read, what is left unread, and the stream that takes each document once."""

import zipfile

import pytest
from pyspark.sql import functions as F

from pageledger.sources import bundles as B
from pageledger.streaming import ingest as ST


def put(path, members, spoil=()):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    raw = path.read_bytes()
    for data in spoil:  # the member's bytes no longer match its checksum
        raw = raw.replace(data, bytes(len(data)), 1)
    path.write_bytes(raw)


@pytest.fixture
def folder(tmp_path):
    manifest = '{"pages": [{"page_number": 10, "image": {"dimensions": {"width": 3, "height": 4}}}, {"page_number": 11, "image": null}]}'
    put(tmp_path / "doc.pdf", {"p2.txt": "two", "10.txt": b"ten\xff", "10.jpeg": b"image of ten", "11.txt": "eleven!", "manifest.json": manifest}, spoil=(b"image of ten", b"eleven!"))
    put(tmp_path / "odd.pdf", {"1.txt": "one", "manifest.json": "[not an object"})
    (tmp_path / "real.pdf").write_bytes(b"%PDF")
    return tmp_path


TEXT = "doc_id string, page_num int, text string"


def test_only_what_is_asked_for_is_read(spark, folder):
    path = f"file://{folder}"
    pages = B.read_page_bundles(spark, path, TEXT)
    below = B.read_page_bundles(spark, path, TEXT, lastPage="10")
    assert sorted(map(tuple, below.collect())) == [("doc", 2, "two"), ("doc", 10, "ten"), ("odd", 1, "one")]
    with pytest.raises(Exception, match="Bad CRC-32"):
        pages.collect()  # page 11 is spoilt, and so is the image of page 10
    with pytest.raises(Exception, match="Bad CRC-32"):
        B.read_page_bundles(spark, path, lastPage="10").collect()
    assert [tuple(r) for r in B.read_page_bundles(spark, path, lastPage="2", docs='["doc", "x"]').collect()] == [("doc", 2, "two", None, 0, 0)]
    assert [tuple(r) for r in B.read_page_bundles(spark, path, TEXT, docs='["odd"]').collect()] == [("odd", 1, "one")]
    sized = B.read_page_bundles(spark, path, "page_num int, width int, height int")
    assert sorted(map(tuple, sized.collect())) == [(1, 0, 0), (2, 0, 0), (10, 3, 4), (11, 0, 0)]


def test_large_bundles_are_dealt_as_ranges(spark, tmp_path):
    pages = spark.range(1, 41).select(F.lit("big").alias("doc_id"), F.col("id").alias("page_num"), F.expr("repeat(uuid(), 50)").alias("text"), F.lit(None).cast("binary").alias("image"), F.lit(None).alias("width"), F.lit(None).alias("height"))
    path = f"file://{tmp_path}"
    assert [tuple(r) for r in B.write_page_bundles(pages, path).collect()] == [("big", 40)]
    read = B.read_page_bundles(spark, path, TEXT, bytesPerPartition="1000")
    assert read.rdd.getNumPartitions() > 3
    assert [r.page_num for r in read.orderBy("page_num").collect()] == list(range(1, 41))


def test_broken_bundles(spark, tmp_path):
    (tmp_path / "cut.pdf").write_bytes(b"PK\x03\x04 cut short")
    put(tmp_path / "ok.pdf", {"1.txt": "one"})
    with pytest.raises(Exception, match="not a zip"):
        B.read_page_bundles(spark, f"file://{tmp_path}", TEXT).collect()
    assert [tuple(r) for r in B.read_page_bundles(spark, f"file://{tmp_path}", TEXT, broken="skip").collect()] == [("ok", 1, "one")]


def test_documents_are_taken_once(spark, tmp_path):
    landing, checkpoint, seen = tmp_path / "in", f"file://{tmp_path}/state", []
    (landing / "later").mkdir(parents=True)
    put(landing / "a.pdf", {"1.txt": "first"})
    (landing / "b.pdf").write_bytes(b"PK\x03\x04 cut short")

    def take(fail=False):
        def handle(pages, n):
            if fail:
                raise RuntimeError("the batch plan failed")
            seen.extend(map(tuple, pages.select("doc_id", "text").collect()))

        ST.ingest_stream(spark, f"file://{landing}", checkpoint, handle).awaitTermination()

    with pytest.raises(Exception, match="the batch plan failed"):
        take(fail=True)
    late = ST.document_steps(spark, checkpoint, "0 seconds")
    assert {r.doc_id: (r.status, r.error) for r in late.collect()} == {"a": ("failed", "no outcome in time"), "b": ("failed", "no outcome in time")}
    take()  # the failed batch is repeated
    take()
    put(landing / "later" / "a.pdf", {"1.txt": "second"})
    put(landing / "later" / "b.pdf", {"1.txt": "mended"})
    take()
    take()
    assert sorted(seen) == [("a", "first"), ("b", "mended")]
    assert {r.doc_id: (r.status, r.n_pages) for r in ST.document_steps(spark, checkpoint).collect()} == {"a": ("recorded", 1), "b": ("recorded", 1)}
