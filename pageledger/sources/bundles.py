"""Page bundles as a Spark data source, and their writer.

A bundle is a zip archive with a text file for each page, images beside them and a manifest with the images' sizes. ``spark.read.format("pagebundle")`` deals a folder of bundles
to tasks by size: small bundles together, a large one as several ranges of its pages. A task reads the archive's directory and then only the members it needs, one page after the
other: images are opened only if the schema asks for them, the manifest only for widths and heights, and pages out of the range wanted are not opened at
all. Documents that are not wanted are left out before any task starts.

Options: ``path``; ``firstPage`` and ``lastPage``; ``docs``, a JSON list of names; ``bytesPerPartition`` (64 MB); ``broken``, what to do with an archive that cannot be read: ``fail`` or
``skip``. Files that are no archive have no pages. Pages and documents are options, not pushed-down filters: a relation of this Spark version keeps the reader that has taken a query's
filters, and its next query without them would miss rows.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGES = "doc_id string, page_num int, text string, image binary, width int, height int"
MARK = b"PK\x03\x04"
BATCH_PAGES, BATCH_BYTES = 256, 8 << 20


def page_number(name: str) -> int:
    found = re.search(r"\d+", name)
    return int(found.group()) if found else 0


def doc_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def image_sizes(z: zipfile.ZipFile, names: list[str]) -> dict[int, dict]:
    """Width and height by page, from the first manifest; nothing from one that cannot be read."""
    manifest = next((n for n in names if "manifest" in n.lower() and n.endswith(".json")), None)
    try:
        listed = json.loads(z.read(manifest).decode("utf-8", "ignore")).get("pages", []) if manifest else []
        return {p["page_number"]: (p.get("image") or {}).get("dimensions") or {} for p in listed}
    except (ValueError, KeyError, AttributeError, TypeError):
        return {}


class BundleRange(InputPartition):
    """Parts of bundles for one task: path, which part, of how many."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(parts)
        self.parts = parts


class BundleReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.columns = schema, schema.names
        self.path, self.size, self.broken = options["path"], int(options.get("bytesPerPartition", 64 << 20)), options.get("broken", "fail")
        self.first, self.last = int(options.get("firstPage", 0)), int(options.get("lastPage", 1 << 62))
        self.docs = set(json.loads(options["docs"])) if "docs" in options else None

    def partitions(self) -> list[BundleRange]:
        fs, base = pafs.FileSystem.from_uri(self.path)
        files = [f for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file and not f.base_name.startswith((".", "_")) and (self.docs is None or doc_of(f.path) in self.docs)]
        out, held, size = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            k = max(1, -(-(f.size or 0) // self.size))
            if k > 1:
                out += [BundleRange([(f.path, i, k)]) for i in range(k)]
                continue
            if held and size + f.size > self.size:
                out.append(BundleRange(held))
                held, size = [], 0
            held.append((f.path, 0, 1))
            size += f.size
        return out + [BundleRange(held)] * bool(held) or [BundleRange([])]

    def rows(self, fs: pafs.FileSystem, path: str, part: int, of: int) -> Iterator[tuple]:
        try:
            yield from self.members(fs, path, part, of)
        except (pa.ArrowInvalid, zlib.error, EOFError) as e:
            raise zipfile.BadZipFile(f"{path} is not a zip archive that can be read: {e}") from e

    def members(self, fs: pafs.FileSystem, path: str, part: int, of: int) -> Iterator[tuple]:
        with fs.open_input_file(path) as file:
            if file.read(4) != MARK:
                return
            file.seek(0)
            with zipfile.ZipFile(file) as z:
                names = z.namelist()
                have = set(names)
                pages = sorted(((page_number(n), n) for n in names if n.endswith(".txt") and "manifest" not in n.lower()), key=lambda p: p[0])
                pages = [p for p in pages if self.first <= p[0] <= self.last]
                sizes = image_sizes(z, names) if {"width", "height"} & set(self.columns) else {}
                read = {
                    "doc_id": lambda n, name: doc_of(path), "page_num": lambda n, name: n, "text": lambda n, name: z.read(name).decode("utf-8", "ignore"),
                    "image": lambda n, name: z.read(f"{n}.jpeg") if f"{n}.jpeg" in have else None,
                    "width": lambda n, name: sizes.get(n, {}).get("width", 0), "height": lambda n, name: sizes.get(n, {}).get("height", 0),
                }
                for n, name in pages[part * len(pages) // of : (part + 1) * len(pages) // of]:
                    yield tuple(read[c](n, name) for c in self.columns)

    def read(self, partition: BundleRange) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        schema, held, size = to_arrow_schema(self.schema), [], 0
        for path, part, of in partition.parts:
            try:
                for row in self.rows(fs, path, part, of):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
                    if len(held) >= BATCH_PAGES or size >= BATCH_BYTES:
                        yield batch(held, schema)
                        held, size = [], 0
            except zipfile.BadZipFile:
                if self.broken != "skip":
                    raise
        if held:
            yield batch(held, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class PageBundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagebundle"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(schema, self.options)


def read_page_bundles(spark: SparkSession, path: str, columns: str = PAGES, **options: str) -> DataFrame:
    """Pages of the bundles in a folder. ``columns``, a part of the schema, and the options decide what is read from the archives."""
    spark.dataSource.register(PageBundles)
    return spark.read.format("pagebundle").schema(columns).options(**options).load(path)


def unpack_bundles(files: DataFrame) -> DataFrame:
    """The pages of the bundles at ``files(path)``, as ``PAGES`` with ``path`` and ``error``: an archive that cannot be read gives a last row with its error and no page."""
    schema = to_arrow_schema(StructType.fromDDL(f"{PAGES}, path string, error string"))
    columns = StructType.fromDDL(PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column("path").to_pylist():
                fs, local = pafs.FileSystem.from_uri(path)
                held, size, error = [], 0, None
                try:
                    for row in BundleReader(columns, {"path": path}).rows(fs, local, 0, 1):
                        held.append((*row, path, None))
                        size += len(row[2]) + len(row[3] or b"")
                        if size >= BATCH_BYTES:
                            yield batch(held, schema)
                            held, size = [], 0
                except (zipfile.BadZipFile, OSError) as e:
                    error = str(e)
                if error is not None:
                    held.append((doc_of(path), None, None, None, None, None, path, error))
                if held:
                    yield batch(held, schema)

    return files.select("path").mapInArrow(run, f"{PAGES}, path string, error string")


def write_page_bundles(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages(doc_id, page_num, text, image, width, height)`` as one bundle for each document, and return ``doc_id, n_pages``.

    A task streams its documents' pages into the archives; it holds one batch of pages, and numbers and sizes for the manifest. A bundle appears under its name when it is complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base)
        now, out, z, listed, n_pages = None, None, None, [], 0

        def close() -> tuple[str, int]:
            z.writestr("manifest.json", json.dumps({"pages": listed}))
            z.close()
            out.close()
            fs.move(draft, f"{base}/{now}.pdf")
            return now, n_pages

        done = []
        for rows in batches:
            for doc_id, n, text, image, width, height in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "page_num", "text", "image", "width", "height"))):
                if doc_id != now:
                    if now is not None:
                        done.append(close())
                    now, draft, listed, n_pages = doc_id, f"{base}/.{uuid.uuid4().hex}", [], 0
                    out = fs.open_output_stream(draft, compression=None)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(f"{n}.txt", text or "")
                n_pages += 1
                if image is not None:
                    z.writestr(f"{n}.jpeg", image)
                    listed.append({"page_number": n, "image": {"dimensions": {"width": width, "height": height}}})
        if now is not None:
            done.append(close())
        yield pa.RecordBatch.from_pylist([{"doc_id": d, "n_pages": k} for d, k in done], schema=pa.schema([("doc_id", pa.string()), ("n_pages", pa.int64())]))

    named = pages.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_num").cast("int").alias("page_num"), "text", "image", "width", "height")
    return named.repartition("doc_id").sortWithinPartitions("doc_id", "page_num").mapInArrow(run, "doc_id string, n_pages long")
