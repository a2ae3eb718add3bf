"""Source, sink and stream queries. All of them write what Spark derives from the test tables and read it back."""

import uuid

from pyarrow.fs import FileSystem, copy_files
from pyspark.sql import functions as F

from pageledger.plans.registry import register
from pageledger.session import delete_at_end, shared_dir
from pageledger.sources import bundles as B, readers as RD, runstore as RS, writers as W
from pageledger.streaming import ingest as ST


def folder(fx, name: str) -> str:
    path = f"{shared_dir(fx.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    delete_at_end(fx.spark, path)
    return path


def landed(fx):
    """One bundle for each conversation with its turns as pages, in a folder of its own."""
    path = folder(fx, "landing")
    odd = F.col("page_num") % 2 == 1
    pages = fx.conv_pages.select(
        "doc_id", "page_num", "text", F.when(odd, F.unhex(F.lit("FFD8"))).alias("image"), F.when(odd, F.col("page_num") + 100).cast("int").alias("width"), F.when(odd, 50).alias("height")
    )
    B.write_page_bundles(pages, path).write.format("noop").mode("overwrite").save()
    return path


def shown(pages):
    return pages.select("doc_id", "page_num", "text", F.col("image").isNotNull().alias("has_image"), "width", "height")


PAGES_SQL = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(page_num AS INT) AS page_num, text, page_num % 2 = 1 AS has_image, CAST(CASE WHEN page_num % 2 = 1 THEN 100 + page_num ELSE 0 END AS INT) AS width,
 CASE WHEN page_num % 2 = 1 THEN 50 ELSE 0 END AS height FROM fx_conv_pages"""
register("src_01_read_page_bundles", PAGES_SQL, "conv_pages")(lambda fx: shown(B.read_page_bundles(fx.spark, landed(fx), bytesPerPartition="65536")))
register("src_01_read_page_range", f"SELECT doc_id, page_num, text FROM ({PAGES_SQL}) x WHERE page_num BETWEEN 2 AND 4", "conv_pages")(
    lambda fx: B.read_page_bundles(fx.spark, landed(fx), "doc_id string, page_num int, text string", firstPage="2", lastPage="4")
)
register("src_02_read_model_responses", "SELECT reply_id, variant, body FROM fx_replies WHERE length(body) > 0", "replies")(
    lambda fx: RD.read_model_responses(fx.replies).select("reply_id", "variant", "body")
)


def stored_runs(fx):
    """A file of several lines for each run, some of them cut short, read back with the run reader."""
    path = folder(fx, "runs")
    record = F.to_json(F.struct("extraction_id", "num_machines", F.col("files").alias("excel_files"), "status", F.array("machine").alias("machines")), {"pretty": "true"})
    body = F.when(F.col("broken"), F.left(record, F.length(record) - 3)).otherwise(record)
    fx.user_runs.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return RD.read_runs(fx.spark, path)


register(
    "src_03_read_runs",
    "SELECT extraction_id, num_machines, status, machine AS machines, CAST(len(files) AS INT) AS n_files FROM fx_user_runs WHERE NOT broken", "user_runs",
)(lambda fx: stored_runs(fx).select("extraction_id", "num_machines", "status", F.array_join("machines", "|").alias("machines"), F.size("excel_files").alias("n_files")))
BODIES = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('{" sm', CAST(o_orderkey % 7 AS STRING), ' ": [', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '" ab1 ", "", "cd2"' END, '], " ": ["x"]}') END AS body FROM"""
register(
    "src_04_read_requested",
    """WITH r AS (SELECT o_orderkey AS doc_id, concat('SM', CAST(o_orderkey % 7 AS VARCHAR)) AS machine, CASE WHEN o_orderkey % 4 = 0 THEN [NULL] ELSE ['AB1', 'CD2'] END AS v FROM orders WHERE o_orderkey % 6 <> 0)
SELECT doc_id, machine, unnest(v) AS variant FROM r""",
)(lambda fx: RD.read_requested(fx.spark.sql(f"{BODIES} parquet.`{fx.sf_dir}/orders.parquet`")))
NAMES = """SELECT concat('ext_', CAST(p_partkey AS STRING)) AS extraction_id, replace(p_brand, '#', '/') AS machine, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN replace(p_brand, '#', '/') ELSE concat(p_name, ' ', p_type, ' with a long title 01234567') END AS variant FROM"""
register(
    "snk_01_workbook_names",
    f"""WITH n AS (SELECT *, replace(replace(machine, '/', '_'), ' ', '_') AS m, replace(replace(variant, '/', '_'), ' ', '_') AS v FROM ({NAMES} part) x)
SELECT extraction_id, machine, variant, concat(extraction_id, '_', m, CASE WHEN v = '' OR v = m THEN '' ELSE concat('_', v) END, '.xlsx') AS workbook, concat(extraction_id, '_', m, '_All_CatID.xlsx') AS consolidated, left(CASE WHEN variant <> '' THEN variant ELSE machine END, 31) AS sheet FROM n""",
)(lambda fx: W.workbook_names(fx.spark.sql(f"{NAMES} parquet.`{fx.sf_dir}/part.parquet`")))


def written_cells(fx):
    """Many runs written twice, then some of them once more."""
    path = folder(fx, "cells")
    run = F.concat(F.lit("ext_"), (F.col("row_no") % 23).cast("string"))
    cells = fx.cells_ref.select(run.alias("extraction_id"), F.col("sheet").alias("machine"), F.lit("").alias("variant"), "row_no", "col_no", "value")
    for part in (cells, cells, cells.filter("row_no % 23 < 5")):
        W.write_cells(part, path)
    return fx.spark.read.schema("workbook string, row_no bigint, col_no int, value string, extraction_id string").parquet(path).select("extraction_id", "workbook", "row_no", "col_no", "value")


register(
    "snk_01_write_cells",
    """SELECT concat('ext_', CAST(row_no % 23 AS VARCHAR)) AS extraction_id, concat('ext_', CAST(row_no % 23 AS VARCHAR), '_', replace(sheet, ' ', '_'), '.xlsx') AS workbook, row_no, col_no, value FROM fx_cells_ref""",
    "cells_ref",
)(written_cells)


def committed_cells(fx, dropped=None):
    """Many runs committed twice, some of them once more with other values; then some may be dropped and the store purged."""
    path = folder(fx, "store")
    run = F.concat(F.lit("ext_"), (F.col("row_no") % 23).cast("string"))
    variant = F.concat(F.lit("V "), (F.col("row_no") % 3).cast("string"))
    cells = W.workbook_rows(fx.cells_ref.select(run.alias("extraction_id"), F.col("sheet").alias("machine"), variant.alias("variant"), "row_no", "col_no", "value"))
    again = F.col("extraction_id").isin("ext_0", "ext_1")
    for part in (cells, cells, cells.filter(again).withColumn("value", F.concat("value", F.lit("!")))):
        RS.write_runs_rows(part, path)
    if dropped:
        RS.drop_runs(cells.select("extraction_id").where(F.col("extraction_id").isin(*dropped)).distinct(), path, W.WORKBOOK_ROWS)
        RS.purge(fx.spark, path, W.WORKBOOK_ROWS)
    return RS.read_runs_rows(fx.spark, path, W.WORKBOOK_ROWS)


_BOOKS = """SELECT extraction_id, unnest([extraction_id || '_' || m || '_V_' || v || '.xlsx', extraction_id || '_' || m || '_All_CatID.xlsx']) AS workbook, 'V ' || v AS sheet, row_no, col_no,
 CASE WHEN row_no % 23 < 2 THEN value || '!' ELSE value END AS value FROM (SELECT *, 'ext_' || CAST(row_no % 23 AS VARCHAR) AS extraction_id, replace(sheet, ' ', '_') AS m, CAST(row_no % 3 AS VARCHAR) AS v FROM fx_cells_ref) x"""
register("snk_01_consolidated_cells", _BOOKS, "cells_ref")(committed_cells)
register("run_05_drop_runs_files", f"{_BOOKS} WHERE extraction_id NOT IN ('ext_1', 'ext_7', 'ext_22')", "cells_ref")(lambda fx: committed_cells(fx, ("ext_1", "ext_7", "ext_22")))


def cached(fx):
    """Enriched replies, parsed again as a replay would."""
    from pageledger.operators import families as FA

    families = fx.families.withColumn("label", F.concat(F.lit("fam "), "family"))
    replies = fx.families.select("family", F.lit('[{"kind": "spec", "title": "t", "submachine_columns": ["A1"]}]').alias("tables"))
    path = folder(fx, "cache")
    W.write_response_cache(W.response_cache(replies, families), path)
    parsed = FA.parse_replies(fx.spark.read.parquet(path))
    return parsed.select(
        "family", F.col("r.family_label").alias("label"), F.array_join("r.title_submachines", "|").alias("title"), F.get("r.page_range", 0).alias("first_page"),
        F.get("r.page_range", 1).alias("last_page"), F.size("r.tables").alias("n_tables"),
    )


register(
    "snk_02_response_cache",
    "SELECT family, concat('fam ', family) AS label, array_to_string(title_submachines, '|') AS title, first_page, last_page, 1 AS n_tables FROM fx_families", "families",
)(cached)


def written_runs(fx):
    path = folder(fx, "records")
    runs = fx.runs.withColumn("error", F.when(F.col("status") == "failed", "broken")).drop("status")
    for part in (runs.filter("num_machines = 0"), runs, runs):
        W.write_run(part, path)
    return fx.spark.read.parquet(path).select("extraction_id", "status")


register(
    "snk_03_write_run",
    "SELECT extraction_id, CASE WHEN status = 'failed' THEN 'failed' WHEN len(files) > 0 THEN 'completed' ELSE 'no_output' END AS status FROM fx_runs", "runs",
)(written_runs)


def ingested(fx):
    """Bundles land; a stream takes them. Then they land again in another folder beside a broken one and a file that is no bundle, and the stream is started anew, twice."""
    landing, out, checkpoint = landed(fx), folder(fx, "pages"), folder(fx, "checkpoint")
    take = lambda: ST.ingest_stream(fx.spark, landing, checkpoint, ST.append_pages(out), max_files=400).awaitTermination()
    take()
    fs, base = FileSystem.from_uri(landing)
    fs.create_dir(f"{base}/again")
    copy_files(landing, f"{landing}/again")
    for name, content in (("broken.pdf", b"PK\x03\x04 cut short"), ("letter.pdf", b"%PDF")):
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(content)
    take()
    take()
    return fx.spark.read.parquet(out), ST.document_steps(fx.spark, checkpoint)


register("str_01_ingest_stream", PAGES_SQL, "conv_pages")(lambda fx: shown(ingested(fx)[0]))
register(
    "str_01_document_steps",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'recorded' AS status, count(*) AS n_pages FROM fx_conv_pages GROUP BY doc_id UNION ALL SELECT unnest(['broken', 'letter']), 'failed', NULL", "conv_pages",
)(lambda fx: ingested(fx)[1].select("doc_id", "status", "n_pages"))


def streamed_totals(fx):
    """Runs are recorded; some are recorded again with more machines, some dropped, some old records arrive once more; the stream is started anew for each of these."""
    path, checkpoint, totals = folder(fx, "changes"), folder(fx, "checkpoint"), folder(fx, "totals")
    runs = fx.runs.select("extraction_id", "num_machines")
    change = lambda df, n, dropped=False: df.select("extraction_id", "num_machines", F.lit(dropped).alias("dropped"), F.lit(n).cast("long").alias("change_no"))
    some = lambda k: F.pmod(F.crc32("extraction_id"), F.lit(7)) == k
    stages = (
        change(runs, 1), change(runs.where(some(1)).withColumn("num_machines", F.col("num_machines") + 5), 2).unionByName(change(runs.where(some(2)), 2)),
        change(runs.where(some(3) | some(1)), 3, dropped=True), change(runs, 1).unionByName(change(runs.where(some(3) & (F.col("num_machines") > 1)), 4)),
    )
    for stage in stages:
        stage.repartition(4).write.mode("append").parquet(path)
        stream = fx.spark.readStream.schema(ST.CHANGES).option("maxFilesPerTrigger", 4).parquet(path)
        ST.run_totals_stream(stream, checkpoint, totals).awaitTermination()
    return ST.run_totals_table(fx.spark, totals)


def _crc_mod_sql(text: str, k: int) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit, modulo k."""
    bits = "list_reduce([xor(c, b)] || [0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: {bits}), 4294967295) % {k}"


register(
    "str_02_run_totals_stream",
    f"""WITH r AS (SELECT num_machines, {_crc_mod_sql('extraction_id', 7)} AS k FROM fx_runs)
SELECT count(*) AS n_runs, CAST(sum(num_machines) AS BIGINT) AS n_machines FROM r WHERE k <> 1 AND (k <> 3 OR num_machines > 1)""",
    "runs",
)(streamed_totals)
