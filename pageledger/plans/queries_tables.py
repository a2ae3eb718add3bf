"""Comparison, run history and grid queries."""

from pyspark.sql import functions as F

from pageledger.functions import patterns as P
from pageledger.operators import compare as C, grid as G, runs as R
from pageledger.plans.registry import lit, register, sql_list, sql_strip

# ---- comparison --------------------------------------------------------------------------------------------------------
CELLS = ("cells_ref", "cells_gen")
DIFF = f"""r AS (SELECT sheet, row_no, col_no, {sql_strip('value')} AS ref_value FROM fx_cells_ref WHERE length({sql_strip('value')}) > 0),
 g AS (SELECT sheet, row_no, col_no, {sql_strip('value')} AS gen_value FROM fx_cells_gen WHERE length({sql_strip('value')}) > 0),
 d AS (SELECT sheet, row_no, col_no, ref_value, gen_value, CASE WHEN ref_value IS NULL THEN 'extra' WHEN gen_value IS NULL THEN 'missing' WHEN ref_value = gen_value THEN 'correct' ELSE 'wrong' END AS verdict
  FROM r FULL JOIN g USING (sheet, row_no, col_no)),
 b AS (SELECT DISTINCT sheet FROM fx_cells_ref INTERSECT SELECT DISTINCT sheet FROM fx_cells_gen), db AS (SELECT d.* FROM d SEMI JOIN b USING (sheet))"""
register("cmp_01_compare_cells", f"WITH {DIFF} SELECT * FROM db", CELLS)(lambda fx: C.compare_cells(fx.cells_ref, fx.cells_gen))
register(
    "cmp_02_accuracy",
    f"""WITH {DIFF}, n AS (SELECT sheet, count_if(verdict = 'correct')::BIGINT AS correct, count_if(verdict = 'wrong')::BIGINT AS wrong, count_if(verdict = 'missing')::BIGINT AS missing, count_if(verdict = 'extra')::BIGINT AS extra FROM db GROUP BY sheet),
 t AS (SELECT *, correct + wrong + missing AS total FROM n)
SELECT sheet, correct, wrong, missing, extra, total, CASE WHEN total > 0 THEN correct / total * 100 ELSE 0.0 END::DOUBLE AS percent, CASE WHEN total > 0 AND correct / total * 100 >= 90 THEN 'PASS' ELSE 'FAIL' END AS status FROM t
UNION ALL SELECT DISTINCT sheet, NULL, NULL, NULL, NULL, NULL, NULL, 'ERROR: not in generated' FROM fx_cells_ref WHERE sheet NOT IN (SELECT sheet FROM fx_cells_gen)
UNION ALL SELECT DISTINCT sheet, NULL, NULL, NULL, NULL, NULL, NULL, 'ERROR: not in reference' FROM fx_cells_gen WHERE sheet NOT IN (SELECT sheet FROM fx_cells_ref)""",
    CELLS,
)(lambda fx: C.accuracy(fx.cells_ref, fx.cells_gen))
register(
    "cmp_03_diff_samples",
    f"""WITH {DIFF}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet, verdict ORDER BY row_no, col_no) AS INT) AS sample_no FROM db WHERE verdict <> 'correct')
SELECT * FROM k WHERE sample_no <= CASE WHEN verdict = 'wrong' THEN 50 ELSE 30 END""",
    CELLS,
)(lambda fx: C.diff_samples(C.compare_cells(fx.cells_ref, fx.cells_gen)))

# ---- run history -------------------------------------------------------------------------------------------------------
RUN = "extraction_id, num_machines, status, ts"
register("run_01_list_runs", f"SELECT {RUN} FROM fx_runs ORDER BY ts DESC NULLS LAST", "runs")(
    lambda fx: R.list_runs(fx.runs.select(*RUN.split(", ")))
)
register("run_02_get_run", f"SELECT {RUN} FROM fx_runs WHERE extraction_id = 'ext_00000042'", "runs")(
    lambda fx: R.get_run(fx.runs, "ext_00000042").select(*RUN.split(", "))
)
REQUESTS = """SELECT extraction_id, CASE WHEN num_machines = 1 THEN concat('ext_x_', machine, '.xlsx') WHEN num_machines = 2 THEN concat(extraction_id, '_', machine, '.pdf')
 ELSE concat(extraction_id, '_', machine, '.xlsx') END AS filename FROM"""
register(
    "run_02_resolve_downloads",
    f"""WITH q AS ({REQUESTS} fx_runs), f AS (SELECT DISTINCT extraction_id, unnest(files) AS filename, true AS known FROM fx_runs)
SELECT q.extraction_id, q.filename, CASE WHEN NOT starts_with(q.filename, q.extraction_id) THEN 'forbidden' WHEN known THEN 'ok' ELSE 'not_found' END AS answer
FROM q LEFT JOIN f USING (extraction_id, filename)""",
    "runs",
)(lambda fx: R.resolve_downloads(fx.spark.sql(REQUESTS + " {r}", r=fx.runs), fx.runs))
register("run_03_run_totals", "SELECT count(*) AS n_runs, CAST(sum(num_machines) AS BIGINT) AS n_machines FROM fx_runs", "runs")(
    lambda fx: R.run_totals(fx.runs)
)


def summarised(runs):
    return runs.withColumn("machine_summary", F.expr("array(named_struct('machine', machine, 'variants', array(machine, 'V0', 'V1')))"))


register(
    "run_04_run_outputs",
    """WITH v AS (SELECT extraction_id, files, machine, unnest([machine, 'V0', 'V1']) AS variant FROM fx_runs)
SELECT extraction_id, machine, variant, list_filter(files, lambda f: contains(f, '_All_CatID'))[1] AS run_file,
 list_filter(files, lambda f: contains(f, concat('_', machine, '_All_CatID')))[1] AS machine_file,
 list_filter(files, lambda f: contains(f, concat('_', machine, '_', variant, '.xlsx')) OR ends_with(f, concat('_', variant, '.xlsx')))[1] AS variant_file FROM v""",
    "runs",
)(lambda fx: R.run_outputs(summarised(fx.runs)))
register("run_05_drop_runs", f"SELECT {RUN} FROM fx_runs WHERE NOT (status = 'failed' AND num_machines > 1)", "runs")(
    lambda fx: R.drop_runs(fx.runs, fx.runs.filter("status = 'failed' AND num_machines > 1")).select(*RUN.split(", "))
)

# ---- grids -------------------------------------------------------------------------------------------------------------
_CELL = r"list_filter(list_transform({p}, lambda c: regexp_replace(c, '\s+', ' ', 'g')), lambda c: trim(c) <> '')"
_WIDE, _NARROW = (_CELL.format(p=rf"string_split_regex({sql_strip('l')}, '\s{{{n},}}')") for n in (2, 1))
GRID1 = rf"""li AS (SELECT doc_id, page_num, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {{src}}),
 tl AS (SELECT *, CASE WHEN len(string_split_regex({sql_strip('l')}, '\s{{{{2,}}}}')) > 1 THEN {_WIDE.replace('{', '{{').replace('}', '}}')} ELSE {_NARROW.replace('{', '{{').replace('}', '}}')} END AS cells FROM li
  WHERE length(regexp_replace(l, '[^0-9]', '', 'g')) >= 2 AND (regexp_matches(l, '(?i)[0-9]+\s*[-to]+\s*[0-9]+') OR len(regexp_extract_all(l, '[^\s]+')) >= 3)),
 gr AS (SELECT doc_id, page_num, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY i) AS INT) AS row_idx, cells, count(*) OVER (PARTITION BY doc_id, page_num) AS n FROM tl WHERE len(cells) >= 2)"""
for _fx in ("pages", "doc_pages", "manual"):
    register(
        f"grd_01_grid_rows_{_fx}",
        f"WITH {GRID1.format(src='fx_' + _fx)} SELECT doc_id, page_num, row_idx, array_to_string(cells, '|') AS cells FROM gr WHERE n >= 2",
        _fx,
    )(lambda fx, f=_fx: G.grid_rows(fx.unstored(f)).withColumn("cells", F.array_join("cells", "|")))

BARE = r"regexp_replace(upper({c}), '[^\p{{L}}\p{{N}}_]', '', 'g')"
LIKE = f"(length({{b}}) BETWEEN 3 AND 12 AND regexp_matches({{b}}, '[A-Z]') AND regexp_matches({{b}}, '[0-9]') AND {{b}} NOT IN {sql_list(P.GENERIC_HEADER_WORDS)})"


def like(c: str) -> str:
    return LIKE.format(b=BARE.format(c=c))


HEADER = f"""hd AS (SELECT doc_id, page_num, row_idx, cells FROM fx_grid WHERE len(list_filter(cells, lambda c: {like('c')})) >= 2
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY row_idx) = 1)"""
register("grd_02_header_row", f"WITH {HEADER} SELECT doc_id, page_num, row_idx, array_to_string(cells, '|') AS cells FROM hd", "grid")(
    lambda fx: G.header_row(fx.grid).select("doc_id", "page_num", "row_idx", F.array_join("cells", "|").alias("cells"))
)
KNOWN = "SELECT DISTINCT doc_id, 'on delay' AS variant FROM"
register(
    "grd_02_header_row_known",
    f"""SELECT doc_id, page_num, row_idx, array_to_string(cells, '|') AS cells FROM fx_grid
 WHERE list_contains(list_transform(cells, lambda c: {BARE.format(c='c')}), 'ONDELAY') OR len(list_filter(cells, lambda c: {like('c')})) >= 2
 QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY row_idx) = 1""",
    "grid",
)(
    lambda fx: G.header_row(fx.grid, fx.spark.sql(KNOWN + " {g}", g=fx.grid)).select(
        "doc_id", "page_num", "row_idx", F.array_join("cells", "|").alias("cells")
    )
)
# long form: one row per cell
CELLS_LONG = """ce AS (SELECT doc_id, page_num, row_idx, unnest(cells) AS value, generate_subscripts(cells, 1) - 1 AS col_idx FROM fx_grid),
 ff AS (SELECT doc_id, page_num, row_idx, col_idx, CASE WHEN col_idx >= 1 AND trim(value) = '' THEN
   coalesce(last_value(CASE WHEN col_idx >= 1 THEN nullif(trim(value), '') END IGNORE NULLS) OVER (PARTITION BY doc_id, page_num, row_idx ORDER BY col_idx), value) ELSE value END AS value FROM ce)"""
register(
    "grd_03_forward_fill",
    f"WITH {CELLS_LONG} SELECT doc_id, page_num, row_idx, CAST(col_idx AS INT) AS col_idx, value FROM ff",
    "grid",
)(lambda fx: G.grid_cells(G.forward_fill(fx.grid)))
register(
    "grd_03_rows_from_cells",
    """SELECT grid_id, row_idx, string_agg(value, '|' ORDER BY col_idx) AS cells FROM fx_grid_cells GROUP BY grid_id, row_idx""",
    "grid_cells",
)(lambda fx: G.rows_from_cells(fx.grid_cells, ["grid_id"]).withColumn("cells", F.array_join("cells", "|")))
SYN = "CASE upper(trim(cells[1])) " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in P.PARAMETER_NAMES.items()) + " ELSE upper(trim(cells[1])) END"
PARAMS = f"""{HEADER}, {CELLS_LONG},
 hc AS (SELECT doc_id, page_num, unnest(cells) AS name, generate_subscripts(cells, 1) - 1 AS col_idx FROM hd),
 vc AS (SELECT doc_id, page_num, name, min(col_idx) AS col_idx FROM hc WHERE col_idx > 0 AND {like('name')} GROUP BY ALL),
 dr AS (SELECT g.doc_id, g.page_num, g.row_idx, {SYN.replace("cells", "g.cells")} AS param FROM fx_grid g JOIN hd USING (doc_id, page_num) WHERE g.cells <> hd.cells),
 pv AS (SELECT dr.doc_id, dr.page_num, dr.row_idx, upper(trim(name)) AS variant, param, trim(value) AS value FROM dr JOIN vc USING (doc_id, page_num) JOIN ff USING (doc_id, page_num, row_idx, col_idx)),
 vp AS (SELECT doc_id, page_num, variant, param, arg_max(value, row_idx) AS value FROM pv WHERE value <> '' AND upper(value) NOT IN ('NA', '-', 'N/A') GROUP BY ALL)"""
register("grd_04_variant_params", f"WITH {PARAMS} SELECT * FROM vp", "grid")(lambda fx: G.variant_params(fx.grid))
COMBINED = f"{PARAMS}, cb AS (SELECT doc_id, variant, param, arg_max(value, page_num) AS value FROM vp GROUP BY ALL)"
register("grd_05_combine_grids", f"WITH {COMBINED} SELECT * FROM cb", "grid")(lambda fx: G.combine_grids(G.variant_params(fx.grid)))
GRID_SPECS = """SELECT p_brand AS doc_id, concat('MG', substr(p_brand, 7), CASE WHEN max(p_size) % 2 = 0 THEN 'A1' ELSE 'B2' END) AS variant,
 CASE WHEN min(p_partkey) % 3 = 0 THEN 'NA' WHEN min(p_partkey) % 3 = 1 THEN '' ELSE 'kept' END AS uv_range, CAST(NULL AS STRING) AS on_delay, '-' AS ov_range FROM part GROUP BY p_brand"""
_FILL = "CASE WHEN length({f}) > 0 AND {f} NOT IN ('NA', '-', 'null') THEN {f} ELSE coalesce((SELECT value FROM cb WHERE cb.doc_id = sp.doc_id AND cb.variant = sp.variant AND cb.param = '{f}'), {f}) END AS {f}"
register(
    "grd_06_fill_weak",
    f"WITH {COMBINED}, sp AS ({GRID_SPECS}) SELECT doc_id, variant, {', '.join(_FILL.format(f=f) for f in ('uv_range', 'on_delay', 'ov_range'))} FROM sp",
    "grid",
)(
    lambda fx: G.fill_weak(
        fx.spark.sql(GRID_SPECS.replace("FROM part", f"FROM parquet.`{fx.sf_dir}/part.parquet`")),
        G.combine_grids(G.variant_params(fx.grid)), ("uv_range", "on_delay", "ov_range"), ("doc_id", "variant"),
    )
)
