"""Page classification and segmentation queries."""

from pyspark.sql import functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import SPACE_CHARS
from pageledger.operators import pageclass as G, quality as Q, segment as S, text as T
from pageledger.plans.queries_text import REQUESTED_SQL, _SCOPE, _tokens_sql, part_names, requested
from pageledger.plans.registry import lit, register, sql_lines, sql_list, sql_strip, sql_words

_FLAT = f"translate(text, {lit(SPACE_CHARS)}, '{' ' * len(SPACE_CHARS)}')"


def score_sql(fx: str) -> str:
    has = lambda w: f"CAST(contains(upper(replace(text, 'ß', 'SS')), {lit(w)}) AS INT)"
    return f"""sc AS (SELECT doc_id, page_num, greatest({', '.join(has(w) for w in P.TABLE_KEYWORDS)}) * 2 + CAST(len(regexp_extract_all(text, '[0-9]+')) > 20 AS INT) + CAST(len(regexp_extract_all({_FLAT}, ' {{2,}}')) > 10 AS INT)
   - {' - '.join(has(w) for w in P.PROCEDURE_TERMS)} AS score, has_image FROM {fx}),
 tp AS (SELECT doc_id, page_num, score, score >= 3 AND has_image AS is_table FROM sc)"""


def rxs(p: str) -> str:
    return f"regexp_matches(text, {lit('(?i)' + p)})"


TAGS = f"""tg AS (SELECT doc_id, page_num, has_image, {rxs(P.SPEC_PAGE)} AS is_spec, {rxs(P.PROCEDURE_PAGE)} AS is_procedure, regexp_matches(text, {lit(P.NUMBERED_STEP)}) AS has_numbered_step, {rxs(P.OTHER_PROCESS)} AS is_other_process FROM {{fx}})"""
for _fx in ("pages", "manual"):
    register(f"pgc_01_score_table_pages_{_fx}", f"WITH {score_sql('fx_' + _fx)} SELECT * FROM tp", _fx)(lambda fx, f=_fx: G.score_table_pages(fx.unstored(f)))
    register(f"pgc_02_tag_pages_{_fx}", f"WITH {TAGS.replace('{fx}', 'fx_' + _fx)} SELECT * FROM tg", _fx)(lambda fx, f=_fx: G.tag_pages(fx.unstored(f)))
register("pgc_01_score_table_pages_corpus", f"WITH dp AS (SELECT doc_id, page_num, text, page_num % 2 = 0 AS has_image FROM fx_doc_pages), {score_sql('dp')} SELECT * FROM tp", "doc_pages")(
    lambda fx: G.score_table_pages(fx.doc_pages.withColumn("has_image", F.expr("page_num % 2 = 0")))
)


def targets(fx):
    """The variants of each document."""
    return part_names(fx).withColumnRenamed("name", "variant")


def prepared(fx, cut=True):
    return G.prepare(fx.stored("manual"), targets(fx), T.block_names(fx.stored("manual")), cut)


BODY = rf"""ln AS (SELECT DISTINCT doc_id, page_num, {sql_strip('raw')} AS line FROM (SELECT doc_id, page_num, unnest({sql_lines('text')}) AS raw FROM fx_manual) x WHERE length({sql_strip('raw')}) > 10),
 np AS (SELECT doc_id, count(*) AS total FROM fx_manual GROUP BY doc_id),
 rl AS (SELECT ln.doc_id, line FROM ln JOIN np ON ln.doc_id = np.doc_id GROUP BY ln.doc_id, line, total HAVING count(*) >= greatest(2, total * 0.5)),
 ha AS (SELECT doc_id, list(line) AS heads FROM rl GROUP BY doc_id),
 bo AS (SELECT p.doc_id, page_num, has_image, CASE WHEN heads IS NULL THEN text ELSE array_to_string(list_filter({sql_lines('text')}, lambda x: NOT list_contains(heads, {sql_strip('x')})), chr(10)) END AS body FROM fx_manual p LEFT JOIN ha ON p.doc_id = ha.doc_id),
 {TAGS.replace('{fx}', 'fx_manual')},
 pp AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS pos FROM tg WHERE has_image AND is_procedure AND NOT is_other_process),
 pb AS (SELECT pp.*, body FROM pp JOIN bo ON pp.doc_id = bo.doc_id AND pp.page_num = bo.page_num),
 tr AS (SELECT DISTINCT l_orderkey AS doc_id, concat('PV', lpad(CAST(l_partkey AS VARCHAR), 6, '0')) AS variant FROM lineitem),
 {_SCOPE % ','}, bw AS (SELECT doc_id, {sql_words('text', P.BLOCK_CODE)} AS ws FROM s), bi AS (SELECT DISTINCT doc_id, unnest(ws) AS name FROM bw),
 {_tokens_sql('fx_manual', P.BLOCK_CODE)}, top AS (SELECT doc_id, token, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 20),
 bn AS (SELECT doc_id, name FROM bi UNION ALL SELECT doc_id, token FROM top WHERE n >= 3 AND length(token) >= 6 AND doc_id NOT IN (SELECT doc_id FROM bi)),
 wd AS (SELECT doc_id, page_num, unnest(regexp_extract_all(upper(body), '[\p{{L}}\p{{N}}_]+')) AS w FROM bo),
 mc AS (SELECT doc_id, page_num, w, count(*) AS n FROM wd GROUP BY ALL),
 ow AS (SELECT mc.doc_id, variant, page_num, n AS own_n FROM mc JOIN tr ON mc.doc_id = tr.doc_id AND mc.w = variant),
 sx AS (SELECT ow.*, coalesce((SELECT sum(n) FROM mc JOIN bn ON mc.doc_id = bn.doc_id AND mc.w = bn.name WHERE mc.doc_id = ow.doc_id AND mc.page_num = ow.page_num AND bn.name <> ow.variant), 0) AS other_n FROM ow),
 ax AS (SELECT sx.doc_id, sx.variant, sx.page_num, pos, body, own_n - other_n AS base,
   regexp_matches(body, concat('(?i)PROCEDURE\s+FOR\s+CAT\s+ID\s*:.*', sx.variant, '.*R\s*LED|PROCEDURE\s+FOR\s+CAT\s+ID\s*:.*R\s*LED.*', sx.variant)) AS is_cutoff,
   regexp_matches(body, concat('(?i)FUNCTIONAL\s+TEST\s+PROCEDURE\s+FOR.*', sx.variant)) AS fn, regexp_matches(body, concat('(?i)CAT\s+ID\s*:\s*', sx.variant, '|PROCEDURE\s+FOR\s+', sx.variant)) AS ot
  FROM sx JOIN pb ON sx.doc_id = pb.doc_id AND sx.page_num = pb.page_num WHERE regexp_matches(body, {lit('(?i)' + P.TEST_CONTENT)})),
 ay AS (SELECT *, base + CASE WHEN is_cutoff THEN 15 WHEN fn THEN 10 WHEN ot THEN 3 ELSE 0 END AS score FROM ax),
 an AS (SELECT doc_id, variant, page_num, pos, CAST(score AS BIGINT) AS score, is_cutoff FROM ay QUALIFY row_number() OVER (PARTITION BY doc_id, variant ORDER BY score DESC, pos) = 1)"""
register("pgc_03_anchor_page", f"WITH {BODY} SELECT doc_id, variant, page_num, CAST(pos AS BIGINT) AS pos, score, is_cutoff FROM an", "manual")(lambda fx: G.anchor_page(prepared(fx)))
# a heading is foreign where the rest of its line lacks the variant's name
WINDOW = rf"""{BODY}, st AS (SELECT an.*, CASE WHEN NOT is_cutoff AND EXISTS (SELECT 1 FROM pb JOIN ow ON pb.doc_id = ow.doc_id AND pb.page_num = ow.page_num WHERE pb.doc_id = an.doc_id AND pb.pos = an.pos - 1 AND ow.variant = an.variant) THEN pos - 1 ELSE pos END AS start FROM an),
 wr AS (SELECT st.doc_id, st.variant, is_cutoff, start, pb.pos, pb.page_num, body, list_filter(regexp_extract_all(body, '(?i)(?:FUNCTIONAL\s+TEST\s+PROCEDURE\s+FOR|PROCEDURE\s+FOR\s+CAT\s+ID\s*:)[^\n]*'), lambda h: NOT contains(upper(h), st.variant))[1] AS h
  FROM st JOIN pb ON st.doc_id = pb.doc_id AND pb.pos BETWEEN start AND start + CASE WHEN is_cutoff THEN 3 ELSE 8 END - 1),
 wh AS (SELECT *, CASE WHEN pos > start AND h IS NOT NULL THEN strpos(body, h) ELSE 0 END AS hit FROM wr),
 ws2 AS (SELECT *, min(CASE WHEN hit > 0 THEN pos END) OVER (PARTITION BY doc_id, variant) AS stop, length({sql_strip('left(body, greatest(hit - 1, 0))')}) / greatest(length(body), 1) AS share FROM wh),
 wn AS (SELECT doc_id, variant, page_num, pos - start + 1 AS rank, is_cutoff FROM ws2 WHERE stop IS NULL OR pos < stop OR (pos = stop AND share > 0.30))"""


def windowed(p):
    return G.page_window(p, G.anchor_page(p))


register("pgc_04_page_window", f"WITH {WINDOW} SELECT doc_id, variant, page_num, CAST(rank AS BIGINT) AS rank, is_cutoff FROM wn", "manual")(lambda fx: windowed(prepared(fx)))
NARR = rf"""{WINDOW}, ct AS (SELECT DISTINCT doc_id, variant FROM wn WHERE is_cutoff),
 nr AS (SELECT ct.doc_id, variant, page_num, 0 AS tier, page_num AS rank FROM ct JOIN bo ON ct.doc_id = bo.doc_id WHERE has_image AND regexp_matches(body, concat('(?i)FUNCTIONAL\s+TEST\s+PROCEDURE\s+FOR\s+.*', variant)) UNION ALL SELECT doc_id, variant, page_num, 1, rank FROM wn),
 nu AS (SELECT doc_id, variant, page_num, min(struct_pack(t := tier, r := rank)) AS a FROM nr GROUP BY ALL),
 mn AS (SELECT doc_id, variant, page_num, row_number() OVER (PARTITION BY doc_id, variant ORDER BY a) AS rank FROM nu QUALIFY rank <= 8)"""
register("pgc_05_merge_narrative", f"WITH {NARR} SELECT doc_id, variant, page_num, CAST(rank AS INT) AS rank FROM mn", "manual")(
    lambda fx: (lambda p: G.merge_narrative(p, windowed(p)))(prepared(fx))
)
FALL = f"""{NARR}, om AS (SELECT ow.doc_id, ow.variant, ow.page_num FROM ow JOIN tg ON ow.doc_id = tg.doc_id AND ow.page_num = tg.page_num JOIN np ON ow.doc_id = np.doc_id WHERE total <= 20 AND has_image AND (is_procedure OR has_numbered_step)),
 en AS (SELECT doc_id, variant FROM om GROUP BY ALL HAVING count(*) >= 3), re AS (SELECT * FROM tr ANTI JOIN en USING (doc_id, variant)), lo AS (SELECT re.* FROM re ANTI JOIN an USING (doc_id, variant)),
 h3 AS (SELECT doc_id, page_num, pos AS rank FROM pp WHERE pos <= 8), h4 AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS rank FROM tg WHERE has_image AND is_procedure QUALIFY rank <= 8),
 fb AS (SELECT doc_id, variant, page_num, row_number() OVER (PARTITION BY doc_id, variant ORDER BY page_num) AS rank, 'mentions' AS source FROM om SEMI JOIN en USING (doc_id, variant)
  UNION ALL SELECT mn.doc_id, mn.variant, mn.page_num, CASE WHEN is_cutoff THEN mn.rank ELSE wn.rank END, 'anchor' FROM mn JOIN re USING (doc_id, variant) JOIN an USING (doc_id, variant) LEFT JOIN wn ON mn.doc_id = wn.doc_id AND mn.variant = wn.variant AND mn.page_num = wn.page_num WHERE an.is_cutoff OR wn.page_num IS NOT NULL
  UNION ALL SELECT lo.doc_id, variant, page_num, rank, 'procedure' FROM lo JOIN h3 ON lo.doc_id = h3.doc_id
  UNION ALL SELECT lo.doc_id, variant, page_num, rank, 'marker' FROM lo JOIN h4 ON lo.doc_id = h4.doc_id WHERE lo.doc_id NOT IN (SELECT doc_id FROM h3))"""


def fallback_pages(fx):
    return G.page_fallbacks(prepared(fx), targets(fx))


FALL = FALL.replace("CASE WHEN is_cutoff THEN mn.rank", "CASE WHEN an.is_cutoff THEN mn.rank")
register("pgc_06_page_fallbacks", f"WITH {FALL} SELECT doc_id, variant, page_num, CAST(rank AS INT) AS rank, source FROM fb", "manual")(fallback_pages)
SPECS = f"""{score_sql('fx_manual')}, {TAGS.replace('{fx}', 'fx_manual')}, t8 AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS rank, 'table' AS source FROM tp WHERE is_table QUALIFY rank <= 8),
 mk AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS rank, 'marker' AS source FROM tg WHERE has_image AND is_spec AND doc_id NOT IN (SELECT doc_id FROM t8)),
 f6 AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS rank, 'first' AS source FROM fx_manual WHERE has_image AND doc_id NOT IN (SELECT doc_id FROM t8 UNION SELECT doc_id FROM mk) QUALIFY rank <= 6),
 sp AS (SELECT * FROM t8 UNION ALL SELECT * FROM mk UNION ALL SELECT * FROM f6)"""
register("pgc_06_spec_pages", f"WITH {SPECS} SELECT doc_id, page_num, CAST(rank AS INT) AS rank, source FROM sp", "manual")(lambda fx: G.spec_pages(fx.stored("manual")))


def part_pages(fx):
    """All pages of a variant's procedure in order: long page lists."""
    return fx.proc_pages.select(F.lit(1).alias("doc_id"), "variant", "page_num", F.col("page_num").alias("rank"))


for _kind, (_a, _b, _c) in (("spec", (8, 10, 12)), ("procedure", (10, 12, 16))):
    register(
        f"pgc_07_budget_pages_{_kind}",
        f"""WITH n AS (SELECT variant, page_num, row_number() OVER (PARTITION BY variant ORDER BY page_num) AS rank, count(*) OVER (PARTITION BY variant) AS n FROM fx_proc_pages)
SELECT 1 AS doc_id, variant, page_num, CAST(rank AS INT) AS rank, CAST((rank - 1) // 8 AS INT) AS chunk_idx FROM n WHERE rank <= CASE WHEN n <= {_a} THEN n WHEN n <= 20 THEN {_b} ELSE {_c} END""",
        "proc_pages",
    )(lambda fx, k=_kind: G.budget_pages(part_pages(fx), k))
register(
    "pgc_07_spec_budget_chain",
    f"""WITH {SPECS.replace('fx_manual', 'fx_marker_pages')}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sp)
SELECT doc_id, page_num, CAST(rank AS INT) AS rank, CAST((rank - 1) // 8 AS INT) AS chunk_idx FROM n WHERE rank <= CASE WHEN n <= 8 THEN n WHEN n <= 20 THEN 10 ELSE 12 END""",
    "marker_pages",
)(lambda fx: G.budget_pages(G.spec_pages(fx.stored("marker_pages")), "spec", keys=["doc_id"]))
BUDGETED = """n AS (SELECT variant, page_num, row_number() OVER (PARTITION BY variant ORDER BY page_num) AS rank, count(*) OVER (PARTITION BY variant) AS n FROM fx_proc_pages),
 sp AS (SELECT variant, string_agg(page_num, ',' ORDER BY page_num) AS p FROM n WHERE rank <= CASE WHEN n <= 8 THEN n WHEN n <= 20 THEN 10 ELSE 12 END GROUP BY variant),
 pp AS (SELECT variant, string_agg(page_num, ',' ORDER BY page_num) AS p FROM n WHERE rank <= CASE WHEN n <= 10 THEN n WHEN n <= 20 THEN 12 ELSE 16 END GROUP BY variant)"""
register(
    "dq_18_audit",
    f"""WITH {BUDGETED}, st AS (SELECT variant, count(*) AS c FROM fx_steps GROUP BY variant), rp AS (SELECT DISTINCT variant FROM fx_specs WHERE ref_voltage IS NOT NULL)
SELECT v.variant, coalesce(sp.p, '') AS spec_pages, coalesce(pp.p, '') AS proc_pages, rp.variant IS NOT NULL AS raw_specs_present, coalesce(st.c, 0) AS raw_step_count
FROM fx_variants v LEFT JOIN sp ON v.variant = sp.variant LEFT JOIN pp ON v.variant = pp.variant LEFT JOIN st ON v.variant = st.variant LEFT JOIN rp ON v.variant = rp.variant""",
    ("proc_pages", "steps", "specs", "variants"),
)(
    lambda fx: Q.audit(
        fx.variants, G.budget_pages(part_pages(fx), "spec"), G.budget_pages(part_pages(fx), "procedure"), fx.specs.filter("ref_voltage IS NOT NULL"), fx.steps, ["variant"]
    ).withColumns({c: F.array_join(c, ",") for c in ("spec_pages", "proc_pages")})
)
CALL = f"""{score_sql('fx_manual')}, tpg AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS rank FROM tp WHERE is_table QUALIFY rank <= 8),
 tr AS (SELECT DISTINCT l_orderkey AS doc_id, concat('PV', lpad(CAST(l_partkey AS VARCHAR), 6, '0')) AS variant FROM lineitem), {TAGS.replace('{fx}', 'fx_manual')},
 pr AS (SELECT tr.doc_id, variant, page_num, row_number() OVER (PARTITION BY tr.doc_id, variant ORDER BY page_num) AS rank FROM tr JOIN tg ON tr.doc_id = tg.doc_id WHERE is_procedure),
 fw AS (SELECT doc_id, variant FROM pr GROUP BY ALL HAVING count(*) <= 4),
 cx AS (SELECT fw.doc_id, variant, page_num, 0 AS t, rank FROM fw JOIN tpg ON fw.doc_id = tpg.doc_id WHERE rank <= 3 AND (fw.doc_id, variant, page_num) NOT IN (SELECT (doc_id, variant, page_num) FROM pr) UNION ALL SELECT doc_id, variant, page_num, 1, rank FROM pr)
SELECT doc_id, variant, page_num, CAST(row_number() OVER (PARTITION BY doc_id, variant ORDER BY t, rank) AS INT) AS rank FROM cx QUALIFY rank <= 8"""


def marked_pages(fx):
    tags = G.tag_pages(fx.stored("manual")).filter("is_procedure").select("doc_id", "page_num")
    return targets(fx).join(tags, "doc_id").withColumn("rank", F.col("page_num"))


register("pgc_07_call_pages", f"WITH {CALL.replace('WITH ', '')}", "manual")(
    lambda fx: G.call_pages(marked_pages(fx), G._head(G.score_table_pages(fx.stored("manual")).filter("is_table")))
)


# ---- segmentation ------------------------------------------------------------------------------------------------------
LINES = f"""l0 AS (SELECT doc_id, page_num, unnest({sql_lines('text')}) AS raw, generate_subscripts({sql_lines('text')}, 1) AS line_no FROM {{fx}}),
 li AS (SELECT doc_id, page_num, CAST(line_no AS INT) AS line_no, {sql_strip('raw')} AS line FROM l0 WHERE {sql_strip('raw')} <> '')"""
_NO = "CASE " + " ".join(f"WHEN regexp_matches(line, {lit('(?i)' + p)}) THEN {i}" for i, p in enumerate(P.SECTION_PATTERNS, 1)) + " END"
_TX = "CASE pattern_no " + " ".join(f"WHEN {i} THEN regexp_extract(line, {lit('(?i)' + p)}, 0)" for i, p in enumerate(P.SECTION_PATTERNS, 1)) + " END"
_FC = " OR ".join(f"regexp_matches(line, {lit('(?i)' + p)})" for p in P.FORCE_SPLIT_PATTERNS)
for _fx in ("manual", "doc_pages"):
    register(
        f"seg_01_tag_section_lines_{_fx}",
        f"WITH {LINES.replace('{fx}', 'fx_' + _fx)}, t AS (SELECT *, {_NO} AS pattern_no FROM li) SELECT doc_id, page_num, line_no, line, pattern_no, {_TX} AS header, {_FC} AS is_forced FROM t WHERE pattern_no IS NOT NULL",
        _fx,
    )(lambda fx, f=_fx: S.tag_section_lines(T.explode_lines(fx.unstored(f))))
# every document walked line by line, with the whole text of the block at hand
_CUR = sql_strip("cur")
BLOCKS = f"""l0 AS (SELECT doc_id, page_num, unnest({sql_lines('text')}) AS raw, generate_subscripts({sql_lines('text')}, 1) AS line_no FROM {{fx}}),
 l1 AS (SELECT doc_id, page_num, line_no, {sql_strip('raw')} AS line FROM l0),
 l2 AS (SELECT *, row_number() OVER d AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY page_num, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o,
  CASE WHEN line <> '' THEN {_NO} END AS pattern_no FROM l1 WINDOW d AS (PARTITION BY doc_id ORDER BY page_num, line_no)),
 l3 AS (SELECT doc_id, page_num, n, o, line, {_TX} AS head, pattern_no IS NOT NULL AND ({_FC}) AS forced FROM l2),
 walk AS (SELECT doc_id, 0 AS page_num, 0::BIGINT AS n, 1 AS idx, '' AS cur, '' AS header, NULL::BIGINT AS start_o, '' AS line FROM (SELECT DISTINCT doc_id FROM l3) x
  UNION ALL SELECT doc_id, page_num, n, idx + CASE WHEN split AND {_CUR} <> '' THEN 1 ELSE 0 END, CASE WHEN split THEN '' ELSE cur END || line || chr(10), CASE WHEN split THEN head ELSE header END,
   CASE WHEN split OR (start_o IS NULL AND line <> '') THEN o ELSE start_o END, line
   FROM (SELECT l.*, w.idx, w.cur, w.header, w.start_o, l.head IS NOT NULL AND ({_CUR} = '' OR l.forced OR (length({_CUR}) > {P.MIN_BLOCK_SIZE} AND NOT (
     regexp_matches(upper(right(cur, 200)), {lit(P.DANGLING_REFERENCE)}) AND NOT regexp_matches(upper(cur), {lit(P.TABLE_STRUCTURE)})))) AS split
    FROM walk w JOIN l3 l ON l.doc_id = w.doc_id AND l.n = w.n + 1) s),
 bk AS (SELECT doc_id, idx AS block_idx, cur, header, start_o, length(cur) AS n_chars FROM walk WHERE {_CUR} <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY n DESC) = 1)"""


def _best_of(name: str, words: str, rank: str, where: str) -> str:
    return f"""{name}t AS (SELECT doc_id, block_idx, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, block_idx, {words} AS ws FROM bk) x),
 {name} AS (SELECT * FROM (SELECT doc_id, block_idx, token, count(*) AS n, min(pos) AS f FROM {name}t WHERE {where} GROUP BY ALL) y QUALIFY row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY {rank} n DESC, f) = 1)"""


NAMED_BLOCKS = f"""{BLOCKS}, {_best_of('hc', sql_words('header', P.MODEL_CODE), '(n >= 2 AND length(token) >= 4) DESC,', 'true')},
 {_best_of('hw', sql_words('header', '[A-Z]{3,}'), '', 'token NOT IN ' + sql_list(P.STOP_WORDS))},
 nbk AS (SELECT doc_id, block_idx, start_o, header, n_chars, coalesce(hc.token, CASE WHEN hw.n >= 2 THEN hw.token END, concat('MACHINE_', block_idx)) AS machine, cur FROM bk LEFT JOIN hc USING (doc_id, block_idx) LEFT JOIN hw USING (doc_id, block_idx))"""


def blocks_sql(fx: str) -> str:
    return NAMED_BLOCKS.replace("{fx}", fx)


for _fx in ("manual", "doc_pages"):
    register(f"seg_02_segment_blocks_{_fx}", f"WITH RECURSIVE {blocks_sql('fx_' + _fx)} SELECT doc_id, block_idx, start_o, header, n_chars, machine FROM nbk", _fx)(
        lambda fx, f=_fx: S.segment_blocks(fx.stored(f))[0]
    )


def merged(fx, name="manual"):
    blocks, lines = S.segment_blocks(fx.stored(name))
    merge = S.merge_short_blocks(blocks, S.table_spec_blocks(lines))
    moved = lines.join(merge, ["doc_id", "block_idx"]).withColumn("block_idx", F.col("merged_idx")).drop("merged_idx")
    return S.merged_blocks(blocks, merge), moved


# a short block after a short one that was not absorbed itself is absorbed
register(
    "seg_03_merge_short_blocks",
    f"""WITH RECURSIVE {blocks_sql('fx_manual')}, sh AS (SELECT *, n_chars < {P.MIN_MERGE_SIZE} AND NOT regexp_matches(cur, {lit('(?is)' + P.TABLE_SPEC)}) AS short FROM nbk),
 mw AS (SELECT doc_id, block_idx, short, false AS absorbed, 1 AS merged_idx FROM sh WHERE block_idx = 1
  UNION ALL SELECT s.doc_id, s.block_idx, s.short, w.short AND NOT w.absorbed, w.merged_idx + CASE WHEN w.short AND NOT w.absorbed THEN 0 ELSE 1 END FROM mw w JOIN sh s ON s.doc_id = w.doc_id AND s.block_idx = w.block_idx + 1)
SELECT doc_id, merged_idx AS block_idx, arg_min(machine, block_idx) AS machine, arg_min(header, block_idx) AS header, arg_min(start_o, block_idx) AS start_o, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM sh JOIN mw USING (doc_id, block_idx) GROUP BY doc_id, merged_idx""",
    "manual",
)(lambda fx: merged(fx)[0])


def sized_blocks(fx):
    """Every page of a variant's procedure a block, of some size, with or without a table."""
    return fx.proc_pages.select(F.col("variant").alias("doc_id"), F.col("page_num").alias("block_idx"), F.expr("CAST(300 * (1 + page_num * 7 % 11) AS BIGINT) AS n_chars"), F.expr("page_num % 5 = 0 AS spec"))


# walked block by block: a short block after a short one that was not absorbed itself is absorbed
register(
    "seg_03_merge_sized_blocks",
    f"""WITH RECURSIVE b AS (SELECT variant AS doc_id, page_num AS block_idx, 300 * (1 + page_num * 7 % 11) < {P.MIN_MERGE_SIZE} AND page_num % 5 <> 0 AS short FROM fx_proc_pages),
 walk AS (SELECT doc_id, block_idx, short, false AS absorbed, 1 AS merged_idx FROM b WHERE block_idx = 1
  UNION ALL SELECT b.doc_id, b.block_idx, b.short, w.short AND NOT w.absorbed, w.merged_idx + CASE WHEN w.short AND NOT w.absorbed THEN 0 ELSE 1 END FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.block_idx = w.block_idx + 1)
SELECT doc_id, block_idx, merged_idx FROM walk""",
    "proc_pages",
)(lambda fx: S.merge_short_blocks(sized_blocks(fx), sized_blocks(fx).filter("spec").select("doc_id", "block_idx")))
# a page belongs to the blocks of its lines, and to the one that was open when it began
register(
    "seg_02_block_pages",
    f"""WITH RECURSIVE {blocks_sql('fx_manual')}, le AS (SELECT doc_id, page_num, max(idx) AS idx FROM walk WHERE n > 0 AND {_CUR} <> '' GROUP BY ALL)
SELECT DISTINCT doc_id, idx AS block_idx, page_num FROM walk WHERE line <> ''
UNION SELECT p.doc_id, max(le.idx), p.page_num FROM fx_manual p JOIN le ON le.doc_id = p.doc_id AND le.page_num < p.page_num GROUP BY p.doc_id, p.page_num""",
    "manual",
)(lambda fx: S.block_pages(fx.stored("manual"), S.segment_blocks(fx.stored("manual"))[1]))
# every page a block with a placeholder name
register(
    "seg_04_resolve_names",
    f"""WITH {_tokens_sql('fx_manual', P.MODEL_CODE).replace('doc_id, page_num, unnest', 'doc_id, page_num AS page_num, unnest')},
 pt AS (SELECT doc_id, page_num, token, count(*) AS n, min(pos) AS f FROM t GROUP BY ALL)
SELECT p.doc_id, p.page_num AS block_idx, coalesce(token, concat('MACHINE_', CAST(p.page_num AS VARCHAR))) AS machine FROM fx_manual p LEFT JOIN (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY n >= 2 AND length(token) >= 4 DESC, n DESC, f) = 1) b ON p.doc_id = b.doc_id AND p.page_num = b.page_num""",
    "manual",
)(
    lambda fx: S.resolve_names(
        fx.stored("manual").select("doc_id", F.col("page_num").alias("block_idx"), F.concat(F.lit("MACHINE_"), F.col("page_num").cast("string")).alias("machine")),
        T.explode_lines(fx.stored("manual")).select("doc_id", F.col("page_num").alias("block_idx"), F.col("line_no").alias("o"), "line"),
    )
)
NAMED = "SELECT doc_id, page_num AS block_idx, CASE page_num % 3 WHEN 0 THEN 'SM1' WHEN 1 THEN concat('SM', CAST(10 + doc_id % 9 AS STRING)) ELSE 'DSMR' END AS machine, doc_id % 11 = 0 AS is_scope FROM"


def named(fx):
    """Every page a block; names repeat within a document."""
    return fx.spark.sql(NAMED + " {m}", m=fx.stored("manual"))


register(
    "seg_05_dedupe_names",
    f"""WITH nb AS ({NAMED} fx_manual), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, machine ORDER BY block_idx) AS k FROM nb)
SELECT doc_id, block_idx, CASE WHEN k > 1 THEN concat(machine, '_', CAST(k AS VARCHAR)) ELSE machine END AS machine, is_scope FROM k""",
    "manual",
)(lambda fx: S.dedupe_names(named(fx)))


def requests(fx):
    one = requested(fx).withColumn("request_no", F.lit(2))
    return one.unionByName(one.select("doc_id", F.lit("dsmr").alias("machine"), F.lit(1).alias("request_no")))


REQ = f"{REQUESTED_SQL}, r2 AS (SELECT doc_id, upper(machine) AS machine, 2 AS request_no FROM rq UNION ALL SELECT doc_id, 'DSMR', 1 FROM rq), nb AS ({NAMED} fx_manual)"
register(
    "seg_06_filter_merge_requested",
    f"WITH {REQ} SELECT doc_id, machine, request_no, min(block_idx) AS first_block, count(*) AS n_blocks, count(*) AS n_pages FROM nb JOIN r2 USING (doc_id, machine) GROUP BY ALL",
    "manual",
)(lambda fx: S.merged_summary(S.filter_merge_requested(named(fx), requests(fx)), named(fx).select("doc_id", "block_idx", F.col("block_idx").alias("page_num"))))
FAN = f"""{_SCOPE % ''}, w AS (SELECT doc_id, {sql_words('text', P.SCOPE_CODE)} AS ws FROM s), ft AS (SELECT doc_id, unnest(ws) AS machine, generate_subscripts(ws, 1) AS pos FROM w),
 fm AS (SELECT doc_id, machine, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS INT) AS block_idx FROM ft GROUP BY doc_id, machine), f2 AS (SELECT doc_id FROM fm GROUP BY doc_id HAVING count(*) >= 2)"""
register("seg_07_scope_fanout", f"WITH {FAN} SELECT doc_id, block_idx, machine, true AS is_scope FROM fm SEMI JOIN f2 USING (doc_id)", "manual")(lambda fx: S.scope_fanout(fx.stored("manual")))
HALF = "doc_id % 2 = 0"
register(
    "seg_07_scope_fanout_requested",
    f"WITH {FAN}, {REQUESTED_SQL}, rh AS (SELECT doc_id, upper(machine) || '_A' AS machine FROM rq WHERE {HALF}) SELECT doc_id, block_idx, machine, true AS is_scope FROM fm SEMI JOIN f2 USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM rh) OR (doc_id, machine) IN (SELECT (doc_id, machine) FROM rh)",
    "manual",
)(lambda fx: S.scope_fanout(fx.stored("manual"), requested(fx).filter(HALF).withColumn("machine", F.concat("machine", F.lit("_a")))))
DETECT = _tokens_sql("fx_manual", "[A-Z][A-Z0-9]{3,9}", ", contains(text, token) AS verbatim").replace("GROUP BY doc_id, token", "GROUP BY doc_id, page_num, token").replace("SELECT doc_id, token, count", "SELECT doc_id, page_num, token, count").replace(
    "FROM t GROUP", "FROM t WHERE regexp_matches(token, '[0-9]') GROUP"
)
DETECTED = """kk AS (SELECT *, n >= 3 AS strong FROM c WHERE n >= 3 OR verbatim), dr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY strong DESC, n DESC, length(token), f) AS rank, bool_or(strong) OVER (PARTITION BY doc_id, page_num) AS anys FROM kk),
 de AS (SELECT doc_id, page_num AS block_idx, token AS variant FROM dr WHERE rank <= 8 AND (strong OR NOT anys))"""
SPLIT = f"""WITH RECURSIVE {DETECT}, {DETECTED}, vs AS (SELECT doc_id, block_idx AS page_num, list_sort(list(DISTINCT variant)) AS v FROM de GROUP BY ALL),
 pg AS (SELECT m.doc_id, m.page_num, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.page_num) AS n, coalesce(v, CAST([] AS VARCHAR[])) AS v FROM fx_manual m LEFT JOIN vs ON m.doc_id = vs.doc_id AND m.page_num = vs.page_num),
 walk AS (SELECT doc_id, page_num, n, list_sort(v) AS seen, n AS first, 1 AS group_no FROM pg WHERE n = 1
  UNION ALL SELECT doc_id, page_num, n, CASE WHEN split THEN v ELSE list_sort(list_distinct(list_concat(seen, v))) END, CASE WHEN split THEN n ELSE first END, group_no + CASE WHEN split THEN 1 ELSE 0 END
   FROM (SELECT p.*, w.seen, w.first, w.group_no, len(p.v) >= 2 AND p.v <> w.seen AND p.n - w.first >= 2 AS split FROM walk w JOIN pg p ON p.doc_id = w.doc_id AND p.n = w.n + 1) x)
SELECT doc_id, page_num, group_no FROM walk"""
for _fx in ("manual", "doc_pages", "code_pages"):
    register(f"seg_08_density_split_{_fx}", SPLIT.replace("fx_manual", f"fx_{_fx}"), _fx)(lambda fx, f=_fx: S.density_split(fx.stored(f)))
register(
    "seg_09_select_variants",
    f"""WITH {DETECT}, nb AS ({NAMED} fx_manual), {REQUESTED_SQL}, rv AS (SELECT doc_id, upper(machine) AS machine, CASE WHEN doc_id % 4 = 0 THEN concat('MAG03D', CAST(100 + doc_id % 40 AS VARCHAR)) END AS variant FROM rq WHERE {HALF}),
 {DETECTED},
 nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS no FROM nb),
 op AS (SELECT * FROM nn WHERE (doc_id, machine) IN (SELECT (doc_id, machine) FROM rv) OR (doc_id NOT IN (SELECT doc_id FROM rv) AND no <= 5) QUALIFY row_number() OVER (PARTITION BY doc_id, machine ORDER BY block_idx) = 1),
 pw AS (SELECT DISTINCT doc_id, page_num AS block_idx, unnest(regexp_extract_all(upper(text), '[\\p{{L}}\\p{{N}}_]+')) AS variant FROM fx_manual),
 al AS (SELECT doc_id, block_idx, machine, machine AS variant, 1 AS tier FROM op WHERE is_scope
  UNION ALL SELECT op.doc_id, op.block_idx, op.machine, rv.variant, 2 FROM op JOIN rv ON op.doc_id = rv.doc_id AND op.machine = rv.machine JOIN pw ON pw.doc_id = op.doc_id AND pw.block_idx = op.block_idx AND pw.variant = rv.variant WHERE NOT is_scope
  UNION ALL SELECT op.doc_id, op.block_idx, op.machine, de.variant, 3 FROM op JOIN de ON op.doc_id = de.doc_id AND op.block_idx = de.block_idx WHERE NOT is_scope AND de.variant <> machine
  UNION ALL SELECT doc_id, block_idx, machine, machine, 4 FROM op WHERE NOT is_scope)
SELECT doc_id, block_idx, machine, variant, ['scope', 'request', 'detected', 'machine'][tier] AS source FROM al QUALIFY tier = min(tier) OVER (PARTITION BY doc_id, block_idx)""",
    "manual",
)(
    lambda fx: (
        lambda rq: S.select_variants(
            named(fx), T.detect_variants(fx.stored("manual"), ["doc_id", "page_num"]).withColumnRenamed("page_num", "block_idx"), rq,
            T.name_mentions(fx.stored("manual"), rq.filter("variant IS NOT NULL").select("doc_id", F.col("variant").alias("name"))).select("doc_id", F.col("page_num").alias("block_idx"), F.col("name").alias("variant")).distinct(),
        )
    )(
        requested(fx).filter(HALF).select(
            "doc_id", F.upper("machine").alias("machine"), F.expr("CASE WHEN doc_id % 4 = 0 THEN concat('MAG03D', CAST(100 + doc_id % 40 AS STRING)) END").alias("variant")
        )
    )
)
