"""Limit-table family queries."""

from pyspark.sql import functions as F

from pageledger.functions import patterns as P
from pageledger.operators import families as FA
from pageledger.plans.registry import lit, register, sql_strip
from pageledger.plans.replay import check_tables, replay

T, TR, TRF = "func_tables", ("func_tables", "func_rows"), ("func_tables", "func_rows", "families")

PARTS = f"list_filter(list_transform(string_split(h, '/'), lambda p: {sql_strip('p')}), lambda p: p <> '')"
EXPAND = f"""hx AS (SELECT family, table_idx, unnest(columns) AS h, generate_subscripts(columns, 1) AS hi FROM fx_func_tables),
 ln AS (SELECT family, table_idx, length(h) AS len, count(*) AS n, min(hi) AS f FROM hx WHERE NOT contains(h, '/') AND trim(h) <> '' GROUP BY ALL),
 md AS (SELECT family, table_idx, len AS want FROM ln QUALIFY row_number() OVER (PARTITION BY family, table_idx ORDER BY n DESC, f) = 1),
 px AS (SELECT family, table_idx, hi, {PARTS}[1] AS head, unnest({PARTS}) AS p, generate_subscripts({PARTS}, 1) AS pi FROM hx),
 pe AS (SELECT px.family, px.table_idx, hi, pi, CASE WHEN pi > 1 AND coalesce(want, length(head)) - length(p) BETWEEN 1 AND length(head) THEN concat(left(head, (coalesce(want, length(head)) - length(p))::INT), p) ELSE p END AS c
   FROM px LEFT JOIN md USING (family, table_idx)),
 ec AS (SELECT family, table_idx, list(c ORDER BY hi, pi) AS cols FROM pe GROUP BY ALL)"""
register("fam_04_expand_slash", f"WITH {EXPAND} SELECT family, table_idx, array_to_string(cols, '|') AS columns FROM ec", T)(
    lambda fx: FA.expand_slash(fx.func_tables).select("family", "table_idx", F.array_join("columns", "|").alias("columns"))
)
PARSE = f"""{EXPAND}, tc AS (SELECT t.family, t.table_idx, title, kind, columns AS raw, CASE WHEN kind = 'spec' THEN list_transform(cols, lambda c: regexp_replace(c, '\\s*-\\s*', '-', 'g')) ELSE CAST([] AS VARCHAR[]) END AS cols
   FROM fx_func_tables t JOIN ec USING (family, table_idx)),
 np AS (SELECT family, table_idx, hi, count(*) AS k FROM px GROUP BY ALL),
 jr AS (SELECT r.*, title, kind, raw, cols FROM fx_func_rows r JOIN tc USING (family, table_idx)),
 rv AS (SELECT jr.family, jr.table_idx, row_idx, list(vals[np.hi] ORDER BY np.hi, g) AS v FROM jr JOIN np ON jr.family = np.family AND jr.table_idx = np.table_idx, LATERAL (SELECT unnest(range(np.k)) AS g)
   WHERE kind = 'spec' AND len(vals) = len(raw) AND len(vals) <> len(cols) GROUP BY ALL),
 fr AS (SELECT jr.family, jr.table_idx, jr.row_idx, parameter, setting, title, kind, cols, coalesce(v, vals) AS vals FROM jr LEFT JOIN rv USING (family, table_idx, row_idx)),
 bd AS (SELECT * FROM fr WHERE kind = 'spec' AND len(vals) <> len(cols)),
 pt AS (SELECT family, table_idx, title, CASE WHEN (family, table_idx) IN (SELECT (family, table_idx) FROM bd) THEN 'unverified' ELSE kind END AS kind, cols FROM tc)"""
register("fam_05_parse_tables", f"WITH {PARSE} SELECT family, table_idx, title, kind, array_to_string(cols, '|') AS columns FROM pt", TR)(
    lambda fx: FA.parse_tables(fx.func_tables, fx.func_rows)[0].withColumn("columns", F.array_join("columns", "|"))
)
register(
    "fam_05_parse_rows", f"WITH {PARSE} SELECT family, table_idx, row_idx, parameter, setting, array_to_string(vals, '|') AS vals FROM fr", TR
)(lambda fx: FA.parse_tables(fx.func_tables, fx.func_rows)[1].withColumn("vals", F.array_join("vals", "|")))
FLAG = "SELECT {t}family, {t}table_idx, '{r}' AS rule_id, {d} AS detail, {m} AS message, {i} AS info"
PAD = FLAG.format(t="", r="pad_trim_ban", d="parameter", i="false", m="concat('[', title, '] row ''', parameter, '''/''', setting, ''': ', CAST(len(vals) AS VARCHAR), ' values vs ', CAST(len(cols) AS VARCHAR), ' columns, so the table is not verified')") + " FROM bd"
register("fam_05_pad_trim_flags", f"WITH {PARSE} {PAD}", TR)(lambda fx: FA.parse_tables(fx.func_tables, fx.func_rows)[2])
TORN = FLAG.format(t="r.", r="torn_row", d="trim(parameter)", i="false", m="concat('[', title, '] the row looks torn: parameter ''', trim(parameter), ''' names nothing')") + """ FROM fx_func_rows r JOIN fx_func_tables t USING (family, table_idx)
 WHERE kind = 'spec' AND trim(parameter) <> '' AND length(regexp_replace(parameter, '[^A-Za-z]', '', 'g')) < 2"""
register("fam_06_torn_rows", TORN, TR)(lambda fx: FA.torn_rows(fx.func_tables, fx.func_rows))

_C = sql_strip("c")
_BARE = f"trim(regexp_replace({_C}, {lit(P.BRAND_SUFFIX)}, ''))"
BAD = {
    "ph": f"list_filter(cols, lambda c: {_C} = '' OR regexp_matches({_C}, {lit('(?i)' + P.PLACEHOLDER_COLUMN)}))",
    "nm": f"list_filter(cols, lambda c: regexp_matches({_C}, {lit('(?i)' + P.NON_MODEL_COLUMN)}))",
    "vf": f"list_filter(cols, lambda c: regexp_matches({_BARE}, '\\s') AND regexp_matches(regexp_replace({_BARE}, '^\\S+\\s+', ''), {lit(P.VALUE_SUFFIX)}))",
    "sp": f"list_filter(cols, lambda c: regexp_matches({_BARE}, {lit(P.SPLIT_HEADER)}))",
}
CHAIN = f"""{PARSE}, bc AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in BAD.items())} FROM pt),
 ch AS (SELECT *, CASE WHEN kind <> 'spec' OR len(cols) = 0 THEN -1 WHEN len(ph) > 0 THEN 0 WHEN len(nm) > len(cols) / 2 THEN 1 WHEN len(vf) > 0 THEN 2 ELSE 3 END AS fail FROM bc),
 ck AS (SELECT family, table_idx, title, cols, CASE WHEN fail IN (0, 2) THEN 'unverified' WHEN fail = 1 THEN 'aux' ELSE kind END AS kind, fail, ph, nm, vf, sp FROM ch)"""
register(
    "fam_07_check_headers",
    f"WITH {CHAIN} SELECT family, table_idx, title, kind, array_to_string(cols, '|') AS columns, CASE WHEN fail < 0 THEN 0 ELSE fail + 1 END AS n_reached FROM ck",
    TR,
)(
    lambda fx: FA.check_headers(FA.parse_tables(fx.func_tables, fx.func_rows)[0])[0].select(
        "family", "table_idx", "title", "kind", F.array_join("columns", "|").alias("columns"), F.size("reached").alias("n_reached")
    )
)


def listed(x: str) -> str:
    return f"concat('[''', array_to_string({x}, ''', '''), ''']')"


def _stopped(rule, names, text, n):
    return FLAG.format(t="", r=rule, d="CAST(NULL AS VARCHAR)", i="false", m=f"concat('[', title, '] ', {text.format(n=listed(names))})") + f" FROM ck WHERE fail = {n}"


HEADER_FLAGS = " UNION ALL ".join(
    [
        _stopped("unreadable_header", "ph", "'headers that cannot be read: ', {n}, ', so the table is not verified'", 0),
        _stopped("non_model_column", "nm", "'headers that are voltages: ', {n}, ', so the table is auxiliary'", 1),
        _stopped("value_fragment", "vf", "'headers cut from values: ', {n}, ', so the table is not verified'", 2),
        "SELECT family, table_idx, 'split_header', c, concat('[', title, '] the header looks split: ''', c, ''''), false FROM (SELECT family, table_idx, title, unnest(sp) AS c FROM ck WHERE fail = 3)",
    ]
)
register("fam_07_header_flags", f"WITH {CHAIN} {HEADER_FLAGS}", TR)(
    lambda fx: FA.check_headers(FA.parse_tables(fx.func_tables, fx.func_rows)[0])[1]
)
PFX = "upper(left(regexp_extract(trim({c}), '^([A-Za-z]+)', 1), 3))"
VOTE = f"""{CHAIN}, vo AS (SELECT family, title_submachines AS ts, CASE WHEN title_submachines IS NULL THEN 'could_not_run' WHEN NOT external THEN 'na' ELSE 'ran' END AS outcome FROM fx_families),
 tp AS (SELECT family, {PFX.format(c='s')} AS p, i FROM (SELECT family, unnest(ts) AS s, generate_subscripts(ts, 1) AS i FROM vo WHERE outcome = 'ran') x WHERE s <> ''),
 tm AS (SELECT family, p AS tpv FROM (SELECT family, p, count(*) AS n, min(i) AS f FROM tp GROUP BY ALL) y QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, f) = 1),
 cp AS (SELECT family, table_idx, title, list_distinct(list_transform(cols, lambda c: {PFX.format(c='c')})) AS ps FROM ck WHERE kind = 'spec' AND len(cols) > 0)"""
VOTE_FLAGS = f"""SELECT family, CAST(NULL AS INT) AS table_idx, 'cross_source_prefix_vote' AS rule_id, CAST(NULL AS VARCHAR) AS detail,
 'the vote on prefixes needs the title list, which is unknown' AS message, false AS info FROM vo WHERE outcome = 'could_not_run'
UNION ALL SELECT cp.family, table_idx, 'cross_source_prefix_vote', ps[1], concat('[', title, '] all columns begin with ''', ps[1], ''', the title''s models with ''', tpv, '''; reported, not changed'), false
 FROM cp JOIN tm USING (family) WHERE len(ps) = 1 AND ps[1] <> '' AND tpv <> '' AND ps[1] <> tpv"""


def checked(fx):
    return check_tables(fx.func_tables, fx.func_rows, fx.families)


register("fam_08_prefix_vote", f"WITH {VOTE} {VOTE_FLAGS}", TRF)(lambda fx: FA.prefix_vote(checked(fx).tables, fx.families)[1])
COVER = f"""{VOTE}, kn AS (SELECT family, title_submachines AS ts FROM fx_families WHERE external AND len(title_submachines) > 0),
 ti AS (SELECT DISTINCT family, unnest(ts) AS code FROM kn), ta AS (SELECT DISTINCT family, unnest(cols) AS code FROM ck SEMI JOIN kn USING (family) WHERE kind = 'spec'),
 cv AS (SELECT family, 'title' AS side, code FROM ti ANTI JOIN ta USING (family, code) UNION ALL SELECT family, 'table', code FROM ta ANTI JOIN ti USING (family, code))"""
register("fam_09_title_coverage", f"WITH {COVER} SELECT * FROM cv", TRF)(lambda fx: FA.title_coverage(checked(fx).tables, fx.families))
COVER_FLAGS = """SELECT family, CAST(NULL AS INT) AS table_idx, 'title_coverage' AS rule_id, side AS detail,
 CASE WHEN side = 'title' THEN concat('only in the title: [''', string_agg(code, ''', ''' ORDER BY code), '''] stand in no spec table')
  ELSE concat('only in tables: [''', string_agg(code, ''', ''' ORDER BY code), ''']') END AS message, true AS info FROM cv GROUP BY family, side"""
register("fam_09_coverage_flags", f"WITH {COVER} {COVER_FLAGS}", TRF)(
    lambda fx: FA.coverage_flags(FA.title_coverage(checked(fx).tables, fx.families))
)
UNION = f"{CHAIN}, su AS (SELECT family, code, CAST(row_number() OVER (PARTITION BY family ORDER BY min(struct_pack(t := table_idx, i := i))) AS INT) AS code_no FROM (SELECT family, table_idx, unnest(cols) AS code, generate_subscripts(cols, 1) AS i FROM ck WHERE kind = 'spec') x GROUP BY family, code)"
register("fam_10_submachine_union", f"WITH {UNION} SELECT * FROM su", TR)(lambda fx: FA.submachine_union(checked(fx).tables))
ALL_FLAGS = f"{COVER}, af AS ({PAD} UNION ALL {TORN} UNION ALL {HEADER_FLAGS} UNION ALL {VOTE_FLAGS} UNION ALL {COVER_FLAGS})"
STATUS = f"""{ALL_FLAGS}, rc AS (SELECT family, max(fail) AS deep FROM ck GROUP BY family),
 fs AS (SELECT vo.family, 1 + CASE WHEN deep < 0 THEN 4 ELSE deep + 1 END + CASE WHEN outcome = 'ran' THEN 1 ELSE 0 END AS n_run, CASE WHEN outcome = 'na' THEN 'cross_source_prefix_vote' ELSE '' END AS na,
  array_to_string(list_concat(CASE WHEN deep < 0 THEN CAST([] AS VARCHAR[]) ELSE ['unreadable_header', 'non_model_column', 'value_fragment', 'split_header'][deep + 2:4] END, CASE WHEN outcome = 'could_not_run' THEN ['cross_source_prefix_vote'] ELSE CAST([] AS VARCHAR[]) END), ', ') AS not_run,
  CAST((SELECT count(*) FROM af WHERE af.family = vo.family AND NOT info) AS BIGINT) AS flags, CAST((SELECT count(*) FROM af WHERE af.family = vo.family AND info) AS BIGINT) AS infos FROM vo JOIN rc USING (family))"""
register(
    "fam_11_family_status",
    f"WITH {STATUS} SELECT family, CASE WHEN not_run = '' AND flags = 0 THEN 'CLEAN' ELSE 'NOT CLEAN' END AS status, CAST(n_run AS INT) AS n_run, na, not_run, flags, infos FROM fs",
    TRF,
)(
    lambda fx: checked(fx).status.select(
        "family", "status", F.size("run").alias("n_run"), F.array_join("na", ", ").alias("na"), F.array_join("not_run", ", ").alias("not_run"), "flags", "infos"
    )
)
LIMITS = f"""{CHAIN}, mo AS (SELECT family, table_idx, title, code AS model, min(i) AS i FROM (SELECT family, table_idx, title, unnest(cols) AS code, generate_subscripts(cols, 1) AS i FROM ck WHERE kind = 'spec') x GROUP BY ALL),
 lm AS (SELECT fr.family, fr.table_idx, mo.title, row_idx, model, parameter, setting, coalesce(vals[i], '') AS "limit" FROM fr JOIN mo ON fr.family = mo.family AND fr.table_idx = mo.table_idx WHERE upper(trim(coalesce(vals[i], ''))) <> 'NA')"""
register(
    "fam_12_limits_by_model",
    f"WITH {LIMITS} SELECT * REPLACE (CASE WHEN parameter IS NOT DISTINCT FROM lag(parameter) OVER (PARTITION BY family, table_idx, model ORDER BY row_idx) THEN '' ELSE parameter END AS parameter) FROM lm",
    TR,
)(lambda fx: (lambda r: FA.limits_by_model(r.tables, r.rows))(checked(fx)))
register(
    "fam_13_aux_rows",
    f"""WITH {CHAIN} SELECT ck.family, ck.table_idx, ck.title, row_idx, parameter, setting, array_to_string(vals, ', ') AS "limit" FROM fr JOIN ck ON fr.family = ck.family AND fr.table_idx = ck.table_idx WHERE ck.kind = 'aux'""",
    TR,
)(lambda fx: (lambda r: FA.aux_rows(r.tables, r.rows))(checked(fx)))
REPORT = f"""{STATUS}, pn AS (SELECT family, table_idx, count(*) AS n FROM fx_func_rows GROUP BY ALL),
 kc AS (SELECT family, count_if(kind = 'spec')::BIGINT AS spec_tables, count_if(kind = 'aux')::BIGINT AS aux_tables, count_if(kind = 'unverified')::BIGINT AS unverified_tables, CAST(sum(CASE WHEN kind = 'spec' THEN n ELSE 0 END) AS BIGINT) AS spec_rows FROM ck JOIN pn USING (family, table_idx) GROUP BY family)"""
register(
    "fam_14_family_report",
    f"""WITH {REPORT} SELECT family, CASE WHEN not_run = '' AND flags = 0 THEN 'CLEAN' ELSE 'NOT CLEAN' END AS status, first_page, last_page, CAST(n_run AS INT) AS checks_run, na AS checks_na, not_run AS checks_not_run,
 spec_tables, aux_tables, unverified_tables, spec_rows, flags, infos FROM fs JOIN fx_families USING (family) JOIN kc USING (family)""",
    TRF,
)(lambda fx: (lambda r: FA.family_report(fx.families, r.status, r.tables, r.rows))(checked(fx)))
register(
    "fam_15_blocked_tables",
    f"""WITH {ALL_FLAGS}, bl AS (SELECT family, table_idx, title FROM ck WHERE kind = 'unverified'), rs AS (SELECT family, table_idx, count(*) AS reasons FROM af GROUP BY ALL),
 hd AS (SELECT family, table_idx, row_idx, parameter, setting, array_to_string(vals, '|') AS vals FROM fr WHERE row_idx <= 3)
SELECT bl.family, bl.table_idx, bl.title, coalesce(reasons, 0) AS reasons, row_idx, parameter, setting, vals FROM bl LEFT JOIN rs USING (family, table_idx) LEFT JOIN hd USING (family, table_idx)""",
    TRF,
)(lambda fx: (lambda r: FA.blocked_tables(r.tables, r.rows, r.flags))(checked(fx)))
register(
    "fam_16_top_families",
    f"""WITH {REPORT}, tf AS (SELECT family, spec_rows FROM kc ORDER BY spec_rows DESC, family LIMIT 2),
 bt AS (SELECT family, table_idx, title FROM ck JOIN pn USING (family, table_idx) WHERE kind = 'spec' QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, table_idx) = 1)
SELECT fr.family, fr.table_idx, bt.title, spec_rows, row_idx, parameter, setting, array_to_string(vals, '|') AS vals FROM tf JOIN bt USING (family) JOIN fr ON fr.family = bt.family AND fr.table_idx = bt.table_idx WHERE row_idx <= 8""",
    TRF,
)(lambda fx: (lambda r: FA.top_families(r.tables, r.rows))(checked(fx)))

# ---- pages to families -------------------------------------------------------------------------------------------------

def meta_replies(fx):
    """One reply per three pages; the first page is listed twice, and some replies are cut off."""
    body = F.expr(
        """concat('{"page_num": ', CAST(page_num AS STRING), ', "content_type": ', CASE WHEN content_type IS NULL THEN 'null' ELSE concat('"', content_type, '"') END,
 ', "family_label": ', CASE WHEN family_label IS NULL THEN 'null' ELSE concat('"', family_label, '"') END, ', "submachines_in_title": ["AB', CAST(page_num AS STRING), '"]}')"""
    )
    chunk = F.floor((F.col("page_num") - 1) / F.lit(3)).cast("int")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", body.alias("b")))), lambda x: x["b"]), ", ")
    # a reply answers for at most three pages
    return fx.page_meta.groupBy("doc_id", chunk.alias("chunk_idx")).agg(
        F.concat(F.lit("[{\"page_num\": 1, \"content_type\": \"stale\"}, "), parts, F.when(F.col("doc_id") % 5 == 0, "").otherwise("]")).alias("body")
    )


META = """pm AS (SELECT doc_id, page_num, CASE WHEN doc_id % 5 = 0 THEN 'procedure' ELSE coalesce(content_type, 'procedure') END AS content_type, CASE WHEN doc_id % 5 <> 0 THEN family_label END AS family_label,
 CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('AB', CAST(page_num AS VARCHAR)) END AS title FROM fx_page_meta)"""
register("fam_01_page_meta", f"WITH {META} SELECT * FROM pm", "page_meta")(
    lambda fx: FA.page_meta(fx.page_meta.select("doc_id", "page_num"), meta_replies(fx), 3).select(
        "doc_id", "page_num", "content_type", "family_label", F.array_join("submachines_in_title", "|").alias("title")
    )
)
register(
    "fam_02_group_families",
    """WITH s AS (SELECT *, coalesce(content_type IN ('family_start', 'mixed') AND length(family_label) > 0, false) AS st FROM fx_page_meta),
 n AS (SELECT *, CAST(sum(st::INT) OVER (PARTITION BY doc_id ORDER BY page_num) AS INT) AS fno, bool_or(st) OVER (PARTITION BY doc_id) AS has FROM s),
 k AS (SELECT doc_id, page_num, family_label, CASE WHEN has THEN st ELSE page_num = 1 END AS st, CASE WHEN has THEN fno ELSE 1 END AS family_no FROM n WHERE NOT has OR fno > 0)
SELECT doc_id, family_no, coalesce(nullif(max(CASE WHEN st THEN family_label END), ''), concat('FAMILY_', CAST(family_no AS VARCHAR))) AS label, min(page_num) AS first_page, max(page_num) AS last_page, count(*) AS n_pages FROM k GROUP BY doc_id, family_no""",
    "page_meta",
)(lambda fx: FA.group_families(fx.page_meta).drop("title_submachines"))


def side_meta(fx):
    return fx.table_replies.filter("substr(family, -1) IN ('1', '4', '9')").select(
        "family", F.concat(F.lit("meta "), "family").alias("label"), F.expr("CASE WHEN substr(family, -1) = '4' THEN NULL ELSE array('AB1') END").alias("title_submachines"),
        F.lit(True).alias("external"),
    )


RB = "rb AS (SELECT family, CAST(substr(family, 5) AS BIGINT) AS id FROM fx_table_replies)"
FAMILY_META = f"""{RB}, fm AS (SELECT family, id, CASE WHEN id % 10 <> 9 AND id % 13 <> 5 AND id % 3 = 0 THEN 'reply' WHEN id % 10 IN (1, 4, 9) THEN 'meta' ELSE 'derived' END AS source FROM rb),
 f3 AS (SELECT family, id, source, CASE source WHEN 'reply' THEN concat('F', CAST(id AS VARCHAR)) WHEN 'meta' THEN concat('meta ', family) ELSE replace(family, '_', ' ') END AS label,
  CASE source WHEN 'reply' THEN CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'AB1|AB2' END WHEN 'meta' THEN CASE WHEN id % 10 = 4 THEN NULL ELSE 'AB1' END ELSE CASE WHEN id % 13 = 5 THEN '' WHEN id % 5 = 0 THEN 'AB1|Column 2' ELSE 'AB1|AB2' END END AS title, source <> 'derived' AS external FROM fm)"""
register("fam_03_family_meta", f"WITH {FAMILY_META} SELECT family, label, title, external, source FROM f3", "table_replies")(
    lambda fx: FA.family_meta(FA.parse_replies(fx.table_replies), side_meta(fx)).select(
        "family", "label", F.array_join("title_submachines", "|").alias("title"), "external", "source"
    )
)
register(
    "fam_17_replay_status",
    f"""WITH {FAMILY_META}, c AS (SELECT family, id % 10 = 9 OR id % 13 = 5 AS broken, id % 7 = 0 AS short, id % 11 = 3 AS mal, id % 11 = 7 AS junk, id % 5 = 0 AND id % 7 <> 0 AND id % 11 <> 3 AS ph, title IS NULL AS unknown, NOT external AS na, source = 'derived' AS d, title FROM f3),
 n AS (SELECT *, CASE WHEN broken THEN 1 ELSE (CASE WHEN short THEN 2 ELSE 0 END) + mal::INT + junk::INT + (CASE WHEN ph THEN 1 ELSE 0 END) + (CASE WHEN unknown THEN 1 ELSE 0 END) END AS flags,
  CASE WHEN broken THEN 5 ELSE (CASE WHEN ph THEN 3 ELSE 0 END) + (CASE WHEN unknown THEN 1 ELSE 0 END) END AS not_run FROM c)
SELECT family, CASE WHEN flags = 0 AND not_run = 0 THEN 'CLEAN' ELSE 'NOT CLEAN' END AS status, CAST(not_run AS INT) AS not_run, CAST(flags AS BIGINT) AS flags,
 CAST(CASE WHEN broken OR unknown OR na OR title = '' THEN 0 WHEN short OR mal OR ph THEN 1 WHEN title = 'AB1' THEN 1 ELSE 0 END AS BIGINT) AS infos FROM n""",
    "table_replies",
)(lambda fx: replay(fx.table_replies, side_meta(fx)).status.select("family", "status", F.size("not_run").alias("not_run"), "flags", "infos"))
