"""Corpus text queries."""

from pyspark.sql import functions as F

from pageledger.functions import patterns as P
from pageledger.operators import text as T
from pageledger.plans.registry import lit, register, sql_lines, sql_list, sql_strip, sql_words


def at(c: str = "first_at"):
    return [F.col(f"{c}.page_num").alias("first_page")]


register("src_01b_page_text", "SELECT doc_id, page_num, text FROM fx_pages", "pages")(lambda fx: T.page_text(fx.pages))

register(
    "txt_01_explode_lines",
    f"""WITH l AS (SELECT doc_id, page_num, {sql_lines('text')} AS ls FROM fx_conv_pages),
 e AS (SELECT doc_id, page_num, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line_no FROM l)
SELECT doc_id, page_num, CAST(line_no AS INT) AS line_no, {sql_strip('raw')} AS line FROM e WHERE {sql_strip('raw')} <> ''""",
    "conv_pages",
)(lambda fx: T.explode_lines(fx.conv_pages))


def _repeated_sql(fx: str, share: float) -> str:
    return f"""WITH l AS (SELECT DISTINCT doc_id, page_num, {sql_strip('raw')} AS line FROM
   (SELECT doc_id, page_num, unnest({sql_lines('text')}) AS raw FROM {fx}) x WHERE length({sql_strip('raw')}) > 10),
 n AS (SELECT doc_id, count(*) AS total FROM {fx} GROUP BY doc_id),
 r AS (SELECT l.doc_id, line, count(*) AS n_pages FROM l GROUP BY l.doc_id, line)
"""


_PICK = "SELECT doc_id, line, n_pages FROM r JOIN n USING (doc_id) WHERE n_pages >= greatest(2, total * {share})"
for _name, _fx, _share in (("txt_02_repeated_lines", "pages", 0.5), ("txt_02_repeated_lines_corpus", "doc_pages", 0.02)):
    register(_name, _repeated_sql(f"fx_{_fx}", _share) + _PICK.format(share=_share), _fx)(
        lambda fx, f=_fx, s=_share: T.repeated_lines(getattr(fx, f), s)
    )
for _name, _fx, _share in (("txt_03_strip_repeated_lines", "pages", 0.5), ("txt_03_strip_repeated_lines_corpus", "doc_pages", 0.02)):
    register(
        _name,
        _repeated_sql(f"fx_{_fx}", _share)
        + f""", h AS ({_PICK.format(share=_share)}), ha AS (SELECT doc_id, list(line) AS heads FROM h GROUP BY doc_id)
SELECT p.doc_id, page_num, CASE WHEN heads IS NULL THEN text ELSE
 array_to_string(list_filter({sql_lines('text')}, lambda x: NOT list_contains(heads, {sql_strip('x')})), chr(10)) END AS text
FROM fx_{_fx} p LEFT JOIN ha USING (doc_id)""",
        _fx,
    )(lambda fx, f=_fx, s=_share: T.strip_repeated_lines(getattr(fx, f).select("doc_id", "page_num", "text"), s))


def _tokens_sql(fx: str, pattern: str, extra: str = "") -> str:
    w = sql_words("text", pattern)
    return f"""t AS (SELECT doc_id, page_num, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos{extra}
   FROM (SELECT doc_id, page_num, text, {w} AS ws FROM {fx}) x),
 c AS (SELECT doc_id, token, count(*) AS n, min(struct_pack(p := page_num, i := pos)) AS f{', bool_or(verbatim) AS verbatim' if extra else ''}
   FROM t GROUP BY doc_id, token)"""


for _fx in ("pages", "manual", "conv_pages", "doc_pages"):
    register(
        f"txt_04_identifier_counts_{_fx}",
        f"WITH {_tokens_sql('fx_' + _fx, P.MODEL_CODE)} SELECT doc_id, token, n, f.p AS first_page FROM c",
        _fx,
    )(lambda fx, f=_fx: T.identifier_counts(getattr(fx, f)).select("doc_id", "token", "n", *at()))

_WORDS = sql_words("text", "[A-Z]{3,}")
for _fx in ("manual", "conv_pages", "doc_pages"):
    register(
        f"txt_05_dominant_name_{_fx}",
        f"""WITH {_tokens_sql('fx_' + _fx, P.MODEL_CODE)},
 bc AS (SELECT doc_id, token AS code FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (n >= 2 AND length(token) >= 4) DESC, n DESC, f) = 1),
 wt AS (SELECT doc_id, page_num, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, page_num, {_WORDS} AS ws FROM fx_{_fx}) x),
 wc AS (SELECT doc_id, token, count(*) AS n, min(struct_pack(p := page_num, i := pos)) AS f FROM wt WHERE token NOT IN {sql_list(P.STOP_WORDS)} GROUP BY doc_id, token),
 bw AS (SELECT doc_id, token AS word, n FROM wc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)
SELECT d.doc_id, coalesce(code, CASE WHEN n >= 2 THEN word END, 'UNKNOWN') AS machine
FROM (SELECT DISTINCT doc_id FROM fx_{_fx}) d LEFT JOIN bc USING (doc_id) LEFT JOIN bw USING (doc_id)""",
        _fx,
    )(lambda fx, f=_fx: T.dominant_name(getattr(fx, f)))

# the whole text of a document in one string is fine for the small checking side
_SCOPE = r"""d AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS doc_text FROM fx_manual GROUP BY doc_id),
 s AS (SELECT doc_id, doc_text, regexp_extract(doc_text, '(?i)SCOPE\s*:\s*([\p{L}\p{N}_/\s%s]+)', 1) AS text FROM d)"""
register(
    "txt_06_scope_members",
    f"""WITH {_SCOPE % ''}, w AS (SELECT doc_id, {sql_words('text', P.SCOPE_CODE)} AS ws FROM s),
 t AS (SELECT doc_id, unnest(ws) AS member, generate_subscripts(ws, 1) AS pos FROM w)
SELECT doc_id, member, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS INT) AS member_no FROM t GROUP BY doc_id, member""",
    "manual",
)(lambda fx: T.scope_members(fx.stored("manual")))
register(
    "txt_07_block_names",
    f"""WITH {_SCOPE % ','}, w AS (SELECT doc_id, {sql_words('text', P.BLOCK_CODE)} AS ws FROM s),
 i AS (SELECT DISTINCT doc_id, unnest(ws) AS name FROM w),
 {_tokens_sql('fx_manual', P.BLOCK_CODE)},
 top AS (SELECT doc_id, token, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 20)
SELECT doc_id, name FROM i UNION ALL
SELECT doc_id, token FROM top WHERE n >= 3 AND length(token) >= 6 AND doc_id NOT IN (SELECT doc_id FROM i)""",
    "manual",
)(lambda fx: T.block_names(fx.stored("manual")))

for _fx in ("pages", "manual", "doc_pages"):
    register(
        f"txt_08_detect_variants_{_fx}",
        f"""WITH {_tokens_sql('fx_' + _fx, '[A-Z][A-Z0-9]{3,9}', ', contains(text, token) AS verbatim').replace(
            'FROM t GROUP', "FROM t WHERE regexp_matches(token, '[0-9]') GROUP")},
 k AS (SELECT *, n >= 3 AS strong FROM c WHERE n >= 3 OR verbatim),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY strong DESC, n DESC, length(token), f) AS rank,
   bool_or(strong) OVER (PARTITION BY doc_id) AS any_strong FROM k)
SELECT doc_id, token AS variant, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8 AND (strong OR NOT any_strong)""",
        _fx,
    )(lambda fx, f=_fx: T.detect_variants(getattr(fx, f)))

_NAMES = "nm AS (SELECT DISTINCT l_orderkey AS doc_id, concat('PV', lpad(CAST(l_partkey AS STRING), 6, '0')) AS name FROM lineitem)"
_MENTIONS = rf"""{_NAMES}, w AS (SELECT doc_id, page_num, unnest(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[\p{{L}}\p{{N}}_]+')) AS name FROM fx_manual),
 m AS (SELECT w.doc_id, page_num, w.name, count(*) AS n FROM w JOIN nm ON w.doc_id = nm.doc_id AND w.name = nm.name GROUP BY ALL)"""


def part_names(fx):
    """Names looked for: the variants of each order."""
    line = fx.spark.read.parquet(f"{fx.sf_dir}/lineitem.parquet")
    name = F.concat(F.lit("PV"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    return line.select(F.col("l_orderkey").alias("doc_id"), name.alias("name")).distinct()


register("txt_09_name_mentions", f"WITH {_MENTIONS} SELECT doc_id, page_num, name, n FROM m", "manual")(
    lambda fx: T.name_mentions(fx.manual, part_names(fx))
)


def requested(fx):
    """Each order asks for one of its machine codes, some of which the manual does not hold."""
    orders = fx.spark.read.parquet(f"{fx.sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("doc_id"), F.expr("concat('sm', CAST(10 + o_orderkey % 9 AS STRING))").alias("machine")
    )


REQUESTED_SQL = "rq AS (SELECT o_orderkey AS doc_id, concat('sm', CAST(10 + o_orderkey % 9 AS STRING)) AS machine FROM orders)"
register(
    "txt_10_requested_present",
    rf"""WITH {REQUESTED_SQL}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(text), '[\p{{L}}\p{{N}}_]+')) AS name FROM fx_manual)
SELECT rq.doc_id, machine FROM rq SEMI JOIN w ON rq.doc_id = w.doc_id AND upper(machine) = name""",
    "manual",
)(lambda fx: T.requested_present(requested(fx), fx.manual))
