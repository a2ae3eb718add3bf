"""Reply and step queries of layout A."""

from pyspark.sql import functions as F

from pageledger.functions import patterns as P
from pageledger.operators import replies as J, steps as S
from pageledger.plans import procedure as PR
from pageledger.plans.queries_quality import full
from pageledger.plans.registry import lit, register

# ---- replies -----------------------------------------------------------------------------------------------------------
FENCE = r"trim(regexp_replace(regexp_replace(trim(body), '(?m)^```(?:json)?\s*', '', 'g'), '(?m)\s*```\s*$', '', 'g'))"
CUT = f"regexp_extract({FENCE}, '(?s)\\{{.*\\}}', 0)"
# the shortest prefix that is valid JSON is the first object
OBJECT = f"""cu AS (SELECT * EXCLUDE body, {CUT} AS t FROM {{fx}}),
 ob AS (SELECT * EXCLUDE t, CASE WHEN json_valid(t) THEN t ELSE (SELECT left(t, i) FROM (SELECT unnest(range(1, length(t) + 1)) AS i) r WHERE t[i] = '}}' AND json_valid(left(t, i)) ORDER BY i LIMIT 1) END AS o FROM cu)"""
register(
    "jsn_01_parse_replies",
    f"""WITH {OBJECT.replace('{fx}', 'fx_replies')} SELECT reply_id, coalesce(json_extract_string(o, '$.mg9.notes'), '') AS notes, o IS NOT NULL AS parsed FROM ob""",
    "replies",
)(
    lambda fx: J.parse_replies(fx.replies, "struct<mg9:struct<notes:string>>").select(
        "reply_id", F.coalesce("reply.mg9.notes", F.lit("")).alias("notes"), F.col("reply.mg9").isNotNull().alias("parsed")
    )
)
MERGE = rf"""{OBJECT.replace('{fx}', 'fx_replies')}, vk AS (SELECT variant AS doc_id, reply_id, chunk_idx, o, unnest(json_keys(o)) AS k FROM ob),
 ff AS (SELECT doc_id, reply_id, chunk_idx, upper(regexp_replace(k, '\s+', '', 'g')) AS variant, unnest(['uv_range', 'ref_voltage', 'notes']) AS field, k, o FROM vk),
 fv AS (SELECT doc_id, reply_id, chunk_idx, variant, field, json_extract_string(o, '$."' || k || '".' || field) AS value FROM ff),
 co AS (SELECT doc_id, variant, field, arg_min(value, reply_id) AS value FROM fv WHERE length(value) > 0 GROUP BY ALL)"""


def chunks(fx):
    """Every reply is a chunk of its user's document."""
    return fx.replies.select(F.col("variant").alias("doc_id"), F.col("reply_id").alias("chunk_idx"), "body")


register("jsn_02_coalesce_chunks", f"WITH {MERGE} SELECT * FROM co", "replies")(lambda fx: J.coalesce_chunks(chunks(fx)))
_SPEC = "nullif(max(CASE WHEN field = '{f}' THEN value END), 'null') AS {f}"
register(
    "jsn_03_normalize_specs",
    f"WITH {MERGE} SELECT doc_id, variant, {', '.join(_SPEC.format(f=f) for f in ('uv_range', 'ref_voltage', 'notes', 'lv_cutoff'))}, 0 AS n_leds, 0 AS n_dips FROM co GROUP BY ALL",
    "replies",
)(
    lambda fx: J.normalize_specs(J.coalesce_chunks(chunks(fx))).select(
        "doc_id", "variant", "uv_range", "ref_voltage", "notes", "lv_cutoff", F.size("led_indications").alias("n_leds"), F.size("dip_switches").alias("n_dips")
    )
)
RAW = """e5 AS (SELECT event_id AS reply_id, event_type, event_id AS e FROM events),
 rs AS (SELECT reply_id, 1 AS step_idx, concat(' ', event_type, ' ') AS step_name, concat('P1 = ', e % 30, ' %') AS settings, concat('RN : ', e % 300, '.', e % 10) AS voltages_pn, concat(e % 20, '-16 SEC') AS off_delay, e % 2 = 0 AS section_break, '' AS leds FROM e5 WHERE e % 5 <> 4
  UNION ALL SELECT reply_id, 3, 'Supply OFF', '', '', NULL, NULL, 'PWR: ON' FROM e5 WHERE e % 5 <> 4
  UNION ALL SELECT reply_id, 6, 'last', '', '', NULL, NULL, '' FROM e5 WHERE e % 5 <> 4 AND e % 3 = 0
  UNION ALL SELECT reply_id, CASE WHEN e % 3 = 0 THEN 8 ELSE 5 END, 'c', 'a|7', '', NULL, false, '' FROM e5 WHERE e % 5 <> 4 AND e % 4 = 1)"""
_J = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
register(
    "jsn_04_explode_steps", f"WITH {RAW} SELECT reply_id, step_idx, step_name, settings, voltages_pn, leds, off_delay, section_break FROM rs", "step_replies"
)(
    lambda fx: J.explode_steps(fx.step_replies, ["reply_id"]).select(
        "reply_id", "step_idx", "step_name", _J("settings"), _J("voltages_pn"), _J("leds"), "off_delay", "section_break"
    )
)
register(
    "jsn_05_normalize_step",
    rf"""WITH {RAW}, n AS (SELECT *, try_cast(regexp_extract(voltages_pn, ': (.*)$', 1) AS DOUBLE) AS v FROM rs)
SELECT reply_id, step_idx, trim(step_name) AS step_name, CASE WHEN step_name = 'c' THEN '[RY : 415.7' ELSE '' END AS voltage_pp, regexp_replace(regexp_replace(settings, '([0-9]{{2,}})\s*%', '\1%'), '= ([0-9])\s*%', '= \1 %') AS settings,
 CASE WHEN v IS NULL THEN '' WHEN round_even(v, 1) = floor(v) THEN concat('RN : ', CAST(floor(v) AS BIGINT)) ELSE concat('RN : ', CAST(round_even(v, 1) AS VARCHAR)) END AS voltages_pn,
 regexp_replace(off_delay, '^([0-9]{{2,}}-[0-9]+) SEC$', 'OFF in \1 sec') AS off_delay, coalesce(section_break, false) AS section_break FROM n""",
    "step_replies",
)(
    lambda fx: J.normalize_step(J.explode_steps(fx.step_replies, ["reply_id"])).select(
        "reply_id", "step_idx", "step_name", _J("settings"), _J("voltages_pn"), _J("voltage_pp"), "off_delay", "section_break"
    )
)
NORM = r"""ns AS (SELECT variant, step_idx, CASE WHEN lower(step_name) IN ('phase fail', 'phase recovery', 'phase reverse', 'phase reverse recovery') THEN list_transform(settings, lambda s: replace(replace(s, 'P2 = 0 MIN', 'P2 = 0 SEC'), 'P3 = 0 MIN', 'P3 = 0 SEC'))
   WHEN len(list_filter(settings, lambda s: contains(s, 'MIN'))) > 0 THEN list_transform(settings, lambda s: replace(s, 'P3 = 0 SEC', 'P3 = 0 MIN')) ELSE settings END AS s0,
  list_transform(voltages_pn, lambda v: CASE WHEN contains(v, ' : ') THEN concat(split_part(v, ' : ', 1), ' : ', regexp_replace(CAST(round_even(CAST(split_part(v, ' : ', 2) AS DOUBLE), 1) AS VARCHAR), '\.0$', '')) ELSE v END) AS vpn,
  list_transform(voltage_pp, lambda v: concat(split_part(v, ' : ', 1), ' : ', CAST(floor(CAST(split_part(v, ' : ', 2) AS DOUBLE)) AS BIGINT))) AS vpp,
  section_break AND NOT regexp_matches(lower(step_name), 'hystersis recovery|hysteresis recovery|asymmetry recovery') AS sb FROM fx_steps)"""
register(
    "jsn_05_normalize_step_rows",
    rf"""WITH {NORM} SELECT variant, step_idx, array_to_string(list_transform(s0, lambda s: CASE WHEN regexp_matches(s, '^P[123]\s*=') THEN regexp_replace(s, '= ([0-9])\s*%', '= \1 %') ELSE s END), '|') AS settings,
 array_to_string(vpn, '|') AS voltages_pn, array_to_string(vpp, '|') AS voltage_pp, sb AS section_break FROM ns""",
    "steps",
)(
    lambda fx: J.normalize_step(fx.steps.withColumn("voltage_pp", F.to_json("voltage_pp"))).select(
        "variant", "step_idx", _J("settings"), _J("voltages_pn"), _J("voltage_pp"), "section_break"
    )
)
register(
    "jsn_06_count_steps",
    f"SELECT variant, count_if(NOT regexp_matches(step_name, {lit('(?i)' + P.MARKER_STEP)}))::BIGINT AS n_steps FROM fx_steps GROUP BY variant",
    "steps",
)(lambda fx: J.count_steps(fx.steps))
register(
    "jsn_07_best_attempt",
    """SELECT variant, attempt, n_steps FROM fx_attempts
 QUALIFY row_number() OVER (PARTITION BY variant ORDER BY n_steps BETWEEN 24 AND 60 DESC, CASE WHEN n_steps BETWEEN 24 AND 60 THEN 0 ELSE abs(n_steps - 28) END, attempt) = 1""",
    "attempts",
)(lambda fx: J.best_attempt(fx.attempts))
register(
    "jsn_08_best_attempt_complete",
    """SELECT variant, attempt, n_steps, complete FROM fx_attempts
 QUALIFY row_number() OVER (PARTITION BY variant ORDER BY complete DESC, CASE WHEN complete THEN 0 ELSE -n_steps END, attempt) = 1""",
    "attempts",
)(lambda fx: J.best_attempt_complete(fx.attempts))
register(
    "jsn_08_attempt_completeness",
    f"""WITH a AS (SELECT variant, CAST(1 + (step_idx - 1) // 16 AS INT) AS attempt, lower(step_name) AS n FROM fx_steps_b),
 c AS (SELECT concat('PV', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS variant, p_partkey % 2 = 0 AS has_repeat, p_partkey % 3 = 0 AS has_asymmetry FROM part),
 g AS (SELECT variant, attempt, bool_or(contains(n, 'phase reverse')) AND bool_or(contains(n, 'couple all')) AND bool_or(contains(n, 'higher cut off')) AS req, count_if(contains(n, 'lower cut off healthy')) AS h, bool_or(contains(n, 'repeated tests')) AS rep,
   count_if(NOT regexp_matches(n, {lit(P.MARKER_STEP)}))::BIGINT AS n_steps FROM a GROUP BY ALL)
SELECT variant, attempt, req AND (NOT has_repeat OR h >= 2) AND (NOT has_asymmetry OR rep) AS complete, n_steps FROM g JOIN c USING (variant)""",
    "steps_b",
)(
    lambda fx: J.attempt_completeness(
        fx.steps_b.withColumn("attempt", F.expr("CAST(1 + (step_idx - 1) DIV 16 AS INT)")),
        fx.spark.read.parquet(f"{fx.sf_dir}/part.parquet").selectExpr(
            "concat('PV', lpad(CAST(p_partkey AS STRING), 6, '0')) AS variant", "p_partkey % 2 = 0 AS has_repeat", "p_partkey % 3 = 0 AS has_asymmetry"
        ),
    )
)

# ---- steps -------------------------------------------------------------------------------------------------------------
SP, SS = ("steps", "proc_pages"), ("specs", "steps")
OUT = ("variant", "step_idx", "step_name", "settings", "voltages_pn", "voltage_pp", "leds", "relay_status", "on_delay", "off_delay", "section_break")


def shown(df, cols=OUT, *more):
    return df.select(*[_J(c) if c in ("settings", "voltages_pn", "voltage_pp", "leds") else F.col(c) for c in cols], *more)


def shown_sql(cols=OUT, **given):
    arrays = ("settings", "voltages_pn", "voltage_pp", "leds")
    return ", ".join(f"array_to_string({given.get(c, c)}, '|') AS {c}" if c in arrays else f"{given.get(c, c)} AS {c}" for c in cols)


register(
    "stp_00_procedure_layout",
    f"""WITH h AS (SELECT variant, bool_or(regexp_matches(text, {lit('(?i)' + P.CUTOFF_HEADING)})) AS h FROM fx_proc_pages GROUP BY variant)
SELECT variant, CASE WHEN coalesce(h, false) OR (({full('lv_cutoff')} OR {full('hv_cutoff')}) AND NOT ({full('uv_threshold_pct')} OR {full('ov_threshold_pct')} OR {full('uv_range')} OR {full('ov_range')})) THEN 'B' ELSE 'A' END AS layout
FROM fx_specs LEFT JOIN h USING (variant)""",
    ("specs", "proc_pages"),
)(lambda fx: S.procedure_layout(fx.specs, fx.proc_pages))
COUPLE = rf"""cp AS (SELECT variant, page_num, coalesce(nullif(regexp_extract(text, {lit(P.COUPLE_VOLTAGE)}, 1), ''), regexp_extract(text, {lit(P.COUPLE_VOLTAGE)}, 2)) AS v FROM fx_proc_pages
   WHERE regexp_matches(text, {lit(P.COUPLE_VOLTAGE)})),
 cv AS (SELECT variant, arg_min(v, page_num) AS volts FROM cp GROUP BY variant),
 ca AS (SELECT variant, min(CASE WHEN regexp_matches(step_name, '(?i)^(?:UV|OV)\s+symm+etrical\s+Healthy') THEN step_idx END) AS pos FROM fx_steps GROUP BY variant HAVING NOT bool_or(regexp_matches(step_name, '(?i)^supply\s+couple'))),
 un AS (SELECT variant, CAST(step_idx AS DOUBLE) AS o, step_name, section_break FROM fx_steps UNION ALL SELECT variant, pos - 0.5, concat('Supply couple at ', volts, ' VAC'), true FROM ca JOIN cv USING (variant) WHERE pos IS NOT NULL)"""
register(
    "stp_01_insert_couple_marker",
    f"WITH {COUPLE} SELECT variant, CAST(row_number() OVER (PARTITION BY variant ORDER BY o) AS INT) AS step_idx, step_name, section_break FROM un",
    SP,
)(lambda fx: S.insert_couple_marker(fx.steps, fx.proc_pages).select("variant", "step_idx", "step_name", "section_break"))
register(
    "stp_02_drop_section_labels",
    f"""SELECT variant, step_idx, step_name FROM fx_steps WHERE (contains(step_name, 'DIP S/W') AND contains(step_name, 'Change')) OR starts_with(lower(step_name), 'supply ') OR starts_with(lower(step_name), 'dip s/w')
 OR NOT regexp_matches(step_name, {lit('(?i)' + P.SECTION_LABEL)})""",
    "steps",
)(lambda fx: S.drop_section_labels(fx.steps).select("variant", "step_idx", "step_name"))


def canon(c: str) -> str:
    x = rf"regexp_replace({c}, '(?i)\bsymmetrical\b', 'symmmetrical', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(?i)\s*\(symm+etrical\)\s*$', ''), '(?i)\s*\(sym\)\s*$', '')"
    x = rf"regexp_replace({x}, '(?i)\bhysteresis\b', 'hystersis', 'g')"
    x = f"(CASE WHEN regexp_matches({x}, '(?i)^[uo]v faulty condition with delay') THEN trim(replace({x}, 'with delay', '')) ELSE {x} END)"
    return rf"regexp_replace({x}, '(?i)\s+Ph-[NP].*$', '')"


register("stp_03_canonical_step_names", f"SELECT variant, step_idx, {canon('step_name')} AS step_name FROM fx_steps", "steps")(
    lambda fx: S.canonical_step_names(fx.steps).select("variant", "step_idx", "step_name")
)
_L1 = r"regexp_replace(regexp_replace(regexp_replace(x, '(?i)(?:Fast|Slow)?\s*Blink(?:ing)?\s*\([^)]*\)', 'BLINKING', 'g'), '(?i)\bBlinking\b', 'BLINKING', 'g'), 'BLINKING\s*\([^)]*\)', 'BLINKING', 'g')"
register(
    "stp_04_canonical_leds",
    rf"""SELECT variant, step_idx, array_to_string(list_transform(list_transform(leds, lambda x: {_L1}), lambda y: CASE WHEN NOT contains(upper(y), 'BLINKING') THEN y
  WHEN contains(lower(step_name), 'asymmetry') THEN regexp_replace(y, '(?i)^ASY\s*:', 'ASY (RED LED):') ELSE regexp_replace(y, '(?i)(ASY|PWR)\s*\([^)]*\)\s*:', '\1 :', 'g') END), '|') AS leds FROM fx_steps""",
    "steps",
)(lambda fx: shown(S.canonical_leds(fx.steps), ("variant", "step_idx", "leds")))


def num(x: str, p: str, g: int = 1) -> str:
    return f"try_cast(nullif(regexp_extract({x}, {lit(p)}, {g}), '') AS DOUBLE)"


SPAN, HYST = P.TRIP_RANGE, P.RESET_HYSTERESIS
GRID5 = r"(?s)1\s+2\s+3\s+(\d)\s+(\d)\s+(\d).*?4\s+(\d).*?5\s+(\d)"
LIST5 = r"(?s)\d\s*=\s*(\d).*?\d\s*=\s*(\d).*?\d\s*=\s*(\d).*?\d\s*=\s*(\d).*?\d\s*=\s*(\d)"


def bits(p: str, groups) -> str:
    return "list_value(" + ", ".join(f"concat('{i + 1} : ', CASE WHEN regexp_extract(text, {lit(p)}, {g}) = '1' THEN 'ON' ELSE 'OFF' END)" for i, g in enumerate(groups)) + ")"


_OWN = r"(CASE WHEN regexp_matches(text, '(?i)\b' || variant || '\b') THEN regexp_extract(text, '(?is)\b' || variant || '\b.*', 0) ELSE text END)"
CTX = rf"""pg AS (SELECT variant, page_num, text, least({num('text', HYST, 1)}, {num('text', HYST, 2)}) AS hy, regexp_matches(text, '(?i)symmetric\s+ov|symmetr.*\sov\s') AS sy,
   list_filter(list_transform(range(1, len(regexp_extract_all(text, {lit('(?i)' + SPAN)}, 1)) + 1), lambda i: list_value(CAST(regexp_extract_all(text, {lit('(?i)' + SPAN)}, 1)[i] AS DOUBLE), CAST(regexp_extract_all(text, {lit('(?i)' + SPAN)}, 2)[i] AS DOUBLE))), lambda p: greatest(p[1], p[2]) < 400)[-1] AS tr, {num('text', '(?is)hysteresis.*?' + SPAN, 2)} AS hh,
   CASE WHEN regexp_matches(text, {lit(GRID5)}) THEN {bits(GRID5, range(1, 6))} END AS sb, CASE WHEN regexp_matches(text, '(?i)run time|runtime') AND regexp_matches(text, {lit(LIST5)}) THEN {bits(LIST5, range(1, 6))} END AS rt,
   CASE WHEN regexp_matches(text, '(?i)B\]\s*Goal|Over\s+Voltage|480V|Ph-Ph') THEN nullif(regexp_extract(text, '(?i)OV\s*pot\s*[-–—]\s*(\d+)\s*%', 1), '') END AS op,
   CASE WHEN regexp_matches(text, '(?i)B\]\s*Goal|Over\s+Voltage|480V|Ph-Ph') THEN nullif(regexp_extract(text, '(?i)Delay\s*pot\s*[-–—]\s*(\d+)\s*sec', 1), '') END AS dl,
   {num(_OWN, r'(?is)C\]\s*Goal.*?(?:Neutral\s+at|at)\s+(\d+)\s*V')} AS nm FROM fx_proc_pages),
 c1 AS (SELECT variant, round_even(arg_min(hy, page_num) FILTER (hy > 350) / {P.SQRT3}, 0) - 5 AS ov_recovery, arg_max(least(tr[1], tr[2]), page_num) FILTER (sy AND tr IS NOT NULL) AS trip_lo,
   arg_max(greatest(tr[1], tr[2]), page_num) FILTER (sy AND tr IS NOT NULL) AS trip_hi, arg_max(hh, page_num) FILTER (sy AND hh IS NOT NULL) AS sym_hyst_hi, arg_min(sb, page_num) FILTER (sb IS NOT NULL) AS section_b_dips,
   arg_min(rt, page_num) FILTER (rt IS NOT NULL) AS run_time_dips, arg_min(op, page_num) FILTER (op IS NOT NULL) AS ov_pct, min(page_num) FILTER (op IS NOT NULL) AS stop, arg_min(nm, page_num) FILTER (nm IS NOT NULL) AS nominal FROM pg GROUP BY variant),
 c2 AS (SELECT pg.variant, arg_max(dl, page_num) AS delay FROM pg JOIN c1 USING (variant) WHERE dl IS NOT NULL AND (stop IS NULL OR page_num <= stop) GROUP BY pg.variant),
 cx AS (SELECT * FROM c1 LEFT JOIN c2 USING (variant))"""


def ctx(fx):
    return S.layout_a_context(fx.proc_pages, names=F.concat(F.lit(r"(?i)\b"), F.col("variant"), F.lit(r"\b")))


register(
    "stp_05_layout_a_context",
    f"WITH {CTX} SELECT variant, ov_recovery, trip_lo, trip_hi, sym_hyst_hi, array_to_string(section_b_dips, '|') AS section_b_dips, array_to_string(run_time_dips, '|') AS run_time_dips, ov_pct, delay, nominal FROM cx",
    "proc_pages",
)(
    lambda fx: ctx(fx).select(
        "variant", "ov_recovery", "trip_lo", "trip_hi", "sym_hyst_hi", F.array_join("section_b_dips", "|").alias("section_b_dips"),
        F.array_join("run_time_dips", "|").alias("run_time_dips"), "ov_pct", "delay", "nominal",
    )
)
CS = f"cs AS (SELECT * REPLACE ({canon('step_name')} AS step_name), lower(trim({canon('step_name')})) AS n FROM fx_steps)"
V0 = r"try_cast(nullif(regexp_extract({v}, ':\s*([0-9.]+)', 1), '') AS DOUBLE)"
_NV = num("step_name", r"(?i)(\d+)\s*(?:VAC|V)")
STATE = rf"""{CTX}, {CS},
 a1 AS (SELECT *, contains(n, 'run time dip') AS rn, contains(n, 'dip') AS dp, lag(contains(n, 'run time dip')) OVER w AS prn, lead(contains(n, 'dip')) OVER w AS ndp,
   coalesce(max(CASE WHEN NOT contains(n, 'run time dip') THEN step_idx END) OVER (PARTITION BY variant ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM cs WINDOW w AS (PARTITION BY variant ORDER BY step_idx)),
 a2 AS (SELECT *, CASE WHEN rn AND (step_idx - lo) % 2 = 1 AND coalesce(ndp, false) THEN 1 WHEN coalesce(prn, false) AND (step_idx - 1 - lo) % 2 = 1 AND dp THEN 2 ELSE 0 END AS pair FROM a1),
 a3 AS (SELECT *, coalesce(bool_or(pair = 0 AND contains(n, 'supply off change')) OVER (PARTITION BY variant ORDER BY step_idx), false) AS later FROM a2),
 a4 AS (SELECT *, CASE WHEN pair = 0 AND later AND contains(n, 'supply couple') THEN {V0.format(v='voltages_pn[1]')} END AS ow,
   CASE WHEN pair = 0 AND later AND contains(n, 'supply couple') THEN CASE WHEN {_NV} > 300 THEN round_even({_NV} / {P.SQRT3}, 1) ELSE {_NV} END END AS nv FROM a3),
 st AS (SELECT a4.* EXCLUDE (rn, dp, prn, ndp, lo, ow, nv), coalesce(last_value(ow IGNORE NULLS) OVER w, c.nominal, first_value(nv IGNORE NULLS) OVER w) AS nominal,
   coalesce(bool_or(contains(n, 'ov')) OVER (PARTITION BY a4.variant ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ov_seen
  FROM a4 LEFT JOIN cx c ON a4.variant = c.variant WINDOW w AS (PARTITION BY a4.variant ORDER BY step_idx))"""


def state(fx):
    return S.section_state(S.canonical_step_names(fx.steps), ctx(fx))


register("stp_05_section_state", f"WITH {STATE} SELECT variant, step_idx, step_name, later, pair, nominal, ov_seen FROM st", SP)(
    lambda fx: state(fx).select("variant", "step_idx", "step_name", "later", "pair", "nominal", "ov_seen")
)
register(
    "stp_06_drop_repeat_supply_off",
    f"WITH {STATE} SELECT variant, step_idx, step_name FROM st WHERE NOT (later AND pair = 0 AND n = 'supply off')", SP,
)(lambda fx: S.drop_repeat_supply_off(state(fx)).select("variant", "step_idx", "step_name"))
JOINED = f"{STATE}, sj AS (SELECT st.*, cx.* EXCLUDE (variant, nominal) FROM st LEFT JOIN cx ON st.variant = cx.variant)"


def three(labels, *v) -> str:
    vs = v if len(v) == 3 else v * 3
    return "list_value(" + ", ".join(f"concat('{x} : ', {y})" for x, y in zip(labels, vs)) + ")"


PN, PP = ("RN", "YN", "BN"), ("RY", "YB", "BR")
_RV, _RP = "CAST(round_even(ov_recovery, 0) AS INT)", f"CAST(round_even(ov_recovery * {P.SQRT3}, 0) AS INT)"
register(
    "stp_07_runtime_dip_pair",
    f"""WITH {JOINED} SELECT {shown_sql(OUT,
        settings="CASE WHEN pair = 2 THEN coalesce(run_time_dips, settings) ELSE settings END",
        voltages_pn=f"CASE WHEN pair = 1 THEN CAST([] AS VARCHAR[]) WHEN pair = 2 AND ov_recovery IS NOT NULL THEN {three(PN, _RV)} ELSE voltages_pn END",
        voltage_pp=f"CASE WHEN pair = 1 THEN CAST([] AS VARCHAR[]) WHEN pair = 2 AND ov_recovery IS NOT NULL THEN {three(PP, _RP)} ELSE voltage_pp END",
        leds="CASE WHEN pair = 1 THEN CAST([] AS VARCHAR[]) ELSE leds END", relay_status="CASE WHEN pair <> 1 THEN relay_status END",
        on_delay="CASE WHEN pair <> 1 THEN on_delay END", section_break="CASE WHEN pair > 0 THEN false ELSE section_break END")} FROM sj""",
    SP,
)(lambda fx: shown(S.runtime_dip_pair(state(fx), ctx(fx))))
_OVK = "regexp_matches(n, 'ov healthy|ov faulty|ov hystersis')"
_SET8 = "CASE WHEN pair = 0 AND contains(n, 'dip s/w') AND section_b_dips IS NOT NULL AND step_idx > 1 AND NOT ov_seen THEN section_b_dips ELSE settings END"
register(
    "stp_08_section_b_settings",
    f"""WITH {JOINED}, s8 AS (SELECT *, {_SET8} AS t FROM sj)
SELECT variant, step_idx, array_to_string(CASE WHEN pair = 0 AND {_OVK} THEN list_transform(list_transform(t, lambda s: CASE WHEN contains(upper(s), 'OV') AND contains(s, '%') AND ov_pct IS NOT NULL THEN concat('OV = ', ov_pct, ' %') ELSE s END),
  lambda s: CASE WHEN contains(upper(s), 'DELAY') AND delay IS NOT NULL THEN concat('DELAY = ', delay, ' SEC') ELSE s END) ELSE t END, '|') AS settings FROM s8""",
    SP,
)(lambda fx: shown(S.section_b_settings(state(fx), ctx(fx)), ("variant", "step_idx", "settings")))
_FMT = "regexp_replace(CAST(round_even({v}, 1) AS VARCHAR), '\\.0$', '')"
_V9 = """CASE WHEN contains(n, 'ov symmmetrical healthy') THEN trip_hi WHEN contains(n, 'ov symmmetrical faulty') THEN trip_lo WHEN contains(n, 'ov symmmetrical') AND contains(n, 'not recovery') THEN trip_hi
 WHEN contains(n, 'ov symmmetrical') AND contains(n, 'recovery') AND NOT contains(n, 'not') THEN trip_hi + sym_hyst_hi END"""
register(
    "stp_09_symmetric_ov",
    f"WITH {JOINED}, s9 AS (SELECT *, {_V9} AS v FROM sj) SELECT variant, step_idx, array_to_string(CASE WHEN pair = 0 AND v IS NOT NULL THEN {three(PN, _FMT.format(v='v'))} ELSE voltages_pn END, '|') AS voltages_pn FROM s9",
    SP,
)(lambda fx: shown(S.symmetric_ov(state(fx), ctx(fx)), ("variant", "step_idx", "voltages_pn")))
register(
    "stp_10_settings_spacing",
    rf"""WITH {STATE}, s0 AS (SELECT *, regexp_matches(array_to_string(settings, ' '), '(?i)UV\s*=\s*8\s*%') AND NOT {_OVK} AS ia FROM st)
SELECT variant, step_idx, array_to_string(CASE WHEN pair <> 0 THEN settings ELSE list_transform(list_transform(list_transform(settings, lambda s: regexp_replace(s, '(?i)\bsec\b', 'SEC', 'g')),
  lambda s: CASE WHEN NOT contains(upper(s), 'DELAY') THEN s WHEN ia THEN regexp_replace(s, '(\d+)\s+SEC', '\1SEC', 'g') ELSE regexp_replace(s, '(\d+)SEC', '\1 SEC', 'g') END),
  lambda s: CASE WHEN regexp_matches(s, '(?i)^OV\s*=') THEN CASE WHEN regexp_matches(s, '=\s*22\s*%') THEN CASE WHEN later THEN regexp_replace(s, '(22)\s*%', '\1 %', 'g') ELSE regexp_replace(s, '(22)\s+%', '\1%', 'g') END
    WHEN NOT ia THEN regexp_replace(s, '(\d+)\s*%', '\1 %', 'g') ELSE s END WHEN regexp_matches(s, '(?i)^UV\s*=') THEN regexp_replace(s, '(\d+)\s+%', '\1%', 'g') ELSE s END) END, '|') AS settings FROM s0""",
    SP,
)(lambda fx: shown(S.settings_spacing(state(fx)), ("variant", "step_idx", "settings")))
_VI = V0.format(v="voltages_pn[{i}]")
_PPI = "CASE WHEN " + _VI + " IS NOT NULL THEN concat('{l} : ', CAST(trunc(" + _VI + f" * {P.SQRT3}) AS INT)) END"
_DER = "list_filter(list_value(" + ", ".join(_PPI.format(i=i + 1, l=x) for i, x in enumerate(PP)) + "), lambda x: x IS NOT NULL)"
_WANT = "pair = 0 AND later AND NOT regexp_matches(n, 'dip s/w|supply|run time')"
register(
    "stp_11_derive_phase_phase",
    f"""WITH {STATE} SELECT variant, step_idx, array_to_string(CASE WHEN {_WANT} AND len(voltages_pn) > 0 AND len(voltage_pp) = 0 AND len({_DER}) > 0 THEN {_DER} ELSE voltage_pp END, '|') AS voltage_pp FROM st""",
    SP,
)(lambda fx: shown(S.derive_phase_phase(state(fx)), ("variant", "step_idx", "voltage_pp")))
CORRECT = f"""{STATE}, v3 AS (SELECT *, {_VI.format(i=1)} AS va, {_VI.format(i=2)} AS vb, {_VI.format(i=3)} AS vc FROM st),
 v4 AS (SELECT *, {_WANT} AND nominal <> 0 AND len(voltages_pn) >= 3 AND va IS NOT NULL AND vb IS NOT NULL AND vc IS NOT NULL AS w, abs(vb - va) < 2 AND abs(vc - va) < 2 AS eq,
   CASE WHEN round_even(va, 0) IN (round_even(vb, 0), round_even(vc, 0)) THEN round_even(va, 0) WHEN round_even(vb, 0) = round_even(vc, 0) THEN round_even(vb, 0) END AS base FROM v3),
 v5 AS (SELECT *, coalesce(w AND eq AND abs(va - nominal) >= 5 AND va > 0, false) AS rs, coalesce(w AND NOT eq AND abs(base - nominal) > 5 AND base <> 0 AND nominal / base > 1.2, false) AS sc,
   round_even(va * (nominal / base), 1) AS sa, round_even(vb * (nominal / base), 1) AS sbb, round_even(vc * (nominal / base), 1) AS scc FROM v4)"""
_INT = f"CAST(trunc({{v}} * {P.SQRT3}) AS INT)"
register(
    "stp_12_correct_nominal",
    f"""WITH {CORRECT} SELECT variant, step_idx, array_to_string(CASE WHEN rs THEN {three(PN, _FMT.format(v='nominal'))} WHEN sc THEN {three(PN, *[_FMT.format(v=v) for v in ('sa', 'sbb', 'scc')])} ELSE voltages_pn END, '|') AS voltages_pn,
 array_to_string(CASE WHEN rs THEN {three(PP, _INT.format(v='nominal'))} WHEN sc THEN {three(PP, *[_INT.format(v=v) for v in ('sa', 'sbb', 'scc')])} ELSE voltage_pp END, '|') AS voltage_pp FROM v5""",
    SP,
)(lambda fx: shown(S.correct_nominal(state(fx)), ("variant", "step_idx", "voltages_pn", "voltage_pp")))
register(
    "stp_13_phase_angle_entry",
    f"""WITH {STATE} SELECT variant, step_idx, array_to_string(CASE WHEN pair = 0 AND contains(n, 'phase reverse') AND len(voltages_pn) = 3 THEN list_append(voltages_pn, CASE WHEN contains(n, 'recovery') THEN '(recover phase angle)' ELSE '(change phase angle)' END) ELSE voltages_pn END, '|') AS voltages_pn FROM st""",
    SP,
)(lambda fx: shown(S.phase_angle_entry(state(fx)), ("variant", "step_idx", "voltages_pn")))
register(
    "stp_14_dedupe_healthy",
    f"""WITH {CS}, h AS (SELECT *, coalesce(bool_or(contains(n, 'supply off change')) OVER (PARTITION BY variant ORDER BY step_idx), false) AS cd FROM cs),
 k AS (SELECT *, row_number() OVER (PARTITION BY variant, cd AND n = 'healthy condition' ORDER BY step_idx) AS rn FROM h)
SELECT variant, step_idx, step_name FROM k WHERE NOT (cd AND n = 'healthy condition' AND rn > 1)""",
    "steps",
)(lambda fx: S.dedupe_healthy(S.canonical_step_names(fx.steps)).select("variant", "step_idx", "step_name"))
_SPUR = r"(regexp_matches({c}, '(?i)\b62\s*sec\b') OR trim({c}) = '62')"
_TAKE = "CASE WHEN NOT " + full("s.{f}") + " AND " + full("p.{f}") + " AND NOT " + _SPUR.format(c="p.{f}") + " THEN p.{f} ELSE s.{f} END AS {f}"
register(
    "stp_20_link_specs_to_steps",
    f"SELECT s.variant, step_idx, {_TAKE.format(f='on_delay')}, {_TAKE.format(f='off_delay')} FROM fx_steps s LEFT JOIN fx_specs p ON s.variant = p.variant", SS,
)(lambda fx: S.link_specs_to_steps(fx.steps, fx.specs).select("variant", "step_idx", "on_delay", "off_delay"))
BARE_SPECS = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN '230' END AS ref_voltage, CASE WHEN o_orderkey % 4 = 0 THEN '5 sec' END AS on_delay, CAST(NULL AS STRING) AS uv_range,
 CASE WHEN o_orderkey % 5 = 0 THEN '1 to 2' END AS ov_range, o_orderkey % 7 <> 0 AS has_reply FROM"""
register(
    "stp_21_enrich_specs",
    rf"""WITH sp AS ({BARE_SPECS} orders), dt AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_num) AS t FROM fx_manual GROUP BY doc_id),
 rr AS (SELECT doc_id, t, regexp_extract_all(t, '(?i)(\d{{3}})\s*(?:to|-)\s*(\d{{3}})\s*VAC', 1) AS ra, regexp_extract_all(t, '(?i)(\d{{3}})\s*(?:to|-)\s*(\d{{3}})\s*VAC', 2) AS rb,
   lower(trim(nullif(regexp_extract(t, '(?i)(\d+\.?\d*\s*(?:to|-)\s*\d+\.?\d*\s*s|\d+\.?\d*\s*s|instant|continuous)', 1), ''))) AS d0, nullif(regexp_extract(t, '(?i)REF\.?\s*VOLTAGE\s+(\d{{3}})\s*VAC', 1), '') AS rv FROM dt),
 rx AS (SELECT *, CASE WHEN d0 IN ('instant', 'continuous') THEN d0 ELSE regexp_replace(d0, '\s*s$', ' sec') END AS d FROM rr)
SELECT sp.doc_id, coalesce(ref_voltage, rv) AS ref_voltage, CASE WHEN on_delay IS NULL AND has_reply AND d IS NOT NULL AND NOT {_SPUR.format(c='d')} THEN d ELSE on_delay END AS on_delay,
 CASE WHEN has_reply AND ov_range IS NULL AND len(ra) >= 2 THEN concat(ra[1], '-', rb[1], ' VAC') ELSE uv_range END AS uv_range,
 CASE WHEN has_reply AND ov_range IS NULL AND len(ra) >= 2 THEN concat(ra[2], '-', rb[2], ' VAC') ELSE ov_range END AS ov_range FROM sp LEFT JOIN rx USING (doc_id)""",
    "manual",
)(
    lambda fx: S.enrich_specs(fx.spark.sql(BARE_SPECS + f" parquet.`{fx.sf_dir}/orders.parquet`"), fx.unstored("manual")).select(
        "doc_id", "ref_voltage", "on_delay", "uv_range", "ov_range"
    )
)

# ---- composed ----------------------------------------------------------------------------------------------------------
register("stp_22_layout_a_chain")(lambda fx: shown(PR.layout_a(fx.steps, fx.proc_pages, names=F.concat(F.lit(r"(?i)\b"), F.col("variant"), F.lit(r"\b")))))
register("stp_23_layout_b_chain")(lambda fx: shown(PR.layout_b(fx.steps_b, fx.proc_pages)))
