"""Layout B step queries and sheet layout queries."""

from pyspark.sql import functions as F

from pageledger.functions import patterns as P
from pageledger.operators import compare as C, layout as L, steps_b as B
from pageledger.plans.queries_quality import full
from pageledger.plans.queries_steps import OUT, PN, PP, shown, shown_sql, three
from pageledger.plans.registry import register

BP, BS, SS = ("steps_b", "proc_pages"), ("specs", "steps_b"), ("specs", "steps")
_LV4, _LV2, _HV, _AS = P.LOW_CUTOFF_BOTH, P.LOW_CUTOFF, P.HIGH_CUTOFF, P.ASYMMETRY


def ints(p: str, n: int) -> str:
    return f"CASE WHEN regexp_matches(text, '{p}') THEN list_value(" + ", ".join(f"CAST(regexp_extract(text, '{p}', {i + 1}) AS INT)" for i in range(n)) + ") END"


CTX_B = rf"""pb AS (SELECT variant, page_num, {ints(r'(?i)(?:Set voltage|at)\s+(\d+)\s*V\s*Ph-N', 1)} AS b, {ints(_LV4, 4)} AS l4, {ints(_LV2, 2)} AS l2, {ints(_HV, 2)} AS hv, {ints(_AS, 4)} AS a4, regexp_matches(text, '(?i)repeat\s+procedure') AS rp FROM fx_proc_pages),
 b1 AS (SELECT variant, arg_min(b, page_num) FILTER (b IS NOT NULL) AS b, arg_max(l4, page_num) FILTER (l4 IS NOT NULL) AS l4, arg_min(l2, page_num) FILTER (l2 IS NOT NULL) AS l2, arg_max(hv, page_num) FILTER (hv IS NOT NULL) AS hv,
   arg_max(a4, page_num) FILTER (a4 IS NOT NULL) AS a4, bool_or(rp) AS has_repeat FROM pb GROUP BY variant),
 bx AS (SELECT variant, b[1] AS base, coalesce(least(l4[1], l4[2]), least(l2[1], l2[2])) AS lv_lo, coalesce(greatest(l4[1], l4[2]), greatest(l2[1], l2[2])) AS lv_hi, least(l4[3], l4[4]) AS hyst_lo, greatest(l4[3], l4[4]) AS hyst_hi,
   least(hv[1], hv[2]) AS hv_lo, greatest(hv[1], hv[2]) AS hv_hi, a4[1] AS trip_lo_pct, a4[2] AS trip_hi_pct, a4[3] AS reset_lo_pct, a4[4] AS reset_hi_pct, has_repeat FROM b1)"""
register("stp_15_layout_b_context", f"WITH {CTX_B} SELECT * FROM bx", "proc_pages")(lambda fx: B.layout_b_context(fx.proc_pages))
R3 = P.SQRT3


def near(v):
    return f"CAST(round_even({v} / {R3}, 0) AS INT)"


def cut(v):
    return f"CAST(trunc({v}) AS INT)"


def yb(b):
    return f"CAST(floor(sqrt(base * base + {b} * {b} + base * {b})) AS INT)"


_PPB = cut(f"base * {R3}")
VOLT_B = rf"""{CTX_B}, nb AS (SELECT s.*, bx.* EXCLUDE (variant), lower(trim(step_name)) AS raw, trim(regexp_replace(lower(trim(step_name)), '\s*\(repeat block\)\s*$', '')) AS n FROM fx_steps_b s LEFT JOIN bx ON s.variant = bx.variant),
 kb AS (SELECT *, contains(n, 'couple all voltages') OR starts_with(n, 'repeated tests') AS label, hi_rec, coalesce(contains(n, 'asymmetry') AND base IS NOT NULL AND lv_lo IS NOT NULL AND trip_lo_pct IS NOT NULL, false) AS asy FROM (SELECT *, lv_hi + (hyst_lo + hyst_hi) // 2 AS hi_rec FROM nb) q),
 tb AS (SELECT *, CAST(round_even((lv_lo + {cut('lv_lo * reset_hi_pct / 100')}) * {R3}, 0) AS INT) AS target FROM kb),
 ib AS (SELECT DISTINCT base, target FROM tb WHERE asy AND contains(n, 'recovery') AND NOT contains(n, 'not')),
 iv AS (SELECT base, target, min(x) AS inv FROM (SELECT base, target, unnest(range(1, base + 1)) AS x FROM ib) r WHERE {yb('x')} = target GROUP BY ALL),
 qb AS (SELECT tb.*, CASE WHEN NOT asy THEN NULL WHEN contains(n, 'healthy') THEN {cut(f"{cut(f'lv_hi / {R3}')} * (100 - trip_lo_pct) / 100")} WHEN contains(n, 'faulty') THEN {cut(f"{cut(f'lv_lo / {R3}')} * trip_hi_pct / 100")}
   WHEN contains(n, 'not recovery') THEN tb.base * trip_hi_pct // 100 - 1 WHEN contains(n, 'recovery') THEN inv END AS bn FROM tb LEFT JOIN iv ON tb.base = iv.base AND tb.target = iv.target)"""
_PNB = f"""CASE WHEN label THEN CAST([] AS VARCHAR[]) WHEN bn IS NOT NULL THEN {three(PN, 'base', 'base', 'bn')}
 WHEN lv_lo IS NOT NULL AND (contains(n, 'lower cut off healthy') OR contains(n, 'lower cut off not recovery')) THEN {three(PN, near('lv_hi'))} WHEN lv_lo IS NOT NULL AND n = 'lower cut off' THEN {three(PN, near('lv_lo'))}
 WHEN hi_rec IS NOT NULL AND contains(n, 'lower cut off recovery') THEN {three(PN, near('hi_rec'))} WHEN hv_lo IS NOT NULL AND contains(n, 'higher cut off healthy') THEN {three(PN, cut(f'hv_lo / {R3}'))}
 WHEN hv_lo IS NOT NULL AND n = 'higher cut off' THEN {three(PN, cut(f'hv_hi / {R3}'))} WHEN base IS NOT NULL AND n = 'healthy condition' THEN {three(PN, 'base')}
 WHEN base IS NOT NULL AND n = 'phase reverse recovery' THEN list_append({three(PN, 'base')}, '(recover phase angle)') WHEN base IS NOT NULL AND n = 'phase fail' THEN {three(PN, 'base', 'base', '0')}
 WHEN base IS NOT NULL AND n = 'phase reverse' THEN list_append({three(PN, 'base')}, '(change phase angle)') WHEN n = 'phase reverse' AND len(voltages_pn) = 3 THEN list_append(voltages_pn, '(change phase angle)')
 WHEN n = 'phase reverse recovery' AND len(voltages_pn) = 3 THEN list_append(voltages_pn, '(recover phase angle)') ELSE voltages_pn END"""
_VVB = f"""CASE WHEN label THEN CAST([] AS VARCHAR[]) WHEN bn IS NOT NULL THEN {three(PP, _PPB, yb('bn'), yb('bn'))}
 WHEN lv_lo IS NOT NULL AND (contains(n, 'lower cut off healthy') OR contains(n, 'lower cut off not recovery')) THEN {three(PP, 'lv_hi')} WHEN lv_lo IS NOT NULL AND n = 'lower cut off' THEN {three(PP, 'lv_lo')}
 WHEN hi_rec IS NOT NULL AND contains(n, 'lower cut off recovery') THEN {three(PP, 'hi_rec')} WHEN hv_lo IS NOT NULL AND contains(n, 'higher cut off healthy') THEN {three(PP, 'hv_lo')}
 WHEN hv_lo IS NOT NULL AND n = 'higher cut off' THEN {three(PP, 'hv_hi')} WHEN base IS NOT NULL AND n IN ('healthy condition', 'phase reverse', 'phase reverse recovery') THEN {three(PP, _PPB)}
 WHEN base IS NOT NULL AND n = 'phase fail' THEN {three(PP, _PPB, 'base', 'base')} ELSE voltage_pp END"""
_TURN = "(base IS NOT NULL AND n = 'phase reverse')"
_LEDB = rf"""CASE WHEN label THEN CAST([] AS VARCHAR[]) WHEN {_TURN} THEN ['R (RED LED) : BLINKING'] ELSE list_transform(leds, lambda x: CASE WHEN contains(upper(x), 'BLINK') THEN 'R (RED LED) : BLINKING' ELSE regexp_replace(x, 'R\s*\(\s*RED', 'R (RED', 'g') END) END"""
BARE = dict(
    step_name="CASE WHEN n <> raw THEN n ELSE step_name END", settings="CAST([] AS VARCHAR[])", voltages_pn=_PNB, voltage_pp=_VVB, leds=_LEDB,
    relay_status=f"CASE WHEN label THEN NULL WHEN {_TURN} THEN 'Instant OFF' ELSE relay_status END", on_delay="CASE WHEN NOT label THEN on_delay END",
    off_delay=f"CASE WHEN label THEN NULL WHEN {full('off_delay')} THEN off_delay WHEN base IS NOT NULL AND n = 'healthy condition' THEN '-' WHEN {_TURN} THEN 'Instant OFF' ELSE off_delay END",
    section_break="label OR section_break",
)
register("stp_16_layout_b_voltages", f"WITH {VOLT_B} SELECT {shown_sql(OUT, **BARE)} FROM qb", BP)(
    lambda fx: shown(B.layout_b_voltages(fx.steps_b, B.layout_b_context(fx.proc_pages)))
)
_SP = r"coalesce(regexp_matches({c}, '(?i)\b62\s*sec\b') OR trim({c}) = '62', false)"
register(
    "stp_17_layout_b_delays",
    rf"""WITH d AS (SELECT variant, step_idx, CASE WHEN NOT {_SP.format(c='on_delay')} THEN on_delay END AS o, CASE WHEN NOT {_SP.format(c='off_delay')} THEN off_delay END AS f FROM fx_steps_b),
 m AS (SELECT *, {full('o')} AND coalesce(regexp_matches(o, '(?i)<=|<\s*=|msec|less\s+than|^\s*-\s*$'), false) AND (NOT {full('f')} OR trim(f) IN ('', '-', 'null')) AS mv FROM d)
SELECT variant, step_idx, CASE WHEN NOT mv THEN o END AS on_delay, CASE WHEN mv THEN trim(o) ELSE f END AS off_delay FROM m""",
    "steps_b",
)(lambda fx: B.layout_b_delays(fx.steps_b).select("variant", "step_idx", "on_delay", "off_delay"))
_BLOCK = "[" + ", ".join(f"'{x}'" for x in B.LV_BLOCK) + "]"
REQUIRED = rf"""{CTX_B}, ln AS (SELECT *, lower(step_name) AS n FROM fx_steps_b),
 r1 AS (SELECT variant, bool_or(contains(n, 'couple all')) AS couple, min(step_idx) FILTER (contains(n, 'asymmetry recovery')) AS ar, min(step_idx) FILTER (contains(n, 'lower cut off healthy')) AS l1,
   list(step_idx ORDER BY step_idx) FILTER (contains(n, 'lower cut off healthy'))[2] AS l2, bool_or(contains(n, 'asymmetry')) AS asy, bool_or(starts_with(n, 'repeated tests')) AS rep, min(step_idx) FILTER (contains(n, 'lower cut off recovery')) AS rc FROM ln GROUP BY variant),
 r2 AS (SELECT r1.*, trip_lo_pct, coalesce(has_repeat, false) AS hr FROM r1 LEFT JOIN bx USING (variant)),
 ins AS (SELECT variant, coalesce(ar + 0.5, l1 - 0.5) AS o, 'Couple all Voltages' AS step_name, NULL AS src, true AS brk FROM r2 WHERE NOT couple AND coalesce(ar, l1) IS NOT NULL
  UNION ALL SELECT variant, l2 - 0.25, 'Repeated Tests -', NULL, true FROM r2 WHERE (trip_lo_pct IS NOT NULL OR asy) AND NOT rep AND l2 IS NOT NULL
  UNION ALL SELECT variant, rc + 0.1 * i, {_BLOCK}[i], (SELECT min(step_idx) FROM ln WHERE ln.variant = r2.variant AND ln.n = lower({_BLOCK}[i])), false FROM r2, (SELECT unnest([1, 2, 3, 4]) AS i) g WHERE hr AND l2 IS NULL AND rc IS NOT NULL),
 allr AS (SELECT variant, CAST(step_idx AS DOUBLE) AS o, step_name, voltages_pn, section_break FROM ln
  UNION ALL SELECT ins.variant, o, coalesce(ln.step_name, ins.step_name), coalesce(ln.voltages_pn, CAST([] AS VARCHAR[])), coalesce(ln.section_break, brk) FROM ins LEFT JOIN ln ON ins.variant = ln.variant AND ins.src = ln.step_idx)"""
register(
    "stp_18_layout_b_required",
    f"WITH {REQUIRED} SELECT variant, CAST(row_number() OVER (PARTITION BY variant ORDER BY o) AS INT) AS step_idx, step_name, array_to_string(voltages_pn, '|') AS voltages_pn, section_break FROM allr",
    BP,
)(lambda fx: shown(B.layout_b_required(fx.steps_b, B.layout_b_context(fx.proc_pages)), ("variant", "step_idx", "step_name", "voltages_pn", "section_break")))
register(
    "stp_19_layout_b_finalize",
    f"""WITH {CTX_B} SELECT s.variant, step_idx, step_name FROM fx_steps_b s LEFT JOIN bx ON s.variant = bx.variant WHERE trip_lo_pct IS NOT NULL OR NOT (contains(lower(step_name), 'asymmetry') OR starts_with(lower(trim(step_name)), 'repeated tests'))""",
    BP,
)(lambda fx: B.layout_b_finalize(fx.steps_b, B.layout_b_context(fx.proc_pages)).select("variant", "step_idx", "step_name"))

# ---- sheet layout ------------------------------------------------------------------------------------------------------


def layout_sql(steps: str) -> str:
    return rf"""lr AS (SELECT variant, count_if(len(leds) > 0) AS led, count_if(len(leds) = 1 AND regexp_matches(leds[1], '(?i)R\s*\(.*RED')) AS red, count_if(len(leds) >= 3) AS many, count_if(len(leds) = 1 AND contains(leds[1], 'R (')) AS r FROM {steps} GROUP BY variant),
 lf AS (SELECT variant, ref_voltage, dip_switches, {full('uv_threshold_pct')} OR {full('ov_threshold_pct')} AS th, {full('uv_range')} OR {full('ov_range')} AS rg, {full('lv_cutoff')} OR {full('hv_cutoff')} AS co, len(dip_switches) > 0 AS dp,
   coalesce(try_cast(trim(replace(ref_voltage, 'V', '')) AS DOUBLE), 0) AS v, coalesce(led, 0) AS led, coalesce(red, 0) AS red, coalesce(many, 0) AS many, coalesce(r, 0) AS r FROM fx_specs LEFT JOIN lr USING (variant)),
 lay AS (SELECT variant, CASE WHEN led > 0 AND red = led THEN 'B' WHEN many > 0 THEN 'A' WHEN NOT th AND NOT rg AND co THEN 'B' WHEN NOT (th OR rg OR co OR dp OR {full('ref_voltage')}) AND led > 0 AND r = led THEN 'B' WHEN v >= 230 AND NOT dp AND NOT th AND NOT rg THEN 'B' ELSE 'A' END AS layout FROM lf)"""


for _fx in ("steps", "steps_b"):
    register(f"out_01_detect_layout_{_fx}", f"WITH {layout_sql('fx_' + _fx)} SELECT * FROM lay", ("specs", _fx))(
        lambda fx, f=_fx: L.detect_layout(fx.specs, getattr(fx, f))
    )


def dips_sql(settings: str) -> str:
    """Bits or items; the fixtures never mix the two."""
    bits = f"list_filter(list_transform({settings}, lambda s: regexp_extract(upper(s), 'DIP\\s*S/?W.*?:\\s*([01]+)', 1)), lambda b: b <> '')[1]"
    items = f"list_filter(list_transform({settings}, lambda s: trim(upper(s))), lambda s: regexp_matches(s, '^\\d+\\s*:\\s*(ON|OFF)\\b'))"
    one = "concat(regexp_extract(s, '^(\\d+)', 1), CASE WHEN i = 1 OR CAST(regexp_extract(s, '^(\\d+)', 1) AS INT) = 1 THEN ' : ' ELSE ': ' END, regexp_extract(s, ':\\s*(ON|OFF)', 1))"
    bit = "concat(CAST(i AS VARCHAR), CASE WHEN i = 1 THEN ' : ' ELSE ': ' END, CASE WHEN b = '1' THEN 'ON' ELSE 'OFF' END)"
    return f"(CASE WHEN {bits} IS NOT NULL THEN list_transform(string_split({bits}, ''), lambda b, i: {bit}) ELSE list_transform({items}, lambda s, i: {one}) END)"


DIPPED = """CASE WHEN contains(step_name, 'DIP') AND step_idx % 3 = 0 THEN ARR('DIP S/W 1-5 : 00101') WHEN contains(step_name, 'DIP') AND step_idx % 3 = 1 THEN ARR('2 : ON', '01: off', 'x', '7: OFF') ELSE settings END"""


def dipped(fx):
    """Steps whose DIP changes hold switch states."""
    return fx.steps.withColumn("settings", F.expr(DIPPED.replace("ARR(", "array(")))


DP = f"ds AS (SELECT * REPLACE ({DIPPED.replace('ARR(', 'list_value(')} AS settings) FROM fx_steps)"
register("out_02_parse_dip", f"WITH {DP} SELECT variant, step_idx, array_to_string({dips_sql('settings')}, '|') AS dips FROM ds", "steps")(
    lambda fx: L.parse_dip(dipped(fx)).select("variant", "step_idx", F.array_join("dips", "|").alias("dips"))
)


def advance_sql(src: str, steps: str) -> str:
    fn = f"(len(voltages_pn) > 0 OR len(leds) > 0 OR {full('relay_status')})"
    lab = f"(step_name <> '' AND NOT {fn} AND section_break AND NOT contains(step_name, 'DIP'))"
    return f"""{layout_sql(src)},
 ad AS (SELECT s.*, layout, lower(trim(step_name)) AS t, {fn} AS fn, contains(step_name, 'DIP S/W') AS dip, {lab} AS lab, {dips_sql('settings')} AS dips, lead(lower(trim(step_name))) OVER (PARTITION BY s.variant ORDER BY step_idx) AS nx,
   min(CASE WHEN contains(step_name, 'DIP S/W') THEN step_idx END) OVER (PARTITION BY s.variant) AS d1, min(CASE WHEN NOT contains(step_name, 'DIP S/W') AND NOT {lab} THEN step_idx END) OVER (PARTITION BY s.variant) AS s1
  FROM {steps} s JOIN lay ON s.variant = lay.variant),
 kd AS (SELECT *, CASE WHEN dip AND layout = 'A' AND step_idx = d1 THEN 'header_dip' WHEN dip THEN 'dip' WHEN NOT lab THEN 'step' WHEN t = 'supply off' THEN 'hidden' WHEN contains(t, 'decouple') THEN 'decouple' WHEN contains(t, 'couple') AND NOT contains(t, 'supply couple') THEN 'couple'
   WHEN contains(t, 'supply couple') THEN 'couple_volts' ELSE 'label' END AS kind, greatest(3, CASE WHEN layout = 'A' THEN len(settings) ELSE 0 END, CASE WHEN layout = 'A' THEN 4 ELSE 1 END, len(voltages_pn), len(voltage_pp)) AS used FROM ad),
 av AS (SELECT *, CAST(CASE kind WHEN 'step' THEN CASE WHEN step_name = 'Run time DIP switch change error' THEN 1 ELSE used + CASE WHEN layout = 'A' THEN CASE WHEN section_break THEN 2 ELSE 1 END
     WHEN section_break OR step_idx = s1 THEN 3 WHEN lower(step_name) = 'lower cut off' THEN greatest(6 - used, 1) WHEN contains(lower(step_name), 'lower cut off recovery') AND coalesce(starts_with(nx, 'repeated tests'), false) THEN greatest(4 - used, 1) ELSE greatest(5 - used, 1) END END
   WHEN 'dip' THEN CASE WHEN fn THEN greatest(len(dips), len(voltages_pn), len(leds), 3) + 1 ELSE greatest(len(dips), 1) + CASE WHEN section_break THEN 2 ELSE 1 END END
   WHEN 'couple_volts' THEN CASE WHEN layout = 'A' THEN 4 ELSE 2 END WHEN 'label' THEN CASE WHEN layout = 'A' THEN 4 ELSE 2 END ELSE 0 END AS INT) AS advance FROM kd),
 lo AS (SELECT *, CAST(CASE WHEN layout = 'A' THEN 10 ELSE 5 END + coalesce(sum(advance) OVER (PARTITION BY variant ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_row FROM av)"""


ADV_A, ADV_B = f"{DP}, {advance_sql('fx_steps', 'ds')}", advance_sql("fx_steps_b", "fx_steps_b")


def advanced(fx, which):
    steps = dipped(fx) if which == "steps" else fx.steps_b
    return L.step_advance(steps, L.detect_layout(fx.specs, steps))


for _fx, _sql in (("steps", ADV_A), ("steps_b", ADV_B)):
    register(f"out_03_step_advance_{_fx}", f"WITH {_sql} SELECT variant, step_idx, layout, kind, advance FROM av", ("specs", _fx))(
        lambda fx, f=_fx: advanced(fx, f).select("variant", "step_idx", "layout", "kind", "advance")
    )
    register(f"out_04_layout_rows_{_fx}", f"WITH {_sql} SELECT variant, step_idx, start_row FROM lo", ("specs", _fx))(
        lambda fx, f=_fx: L.layout_rows(advanced(fx, f)).select("variant", "step_idx", "start_row")
    )


def cells_sql(adv: str) -> str:
    col = lambda role: f"CASE WHEN layout = 'A' THEN {L.COLUMNS['A'].get(role, 'NULL')} ELSE {L.COLUMNS['B'].get(role, 'NULL')} END"
    body = "(kind = 'step' OR (kind = 'dip' AND fn))"
    one = lambda row, role, value, when, src="lo": f"SELECT variant, step_idx, {row} AS row_no, {col(role)} AS col_no, {value} AS value FROM {src} WHERE {when}"
    down = lambda row, role, values, when, src="lo": f"SELECT variant, step_idx, {row} + i - 1, {col(role)}, v FROM (SELECT *, unnest({values}) AS v, generate_subscripts({values}, 1) AS i FROM {src} WHERE {when}) u"
    parts = [
        one("start_row", "step", "step_name", "kind IN ('step', 'label')"), one("start_row", "pn", "step_name", "kind = 'couple_volts'"),
        one("start_row - 1", "settings", "step_name", "kind IN ('couple', 'decouple') AND layout = 'A'"), one("start_row - 1", "step", "'Supply OFF'", "kind = 'dip' AND NOT fn"),
        one("start_row", "step", "'DIP S/W setting'", "kind = 'dip'"), down("start_row", "settings", "settings", "kind = 'step' AND layout = 'A'"),
        down("start_row", "settings", "dips[1:5]", "kind = 'dip' AND layout = 'A'"),
        down("3", "settings", "dips[1:5]", "kind = 'header_dip'", "(SELECT lo.* REPLACE (CASE WHEN len(dips) > 0 THEN dips ELSE dip_switches END AS dips) FROM lo JOIN lf ON lo.variant = lf.variant) z"),
        down("start_row", "pn", "voltages_pn[1:4]", body), down("start_row", "pp", "voltage_pp[1:4]", body), down("start_row", "led", "leds[1:CASE WHEN layout = 'A' THEN 4 ELSE 1 END]", body),
    ] + [one("start_row", role, c, f"{body} AND {full(c)}") for role, c in (("relay", "relay_status"), ("on", "on_delay"), ("off", "off_delay"))]
    heads = [
        f"SELECT variant, 0 AS step_idx, {r} AS row_no, {L.COLUMNS[name][role]} AS col_no, '{text}' AS value FROM lay WHERE layout = '{name}'" for name, cells in L.HEADER.items() for r, role, text in cells
    ]
    dips = "SELECT variant, 0, 3 + i - 1, 7, v FROM (SELECT lay.variant, unnest(dip_switches) AS v, generate_subscripts(dip_switches, 1) AS i FROM lay JOIN lf ON lay.variant = lf.variant WHERE layout = 'A') u"
    notice = f"SELECT lay.variant, 0, CASE WHEN layout = 'A' THEN 10 ELSE 5 END, 6, '{L.NO_DATA}' FROM lay JOIN lf ON lay.variant = lf.variant WHERE NOT {full('ref_voltage')} AND lay.variant NOT IN (SELECT variant FROM lo)"
    union = "\n UNION ALL ".join(heads + [dips, notice] + parts)
    return f"{adv}, wr AS ({union}), sc AS (SELECT variant, CAST(row_no AS INT) AS row_no, CAST(col_no AS INT) AS col_no, arg_max(value, step_idx) AS value FROM wr GROUP BY ALL), ce AS (SELECT * FROM sc WHERE value <> '')"


for _fx, _sql in (("steps", ADV_A), ("steps_b", ADV_B)):
    register(f"out_05_sheet_cells_{_fx}", f"WITH {cells_sql(_sql)} SELECT * FROM ce", ("specs", _fx))(
        lambda fx, f=_fx: L.sheet_cells(fx.specs, dipped(fx) if f == "steps" else fx.steps_b)
    )


def as_sheet(cells):
    return cells.select(F.col("variant").alias("sheet"), "row_no", "col_no", "value")


def with_perturbed(cells):
    """Every cell and its copy, with some cells changed and some gone, told apart by ``is_gen``."""
    turn = (F.col("row_no") * 31 + F.col("col_no")) % 40
    copy = F.when(turn == 7, F.concat("value", F.lit("*"))).otherwise(F.col("value"))
    sides = F.array(F.struct(F.col("value").alias("value"), F.lit(False).alias("is_gen")), F.struct(copy.alias("value"), F.lit(True).alias("is_gen")))
    return cells.select("sheet", "row_no", "col_no", F.inline(F.when(turn == 3, F.slice(sides, 1, 1)).otherwise(sides)))


register(
    "cmp_04_generated_sheets",
    f"""WITH {cells_sql(ADV_B)}, pc AS (SELECT *, (row_no * 31 + col_no) % 40 AS turn FROM ce), n AS (SELECT variant AS sheet, count_if(turn NOT IN (3, 7))::BIGINT AS correct, count_if(turn = 7)::BIGINT AS wrong, count_if(turn = 3)::BIGINT AS missing, 0::BIGINT AS extra, count(*) AS total FROM pc GROUP BY variant)
SELECT *, correct / total * 100 AS percent, CASE WHEN correct / total * 100 >= 90 THEN 'PASS' ELSE 'FAIL' END AS status FROM n""",
    BS,
)(lambda fx: C.accuracy_of(with_perturbed(as_sheet(L.sheet_cells(fx.specs, fx.steps_b)))))  # the copy is made beside its sheet
