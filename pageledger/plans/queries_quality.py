"""Data quality queries."""

from pyspark.sql import functions as F

from pageledger.functions import patterns as P
from pageledger.operators import quality as Q
from pageledger.plans.quality import quality_report
from pageledger.plans.registry import lit, register, sql_strip

SPEC_FIELDS = ("uv_range", "ov_range", "lv_cutoff", "hv_cutoff", "asymmetry")
RX = "(?i)" + P.TIME_WORDS
SFX = "(?i)" + P.TIME_SUFFIX


def full(c: str) -> str:
    return f"coalesce(length({c}) > 0, false)"


def digit(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '[0-9]'), false)"


def range_sql(c: str, end: str) -> str:
    a, b = (f"try_cast(nullif(regexp_extract({c}, {lit(P.RANGE)}, {i}), '') AS DOUBLE)" for i in (1, 2))
    one = f"try_cast(nullif(regexp_extract({c}, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE)"
    pick = "least" if end == "lo" else "greatest"
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {pick}({a}, {b}) ELSE {one} END)"


def flags_sql(rows, keys="machine, variant", scope="spec", source="fx_specs") -> str:
    """Union of rules given as (condition, rule, field, detail, message)."""
    parts = [
        f"SELECT {keys}, '{scope}' AS scope, '{r}' AS rule_id, {'CAST(NULL AS VARCHAR)' if f is None else lit(f)} AS field, "
        f"{'CAST(NULL AS VARCHAR)' if d is None else d} AS detail, {m} AS message FROM {source} WHERE {c}"
        for c, r, f, d, m in rows
    ]
    return "\nUNION ALL ".join(parts)


R1 = [
    (f"{full('voltage_unit')} AND voltage_unit NOT IN ('P-P', 'P-N')", "R1", "voltage_unit", "voltage_unit", "concat('unknown voltage_unit: ''', voltage_unit, '''')"),
    (f"NOT {full('voltage_unit')}", "R1", "voltage_unit", None, "'voltage_unit is not given'"),
]
R2 = [(f"NOT {full('uv_range')} AND NOT {full('ov_range')} AND NOT {full('lv_cutoff')}", "R2", None, None, "'no range of voltages is given'")] + [
    (f"{full(f)} AND NOT {digit(f)}", "R2", f, f, f"concat('{f} holds no number: ''', {f}, '''')") for f in ("uv_range", "ov_range", "asymmetry")
]
R3 = [
    (f"{full(f)} AND NOT regexp_matches({sql_strip(f)}, {lit('(?i)' + P.PERCENT)})", "R3", f, f, f"concat('{f} is no percentage: ''', {f}, '''')")
    for f in ("uv_threshold_pct", "ov_threshold_pct")
]
_uv, _ov, _lv, _hv = range_sql("uv_range", "hi"), range_sql("ov_range", "lo"), range_sql("lv_cutoff", "hi"), range_sql("hv_cutoff", "lo")
R45 = [
    (f"{_uv} >= {_ov}", "R4", "uv_range", None, f"concat('UV max (', CAST({_uv} AS VARCHAR), ') >= OV min (', CAST({_ov} AS VARCHAR), ') cannot both hold')"),
    (f"{_lv} >= {_hv}", "R5", "lv_cutoff", None, "'LV cutoff >= HV cutoff cannot both hold'"),
]
R6 = [
    (f"{full(f)} AND NOT regexp_matches({f}, {lit(RX)}) AND NOT regexp_matches({f}, {lit(SFX)}) AND {digit(f)}", "R6", f, f, f"concat('{f} has no unit of time: ''', {f}, '''')")
    for f in ("on_delay", "off_delay")
]

register(
    "dq_01_parse_range",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT machine, variant, '{f}' AS field, {range_sql(f, 'lo')} AS lo, {range_sql(f, 'hi')} AS hi FROM fx_specs" for f in SPEC_FIELDS
    ) + ") x WHERE lo IS NOT NULL",
    "specs",
)(lambda fx: Q.parse_ranges(fx.specs, SPEC_FIELDS))
for _name, _rows, _fn in (
    ("dq_02_unit_rules", R1, Q.unit_rules), ("dq_03_range_rules", R2, Q.range_rules), ("dq_04_percent_rule", R3, Q.percent_rule),
    ("dq_05_order_rules", R45, Q.order_rules), ("dq_06_delay_rules", R6, Q.delay_rules),
):
    register(_name, flags_sql(_rows), "specs")(lambda fx, f=_fn: f(fx.specs))

PEERS = """pr AS (SELECT machine, variant, 'uv_range' AS field, uv_threshold_pct AS pct, uv_range AS rng FROM fx_specs
   UNION ALL SELECT machine, variant, 'ov_range', ov_threshold_pct, ov_range FROM fx_specs),
 pk AS (SELECT * FROM pr WHERE length(pct) > 0 AND length(rng) > 0),
 pd AS (SELECT machine, field, pct FROM pk GROUP BY ALL HAVING count(DISTINCT rng) > 1)"""
PEER_ROWS = """SELECT machine, variant, 'spec' AS scope, 'R7' AS rule_id, field, pct AS detail,
 concat('variants with the same ', pct, ' differ in ', field, '') AS message FROM pk JOIN pd USING (machine, field, pct)"""
register("dq_07_peer_consistency", f"WITH {PEERS} {PEER_ROWS}", "specs")(lambda fx: Q.peer_consistency(fx.specs))


def step_rows(v: str = "voltages_pn"):
    bad = f"list_filter({v}, lambda x: NOT regexp_matches(x, '[0-9]'))"
    return [
        (f"NOT coalesce(length({sql_strip('step_name')}) > 0, false)", "R8", "step_name", None, "'step_name is not given'"),
        (f"len({bad}) = len({v})", "R8", "voltages_pn", None, "'voltages_pn holds no number'"),
        (f"len({bad}) > 0", "R8", "voltages_pn", f"{bad}[1]", f"concat('an entry of voltages_pn holds no number: ''', {bad}[1], '''')"),
    ]


STEP = dict(keys="variant, step_idx", scope="step", source="fx_steps")
register("dq_08_step_rules", flags_sql(step_rows(), **STEP), "steps")(lambda fx: Q.step_rules(fx.steps))
NO_STEPS = flags_sql(
    [("variant NOT IN (SELECT variant FROM fx_steps)", "NO_STEPS", None, None, "'no steps were read'")], source="fx_variants"
)
register("dq_09_no_steps", NO_STEPS, ("variants", "steps"))(lambda fx: Q.no_steps(fx.variants, fx.steps))
SECOND = """SELECT machine, variant, replace(uv_range, '15', '16') AS uv_range, ov_range, CASE WHEN voltage_unit = 'P-N' THEN '200' ELSE ref_voltage END AS ref_voltage,
 upper(on_delay) AS on_delay, off_delay FROM"""
register(
    "dq_10_source_mismatch",
    f"WITH b AS ({SECOND} fx_specs), j AS (SELECT a.*, b.uv_range AS b_uv_range, b.ov_range AS b_ov_range, b.ref_voltage AS b_ref_voltage, b.on_delay AS b_on_delay, b.off_delay AS b_off_delay FROM fx_specs a JOIN b USING (machine, variant))\n"
    + flags_sql(
        [(f"{full(f)} AND {full('b_' + f)} AND {f} <> b_{f}", "SOURCE", f, f, f"concat('{f} mismatch (table=''', {f}, ''' vs vision=''', b_{f}, ''')')") for f in ("uv_range", "ov_range", "ref_voltage", "on_delay", "off_delay")],
        source="j",
    ),
    "specs",
)(lambda fx: Q.source_mismatch(fx.specs, fx.spark.sql(SECOND + " {s}", s=fx.specs)))


def with_leds(specs):
    """The fixture lists keys and values in turn; operators take the map."""
    odd = lambda want: F.filter("led_words", lambda x, i: i % 2 == want)
    return specs.withColumn("led_indications", F.map_from_arrays(odd(0), odd(1))).drop("led_words")


LEDS = """lw AS (SELECT machine, variant, upper(array_to_string(list_concat(led_words[1:5:2], led_words[2:5:2]), ' ')) AS w FROM fx_specs),
 lx AS (SELECT machine, variant, w, list_concat(CASE WHEN regexp_matches(w, 'PWR|POWER|GREEN') THEN ['PWR'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN contains(w, 'UV') THEN ['UV'] ELSE CAST([] AS VARCHAR[]) END,
   CASE WHEN contains(w, 'OV') THEN ['OV'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN contains(w, 'ASY') THEN ['ASY'] ELSE CAST([] AS VARCHAR[]) END) AS e FROM lw),
 le AS (SELECT machine, variant, CASE WHEN len(e) > 0 THEN e WHEN w <> '' AND (contains(w, 'R ') OR contains(w, 'RED')) THEN ['R'] ELSE ['PWR', 'UV', 'OV', 'ASY'] END AS expected FROM lx)"""
register("dq_11_expected_leds", f"WITH {LEDS} SELECT machine, variant, array_to_string(expected, '|') AS expected FROM le", "specs")(
    lambda fx: Q.expected_leds(with_leds(fx.specs)).withColumn("expected", F.array_join("expected", "|"))
)
KEEP = r"list_filter(voltages_pn, lambda x: regexp_matches(x, '[0-9]') OR regexp_matches(x, '(?i)phase\s+angle'))"
register("dq_12_clean_voltages", f"SELECT variant, step_idx, array_to_string({KEEP}, '|') AS voltages_pn FROM fx_steps", "steps")(
    lambda fx: Q.clean_voltages(fx.steps).select("variant", "step_idx", F.array_join("voltages_pn", "|").alias("voltages_pn"))
)
DROPPED = r"""dr AS (SELECT variant, step_idx, unnest(list_filter(voltages_pn, lambda x: NOT (regexp_matches(x, '[0-9]') OR regexp_matches(x, '(?i)phase\s+angle')))) AS v FROM fx_steps)"""
VOLT = "SELECT variant, step_idx, 'step' AS scope, 'VOLTAGE' AS rule_id, 'voltages_pn' AS field, v AS detail, concat('no voltage: ', v) AS message FROM dr\nUNION ALL " + flags_sql(
    [
        (f"len({KEEP}) = 0", "VOLTAGE", "voltages_pn", None, "'missing voltages'"),
        (f"len({KEEP}) BETWEEN 1 AND 2", "VOLTAGE", "voltages_pn", None, f"concat('only some voltages are given (', CAST(len({KEEP}) AS VARCHAR), '/3)')"),
    ],
    **STEP,
)
register("dq_12_voltage_flags", f"WITH {DROPPED} {VOLT}", "steps")(lambda fx: Q.voltage_flags(fx.steps))
MISSING = """ml AS (SELECT s.variant, s.step_idx, s.leds, unnest(expected) AS e FROM fx_steps s JOIN le USING (variant))"""
MISSING_ROWS = """SELECT variant, step_idx, 'step' AS scope, 'LED' AS rule_id, 'leds' AS field, e AS detail, concat(e, ' LED is not listed') AS message FROM ml
 WHERE len(list_filter(leds, lambda x: contains(upper(x), e))) = 0"""
register("dq_13_missing_leds", f"WITH {LEDS}, {MISSING} {MISSING_ROWS}", ("specs", "steps"))(
    lambda fx: Q.missing_leds(fx.steps, Q.expected_leds(with_leds(fx.specs)))
)


def delay_rows(unit: str):
    rows = []
    for f in ("on_delay", "off_delay"):
        u = unit.format(f=f"lower({sql_strip(f)})")
        rows.append((f"{full(f)} AND NOT ({u})", "DELAY", f, f, f"concat('{f} has no unit of time: ''', {f}, '''')"))
        rows.append((f"{full(f)} AND ({u}) AND NOT regexp_matches({f}, '(?i)-|to') AND NOT {digit(f)}", "DELAY", f, f, f"'{f} format suspicious'"))
    return rows


ANY_S = f"regexp_matches({{f}}, {lit(RX + '|s')})"
STRICT = f"regexp_matches({{f}}, {lit(RX)}) OR regexp_matches({{f}}, {lit(SFX)})"
register("dq_14_step_delay_rules", flags_sql(delay_rows(ANY_S), **STEP), "steps")(lambda fx: Q.step_delay_rules(fx.steps))
register("dq_14_step_delay_rules_strict", flags_sql(delay_rows(STRICT), **STEP), "steps")(
    lambda fx: Q.step_delay_rules(fx.steps, strict_units=True)
)
CLEARED = ("machine", "variant", "uv_range", "ov_range", "lv_cutoff", "hv_cutoff")
for _compat in (False, True):
    _r4, _r5 = f"coalesce({_uv} >= {_ov}, false)", f"coalesce({_lv} >= {_hv}, false)"
    _rng = f"{_r4} OR {_r5}" if _compat else _r4
    register(
        "dq_15_sanitize_specs" + ("_compat" if _compat else ""),
        f"""SELECT machine, variant, CASE WHEN NOT ({_rng}) THEN uv_range END AS uv_range, CASE WHEN NOT ({_rng}) THEN ov_range END AS ov_range,
 lv_cutoff, CASE WHEN {'true' if _compat else f'NOT {_r5}'} THEN hv_cutoff END AS hv_cutoff FROM fx_specs""",
        "specs",
    )(lambda fx, c=_compat: Q.sanitize_specs(fx.specs, Q.order_rules(fx.specs), compat=c).select(*CLEARED))
ANCHOR = "(" + full("ref_voltage") + f" OR ({full('{uv}')} AND {full('{ov}')}) OR " + full("lv_cutoff") + ")"
COUNTS = "sc AS (SELECT variant, count(*) AS n_steps, count_if(len(list_filter(voltages_pn, lambda x: regexp_matches(x, '[0-9]'))) > 0) AS n_voltage_steps FROM fx_steps GROUP BY variant)"
register(
    "dq_16_usable",
    f"""WITH {COUNTS}, j AS (SELECT s.*, coalesce(n_steps, 0) AS n_steps, coalesce(n_voltage_steps, 0) AS n_voltage_steps, {ANCHOR.format(uv='uv_range', ov='ov_range')} AS has_anchor FROM fx_specs s LEFT JOIN sc USING (variant))
SELECT machine, variant, CAST(n_steps AS BIGINT) AS n_steps, CAST(n_voltage_steps AS BIGINT) AS n_voltage_steps, has_anchor, n_voltage_steps >= 2 OR (has_anchor AND n_steps >= 1) AS usable FROM j""",
    ("specs", "steps"),
)(lambda fx: Q.usable(fx.specs, fx.steps))

# after cleaning, a voltage left in a step either holds a digit or speaks of the phase angle
CLEANED = f"cl AS (SELECT * REPLACE ({KEEP} AS voltages_pn) FROM fx_steps)"
SUMMARY = f"""{LEDS}, {MISSING}, {DROPPED}, {CLEANED}, {COUNTS.replace('FROM fx_steps', 'FROM cl')}, {PEERS},
 sf AS ({flags_sql(R1 + R2 + R3 + R6)} UNION ALL {PEER_ROWS}),
 nf AS (SELECT machine, variant, count(*) AS spec_flags FROM sf GROUP BY ALL),
 tf AS ({VOLT} UNION ALL {MISSING_ROWS} UNION ALL {flags_sql(delay_rows(ANY_S), **STEP)} UNION ALL {flags_sql(step_rows(), **{**STEP, 'source': 'cl'})}),
 nt AS (SELECT variant, count(DISTINCT step_idx) AS flagged_steps FROM tf GROUP BY variant),
 vs AS (SELECT machine, variant, coalesce(n_voltage_steps, 0) >= 2 OR (coalesce(n_steps, 0) >= 1 AND ({full('ref_voltage')}
     OR ({full('uv_range')} AND {full('ov_range')} AND NOT coalesce({_uv} >= {_ov}, false)) OR {full('lv_cutoff')})) AS usable,
   CAST(coalesce(spec_flags, 0) + CASE WHEN n_steps IS NULL THEN 1 ELSE 0 END AS BIGINT) AS spec_flags, CAST(coalesce(flagged_steps, 0) AS BIGINT) AS flagged_steps
  FROM fx_specs LEFT JOIN sc USING (variant) LEFT JOIN nf USING (machine, variant) LEFT JOIN nt USING (variant))"""


def report(fx):
    return quality_report(with_leds(fx.specs), fx.steps)


register("dq_17_variant_summary", f"WITH {SUMMARY} SELECT * FROM vs", ("specs", "steps"))(lambda fx: report(fx).variants)
register(
    "dq_17_machine_summary",
    f"""WITH {SUMMARY} SELECT machine, CASE WHEN bool_or(usable) THEN 'ok' ELSE 'no_usable_data' END AS status,
 CASE WHEN bool_or(usable) THEN count_if(usable)::BIGINT ELSE count(*) END AS n_variants, CAST(sum(CASE WHEN usable THEN spec_flags ELSE 0 END) AS BIGINT) AS spec_flags,
 CAST(sum(CASE WHEN usable THEN flagged_steps ELSE 0 END) AS BIGINT) AS flagged_steps FROM vs GROUP BY machine""",
    ("specs", "steps"),
)(lambda fx: report(fx).machines)
register(
    "dq_17_rule_counts",
    f"WITH {SUMMARY} SELECT machine, rule_id, count(*) AS n FROM sf GROUP BY ALL UNION ALL SELECT machine, 'NO_STEPS', count(*) FROM fx_specs WHERE variant NOT IN (SELECT variant FROM fx_steps) GROUP BY machine",
    ("specs", "steps"),
)(lambda fx: report(fx).spec_flags.groupBy("machine", "rule_id").agg(F.count("*").alias("n")))
