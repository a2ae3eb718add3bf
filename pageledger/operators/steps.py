"""Ordered test steps of layout A (several LEDs, DIP switches).

``steps(variant, step_idx, step_name, settings, voltages_pn, voltage_pp, leds, relay_status, on_delay, off_delay, section_break)``. Where a
rule looks at neighbours or at the section, ``step_idx`` must be dense from 1 (see ``ordered.renumber``). Rules are applied in the
order of this file. ``ctx`` is one row per variant with what the pages say.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import filled, first_match, rx, strip
from pageledger.functions.values import PN, PP, is_spurious_delay, phases, plain_number, voltage_value
from pageledger.operators.ordered import UNKNOWN, following, previous, renumber, running_last, running_max, running_sum, width_for, with_running
from pageledger.session import materialize

KEYS = ("variant",)
OV_KINDS = "ov healthy|ov faulty|ov hystersis"
NO_VOLTAGE_KINDS = "dip s/w|supply|run time"


def _name() -> Column:
    return F.lower(strip(F.coalesce("step_name", F.lit(""))))


def _has(text: str, name: Column | None = None) -> Column:
    return F.contains(_name() if name is None else name, F.lit(text))


def _none() -> Column:
    return F.array().cast("array<string>")


def procedure_layout(specs: DataFrame, pages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """B for cut-off machines: the page heading says so, or specs have cut-offs and neither thresholds nor UV/OV ranges."""
    heading = pages.groupBy(*keys).agg(F.bool_or(rx(F.col("text"), P.CUTOFF_HEADING)).alias("_heading"))
    cutoffs = filled(F.col("lv_cutoff")) | filled(F.col("hv_cutoff"))
    other = [filled(F.col(c)) for c in ("uv_threshold_pct", "ov_threshold_pct", "uv_range", "ov_range")]
    by_specs = cutoffs & ~(other[0] | other[1] | other[2] | other[3])
    layout = F.when(F.coalesce("_heading", F.lit(False)) | by_specs, "B").otherwise("A")
    return specs.join(heading, list(keys), "left").select(*keys, layout.alias("layout"))


def blank_step(steps: DataFrame, name: Column, step_idx: Column, section_break: bool) -> dict[str, Column]:
    """Values of an inserted label step."""
    out = {}
    for f in steps.schema.fields:
        empty = _none() if f.dataType.simpleString().startswith("array") else F.lit(None).cast(f.dataType)
        out[f.name] = empty
    return {**out, "step_name": name, "step_idx": step_idx, "section_break": F.lit(section_break)}


def couple_voltage(pages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The coupling voltage of the first page that names one."""
    p = P.COUPLE_VOLTAGE
    t = F.col("text")
    volts = F.when(t.rlike(p), F.coalesce(F.nullif(F.regexp_extract(t, p, 1), F.lit("")), F.regexp_extract(t, p, 2)))
    return pages.groupBy(*keys).agg(F.min_by(volts, F.when(volts.isNotNull(), F.col("page_num"))).alias("volts"))


def insert_couple_marker(steps: DataFrame, pages: DataFrame, keys: Sequence[str] = KEYS, width: int | None = UNKNOWN) -> DataFrame:
    """Insert "Supply couple at N VAC" before the first symmetrical healthy step of a variant that lacks it."""
    k = list(keys)
    healthy = rx(F.col("step_name"), r"^(?:UV|OV)\s+symm+etrical\s+Healthy")
    facts = steps.groupBy(*k).agg(
        F.bool_or(rx(F.col("step_name"), r"^supply\s+couple")).alias("_couple"), F.min(F.when(healthy, F.col("step_idx"))).alias("_at")
    )
    at = facts.filter("NOT _couple AND _at IS NOT NULL").join(couple_voltage(pages, k), k).filter("volts IS NOT NULL")
    label = F.concat(F.lit("Supply couple at "), F.col("volts"), F.lit(" VAC"))
    values = blank_step(steps, label, F.col("_at") - 0.5, True)
    added = at.select(*k, *[c.alias(n) for n, c in values.items() if n not in k])
    joined = steps.withColumn("step_idx", F.col("step_idx").cast("double")).unionByName(added.select(*steps.columns))
    return renumber(joined, k, "step_idx", "step_idx", width)


def drop_section_labels(steps: DataFrame) -> DataFrame:
    """Remove heading-like steps, but not DIP changes and supply steps."""
    n = F.coalesce("step_name", F.lit(""))
    keep = (F.contains(n, F.lit("DIP S/W")) & F.contains(n, F.lit("Change"))) | rx(n, r"^(supply |dip s/w)")
    return steps.filter(keep | ~rx(n, P.SECTION_LABEL))


def canonical_step_names(steps: DataFrame) -> DataFrame:
    n = F.col("step_name")
    n = F.regexp_replace(n, r"(?i)\bsymmetrical\b", "symmmetrical")
    n = F.regexp_replace(n, r"(?i)\s*\(symm+etrical\)\s*$", "")
    n = F.regexp_replace(n, r"(?i)\s*\(sym\)\s*$", "")
    n = F.regexp_replace(n, r"(?i)\bhysteresis\b", "hystersis")
    n = F.when(n.rlike(r"(?i)^[uo]v faulty condition with delay"), strip(F.replace(n, F.lit("with delay"), F.lit("")))).otherwise(n)
    return steps.withColumn("step_name", F.regexp_replace(n, r"(?i)\s+Ph-[NP].*$", ""))


def canonical_leds(steps: DataFrame) -> DataFrame:
    """One word for blinking; the colour of ASY and PWR goes, except that asymmetry steps name the red ASY LED."""
    asymmetry = _has("asymmetry", F.lower(F.coalesce("step_name", F.lit(""))))

    def led(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?i)(?:Fast|Slow)?\s*Blink(?:ing)?\s*\([^)]*\)", "BLINKING")
        x = F.regexp_replace(x, r"(?i)\bBlinking\b", "BLINKING")
        x = F.regexp_replace(x, r"BLINKING\s*\([^)]*\)", "BLINKING")
        plain = F.regexp_replace(x, r"(?i)(ASY|PWR)\s*\([^)]*\)\s*:", "$1 :")
        red = F.regexp_replace(x, r"(?i)^ASY\s*:", "ASY (RED LED):")
        return F.when(F.contains(F.upper(x), F.lit("BLINKING")), F.when(asymmetry, red).otherwise(plain)).otherwise(x)

    return steps.withColumn("leds", F.transform("leds", led))


# ---- what the pages say ------------------------------------------------------------------------------------------------


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("page_num")))


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("page_num")))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return first_match(text, pattern, group).try_cast("double")


def layout_a_context(pages: DataFrame, keys: Sequence[str] = KEYS, names: Column | None = None) -> DataFrame:
    """Facts for the step rules, each from the first or the last page that states it.

    ``names`` is a pattern column with the variant's own names: text before the first mention belongs to another variant and is
    not searched for the section's nominal voltage.
    """
    t = F.coalesce("text", F.lit(""))
    hyst = P.RESET_HYSTERESIS
    lows = F.zip_with(F.regexp_extract_all(t, F.lit(hyst), F.lit(1)), F.regexp_extract_all(t, F.lit(hyst), F.lit(2)), lambda a, b: F.least(a.try_cast("double"), b.try_cast("double")))
    recovery = F.bround(F.get(F.filter(lows, lambda v: v > 350), 0) / P.SQRT3) - 5
    symmetric = t.rlike(r"(?i)symmetric\s+ov|symmetr.*\sov\s")
    span = P.TRIP_RANGE
    pairs = F.zip_with(
        F.regexp_extract_all(t, F.lit(f"(?i){span}"), F.lit(1)), F.regexp_extract_all(t, F.lit(f"(?i){span}"), F.lit(2)),
        lambda a, b: F.struct(F.least(a.try_cast("double"), b.try_cast("double")).alias("lo"), F.greatest(a.try_cast("double"), b.try_cast("double")).alias("hi")),
    )
    trip = F.when(symmetric, F.try_element_at(F.filter(pairs, lambda p: p["hi"] < 400), F.lit(-1)))
    sym_hyst = F.when(symmetric, _number(t, rf"(?is)hysteresis.*?{span}", 2))
    switch = lambda bits: F.array(*[F.concat(F.lit(f"{i + 1} : "), F.when(b == "1", "ON").otherwise("OFF")) for i, b in enumerate(bits)])
    grid = r"(?s)1\s+2\s+3\s+(\d)\s+(\d)\s+(\d).*?4\s+(\d).*?5\s+(\d)"
    section_b = F.when(t.rlike(grid), switch([F.regexp_extract(t, grid, i) for i in range(1, 6)]))
    listed = r"(?s)(\d)\s*=\s*(\d).*?(\d)\s*=\s*(\d).*?(\d)\s*=\s*(\d).*?(\d)\s*=\s*(\d).*?(\d)\s*=\s*(\d)"
    run_time = F.when(t.rlike(r"(?i)run time|runtime") & t.rlike(listed), switch([F.regexp_extract(t, listed, i) for i in range(2, 11, 2)]))
    in_b = t.rlike(r"(?i)B\]\s*Goal|Over\s+Voltage|480V|Ph-Ph")
    ov_pct = F.when(in_b, first_match(t, r"(?i)OV\s*pot\s*[-–—]\s*(\d+)\s*%"))
    delay = F.when(in_b, first_match(t, r"(?i)Delay\s*pot\s*[-–—]\s*(\d+)\s*sec"))
    own = t if names is None else F.when(F.rlike(t, names), F.regexp_substr(t, F.concat(F.lit("(?s)"), names, F.lit(".*")))).otherwise(t)
    nominal = _number(own, r"(?is)C\]\s*Goal.*?(?:Neutral\s+at|at)\s+(\d+)\s*V")
    page = F.col("page_num")
    facts = pages.groupBy(*keys).agg(
        _first(recovery).alias("ov_recovery"), _last(trip).alias("trip"), _last(sym_hyst).alias("sym_hyst_hi"), _first(section_b).alias("section_b_dips"),
        _first(run_time).alias("run_time_dips"), _first(ov_pct).alias("ov_pct"), _first(nominal).alias("nominal"),
        F.min(F.when(ov_pct.isNotNull(), page)).alias("_stop"),
    )
    # the search for a delay ends with the page that gives the OV percentage
    delays = pages.select(*keys, "page_num", delay.alias("_d")).filter("_d IS NOT NULL").join(facts.select(*keys, "_stop"), list(keys))
    last_delay = delays.filter("_stop IS NULL OR page_num <= _stop").groupBy(*keys).agg(F.max_by("_d", "page_num").alias("delay"))
    return facts.join(last_delay, list(keys), "left").select(
        *keys, "ov_recovery", F.col("trip.lo").alias("trip_lo"), F.col("trip.hi").alias("trip_hi"), "sym_hyst_hi", "section_b_dips", "run_time_dips",
        "ov_pct", "delay", "nominal",
    )


# ---- section state and the rules that use it ---------------------------------------------------------------------------


def section_state(steps: DataFrame, ctx: DataFrame, keys: Sequence[str] = KEYS, width: int | None = UNKNOWN) -> DataFrame:
    """Adds ``later`` (from the first "supply off change" on), ``pair`` (1 or 2 in a run-time DIP pair), ``nominal`` (phase voltage of the
    later section) and ``ov_seen`` (an earlier step name holds "ov"). Steps that share a number enter the later section together.

    The nominal comes from the pages; a couple step's own voltage overrides it; the voltage in a couple step's name counts only
    while nothing else is known.
    """
    k = list(keys)
    n = _name()
    run_time, dip = _has("run time dip", n), _has("dip", n)
    width = width_for(steps, k, "step_idx") if width == UNKNOWN else width
    near = with_running(
        steps, k, "step_idx", width=width, _prev_run=previous(run_time), _next_dip=following(dip),
        _last_other=running_last(F.when(~run_time, F.col("step_idx")), inclusive=False),
    )
    # in a row of run-time steps every second one closes the pair opened by the one before
    place = F.col("step_idx") - F.coalesce("_last_other", F.lit(0))
    first = run_time & (place % 2 == 1) & F.coalesce("_next_dip", F.lit(False))
    second = F.coalesce("_prev_run", F.lit(False)) & ((place - 1) % 2 == 1) & dip
    paired = near.withColumn("pair", F.when(first, 1).when(second, 2).otherwise(0)).drop("_prev_run", "_next_dip", "_last_other")
    alone = F.col("pair") == 0
    opened = with_running(paired, k, "step_idx", width=width, later=running_max(alone & _has("supply off change"), peers=True), ov_seen=running_max(_has("ov"), inclusive=False))
    opened = opened.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("later", "ov_seen")})
    couple = alone & F.col("later") & _has("supply couple")
    own = F.when(couple, voltage_value(F.get("voltages_pn", 0)))
    named = _number(F.col("step_name"), r"(?i)(\d+)\s*(?:VAC|V)")
    named = F.when(couple, F.when(named > 300, F.bround(named / P.SQRT3, 1)).otherwise(named))
    # the earliest name voltage: the running maximum of (-position, value)
    out = with_running(
        opened, k, "step_idx", width=width, _own=running_last(own, peers=True),
        _named=running_max(F.when(named.isNotNull(), F.struct((-F.col("step_idx")).alias("at"), named.alias("v"))), peers=True),
    ).join(ctx.select(*k, F.col("nominal").alias("_page_nominal")), k, "left")
    return out.withColumn("nominal", F.coalesce("_own", "_page_nominal", F.col("_named.v"))).drop("_own", "_named", "_page_nominal")


def drop_repeat_supply_off(state: DataFrame) -> DataFrame:
    """A plain "supply off" after the change of section is dropped."""
    return state.filter(~(F.col("later") & (F.col("pair") == 0) & (_name() == "supply off")))


def runtime_dip_pair(state: DataFrame, ctx: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A run-time DIP pair: the first step is blanked, the second gets the parsed switches and recovery voltages."""
    d = state.join(ctx.select(*keys, "ov_recovery", "run_time_dips"), list(keys), "left")
    one, two = F.col("pair") == 1, F.col("pair") == 2
    v = F.bround("ov_recovery").cast("int")
    pp = F.bround(F.col("ov_recovery") * P.SQRT3).cast("int")
    known = two & F.col("ov_recovery").isNotNull()
    return d.withColumns(
        {
            "settings": F.when(two, F.coalesce("run_time_dips", "settings")).otherwise(F.col("settings")),
            "voltages_pn": F.when(one, _none()).when(known, phases(PN, v)).otherwise(F.col("voltages_pn")),
            "voltage_pp": F.when(one, _none()).when(known, phases(PP, pp)).otherwise(F.col("voltage_pp")),
            "leds": F.when(one, _none()).otherwise(F.col("leds")),
            "relay_status": F.when(~one, F.col("relay_status")),
            "on_delay": F.when(~one, F.col("on_delay")),
            "section_break": F.when(one | two, F.lit(False)).otherwise(F.col("section_break")),
        }
    ).select(*state.columns)


def _alone() -> Column:
    return F.col("pair") == 0


def section_b_settings(state: DataFrame, ctx: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """DIP steps after the first step and before any OV step take section B's switches; OV steps take its percent and delay."""
    d = state.join(ctx.select(*keys, "section_b_dips", "ov_pct", "delay"), list(keys), "left")
    dips = _alone() & _has("dip s/w") & F.col("section_b_dips").isNotNull() & (F.col("step_idx") > 1) & ~F.col("ov_seen")
    ov = _alone() & _name().rlike(OV_KINDS) & (F.col("ov_pct").isNotNull() | F.col("delay").isNotNull())

    def setting(s: Column) -> Column:
        percent = F.contains(F.upper(s), F.lit("OV")) & F.contains(s, F.lit("%")) & F.col("ov_pct").isNotNull()
        t = F.when(percent, F.concat(F.lit("OV = "), F.col("ov_pct"), F.lit(" %"))).otherwise(s)
        wait = F.contains(F.upper(t), F.lit("DELAY")) & F.col("delay").isNotNull()
        return F.when(wait, F.concat(F.lit("DELAY = "), F.col("delay"), F.lit(" SEC"))).otherwise(t)

    taken = F.when(dips, F.col("section_b_dips")).otherwise(F.col("settings"))
    return d.withColumn("settings", F.when(ov, F.transform(taken, setting)).otherwise(taken)).select(*state.columns)


def symmetric_ov(state: DataFrame, ctx: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trip range and hysteresis applied to the four kinds of symmetrical OV step."""
    d = state.join(ctx.select(*keys, "trip_lo", "trip_hi", "sym_hyst_hi"), list(keys), "left")
    n = _name()
    sym = _has("ov symmmetrical", n)
    volts = (
        F.when(_has("ov symmmetrical healthy", n), F.col("trip_hi"))
        .when(_has("ov symmmetrical faulty", n), F.col("trip_lo"))
        .when(sym & _has("not recovery", n), F.col("trip_hi"))
        .when(sym & _has("recovery", n) & ~_has("not", n), F.col("trip_hi") + F.col("sym_hyst_hi"))
    )
    return d.withColumn(
        "voltages_pn", F.when(_alone() & volts.isNotNull(), phases(PN, plain_number(F.bround(volts, 1)))).otherwise(F.col("voltages_pn"))
    ).select(*state.columns)


def settings_spacing(state: DataFrame, section_a: int = P.SECTION_A_UV_PERCENT, wide: int = P.WIDE_OV_PERCENT) -> DataFrame:
    """House spacing of DELAY, OV and UV settings, which depends on the section."""
    in_a = F.array_join("settings", " ").rlike(rf"(?i)UV\s*=\s*{section_a}\s*%") & ~_name().rlike(OV_KINDS)
    later = F.col("later")

    def setting(s: Column) -> Column:
        s = F.regexp_replace(s, r"(?i)\bsec\b", "SEC")
        delay = F.when(in_a, F.regexp_replace(s, r"(\d+)\s+SEC", "$1SEC")).otherwise(F.regexp_replace(s, r"(\d+)SEC", "$1 SEC"))
        s = F.when(F.contains(F.upper(s), F.lit("DELAY")), delay).otherwise(s)
        is_wide = s.rlike(rf"=\s*{wide}\s*%")
        ov = (
            F.when(is_wide & later, F.regexp_replace(s, rf"({wide})\s*%", "$1 %")).when(is_wide, F.regexp_replace(s, rf"({wide})\s+%", "$1%"))
            .when(~in_a, F.regexp_replace(s, r"(\d+)\s*%", "$1 %")).otherwise(s)
        )
        return F.when(s.rlike(r"(?i)^OV\s*="), ov).when(s.rlike(r"(?i)^UV\s*="), F.regexp_replace(s, r"(\d+)\s+%", "$1%")).otherwise(s)

    return state.withColumn("settings", F.when(_alone(), F.transform("settings", setting)).otherwise(F.col("settings")))


def derive_phase_phase(state: DataFrame) -> DataFrame:
    """In the later section missing phase-phase voltages follow from the phase voltages, cut to whole numbers."""
    labels = F.array(*[F.lit(x) for x in PP])
    each = F.transform(
        F.slice("voltages_pn", 1, 3),
        lambda v, i: F.concat(F.get(labels, i), F.lit(" : "), (voltage_value(v) * P.SQRT3).cast("int").cast("string")),
    )
    derived = F.filter(each, lambda x: x.isNotNull())
    wanted = _alone() & F.col("later") & (F.size("voltages_pn") > 0) & (F.size("voltage_pp") == 0) & ~_name().rlike(NO_VOLTAGE_KINDS)
    return state.withColumn("voltage_pp", F.when(wanted & (F.size(derived) > 0), derived).otherwise(F.col("voltage_pp")))


def correct_nominal(state: DataFrame) -> DataFrame:
    """Later-section steps measured on a wrong base: three equal values become the nominal; if two agree on a base well below it,
    all three are scaled."""
    v = [voltage_value(F.get("voltages_pn", i)) for i in range(3)]
    nom = F.col("nominal")
    all_known = v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull()
    wanted = _alone() & F.col("later") & (nom != 0) & (F.size("voltages_pn") >= 3) & ~_name().rlike(NO_VOLTAGE_KINDS) & all_known
    equal = (F.abs(v[1] - v[0]) < 2.0) & (F.abs(v[2] - v[0]) < 2.0)
    reset = wanted & equal & (F.abs(v[0] - nom) >= 5.0) & (v[0] > 0)
    r = [F.bround(x) for x in v]
    base = F.when((r[0] == r[1]) | (r[0] == r[2]), r[0]).when(r[1] == r[2], r[1])
    scale = F.when(base != 0, nom / base)
    rescale = wanted & ~equal & (F.abs(base - nom) > 5.0) & (scale > 1.2)
    scaled = [F.bround(x * scale, 1) for x in v]
    volts = lambda x: (x * P.SQRT3).cast("int")
    return state.withColumns(
        {
            "voltages_pn": F.when(reset, phases(PN, plain_number(nom))).when(rescale, phases(PN, *[plain_number(s) for s in scaled])).otherwise(F.col("voltages_pn")),
            "voltage_pp": F.when(reset, phases(PP, volts(nom))).when(rescale, phases(PP, *[volts(s) for s in scaled])).otherwise(F.col("voltage_pp")),
        }
    )


def phase_angle_entry(state: DataFrame) -> DataFrame:
    """A fourth entry tells to change or recover the phase angle."""
    n = _name()
    entry = F.when(_has("recovery", n), "(recover phase angle)").otherwise("(change phase angle)")
    alone = _alone() if "pair" in state.columns else F.lit(True)
    wanted = alone & _has("phase reverse", n) & (F.size("voltages_pn") == 3)
    return state.withColumn("voltages_pn", F.when(wanted, F.array_append("voltages_pn", entry)).otherwise(F.col("voltages_pn")))


def dedupe_healthy(steps: DataFrame, keys: Sequence[str] = KEYS, width: int | None = UNKNOWN) -> DataFrame:
    """From the change of section on only one "healthy condition" stays: the first, or one of those that share its number."""
    k = list(keys)
    n = _name()
    placed = steps.dropna(subset=[*k])
    width = width_for(placed, k, "step_idx") if width == UNKNOWN else width
    later = with_running(placed, k, "step_idx", width=width, _later=running_max(F.col("step_idx").isNotNull() & _has("supply off change", n), peers=True))
    again = F.coalesce(F.col("_later") & F.col("step_idx").isNotNull() & (n == "healthy condition"), F.lit(False))
    counted = with_running(later, k, "step_idx", width=width, _nth=running_sum(F.when(again, 1)))
    return counted.filter(~(again & (F.col("_nth") > 1))).select(*steps.columns)


def link_specs_to_steps(steps: DataFrame, specs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Empty step delays take the variant's spec delay, unless that is a narrative one."""
    d = steps.join(specs.select(*keys, F.col("on_delay").alias("_on"), F.col("off_delay").alias("_off")), list(keys), "left")
    for f, s in (("on_delay", "_on"), ("off_delay", "_off")):
        take = ~filled(F.col(f)) & filled(F.col(s)) & ~is_spurious_delay(F.col(s))
        d = d.withColumn(f, F.when(take, F.col(s)).otherwise(F.col(f)))
    return d.select(*steps.columns)


def enrich_specs(specs: DataFrame, pages: DataFrame, keys: Sequence[str] = ("doc_id",), compat: bool = False) -> DataFrame:
    """Missing reference voltage, on-delay and UV/OV ranges from the block's text.

    Delay and ranges only where a raw reply exists (``has_reply``). Every fact is the block's first one, found page by page, so no block
    text is put together. With ``compat`` every s of a delay is expanded, as in "continuou sec".
    """
    t = F.coalesce("text", F.lit(""))
    ref = first_match(t, r"(?i)REF\.?\s*VOLTAGE\s+(\d{3})\s*VAC")
    found = first_match(t, r"(?i)(\d+\.?\d*\s*(?:to|-)\s*\d+\.?\d*\s*s|\d+\.?\d*\s*s|instant|continuous)")
    delay = F.lower(strip(found))
    if compat:
        delay = F.when(F.endswith(delay, F.lit("s")), F.replace(delay, F.lit("s"), F.lit(" sec"))).otherwise(delay)
    else:
        delay = F.when(delay.isin("instant", "continuous"), delay).otherwise(F.regexp_replace(delay, r"\s*s$", " sec"))
    span = r"(?i)(\d{3})\s*(?:to|-)\s*(\d{3})\s*VAC"
    found_spans = F.regexp_extract_all(t, F.lit(span), F.lit(0))
    ranges = F.filter(
        F.transform(found_spans, lambda m: F.struct(F.regexp_extract(m, span, 1).alias("a"), F.regexp_extract(m, span, 2).alias("b"))), lambda r: (r["a"].cast("int") > 50) | (r["b"].cast("int") > 50)
    )
    two = F.slice(F.transform(ranges, lambda r: F.concat(r["a"], F.lit("-"), r["b"], F.lit(" VAC"))), 1, 2)
    page = F.col("page_num")
    # the text is searched once: what it says is small and read twice, and a filter here would have the patterns tried twice
    told = materialize(pages.select(*keys, "page_num", ref.alias("_ref"), delay.alias("_delay"), two.alias("_r")))
    facts = told.groupBy(*keys).agg(
        _first(F.col("_ref")).alias("_ref"), _first(F.col("_delay")).alias("_delay"),
        # the first two ranges stand on the first page with a range, or on that page and the next one with a range
        F.min(F.when(F.size("_r") >= 1, F.struct(page, F.col("_r")))).alias("_one"),
    )
    rest = told.filter(F.size("_r") >= 1).join(facts.select(*keys, F.col("_one.page_num").alias("_p1")), list(keys))
    after = rest.filter("page_num > _p1").groupBy(*keys).agg(F.min(F.struct(page, F.col("_r"))).alias("_next"))
    facts = facts.join(after, list(keys), "left")
    first_r = F.get("_one._r", 0)
    second_r = F.coalesce(F.get("_one._r", 1), F.get("_next._r", 0))
    d = specs.join(facts, list(keys), "left")
    reply = F.col("has_reply")
    both = reply & ~filled(F.col("uv_range")) & ~filled(F.col("ov_range")) & first_r.isNotNull() & second_r.isNotNull()
    good = F.col("_delay").isNotNull() & ~is_spurious_delay(F.col("_delay"))
    return d.withColumns(
        {
            "ref_voltage": F.when(filled(F.col("ref_voltage")), F.col("ref_voltage")).otherwise(F.coalesce("_ref", "ref_voltage")),
            "on_delay": F.when(~filled(F.col("on_delay")) & reply & good, F.col("_delay")).otherwise(F.col("on_delay")),
            "uv_range": F.when(both, first_r).otherwise(F.col("uv_range")),
            "ov_range": F.when(both, second_r).otherwise(F.col("ov_range")),
        }
    ).select(*specs.columns)


def renumbered(steps: DataFrame, keys: Sequence[str] = KEYS, width: int | None = UNKNOWN) -> DataFrame:
    return renumber(steps, list(keys), "step_idx", "step_idx", width)

