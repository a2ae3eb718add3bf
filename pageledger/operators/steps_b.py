"""Ordered test steps of layout B (one LED, cut-off machines). Tables as in ``steps``; ``step_idx`` need not be dense."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import filled, strip
from pageledger.functions.values import PN, PP, is_spurious_delay, phases
from pageledger.operators.ordered import renumber, running_sum, with_running
from pageledger.operators.steps import KEYS, _first, _last, _none, blank_step

RED_BLINK = "R (RED LED) : BLINKING"
LV_BLOCK = ("Lower Cut OFF healthy", "Lower Cut OFF", "Lower Cut OFF not recovery", "Lower Cut OFF recovery")


def layout_b_context(pages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Base voltage (first page), LV range with hysteresis (last page that has both, else the first range), HV range and asymmetry
    percentages (last page), and whether the text asks to repeat the procedure."""
    t = F.coalesce("text", F.lit(""))

    def ints(pattern: str, n: int) -> Column:
        return F.when(t.rlike(pattern), F.array(*[F.regexp_extract(t, pattern, i + 1).cast("int") for i in range(n)]))

    facts = pages.groupBy(*keys).agg(
        _first(ints(r"(?i)(?:Set voltage|at)\s+(\d+)\s*V\s*Ph-N", 1)).alias("b"), _last(ints(P.LOW_CUTOFF_BOTH, 4)).alias("lv4"), _first(ints(P.LOW_CUTOFF, 2)).alias("lv2"),
        _last(ints(P.HIGH_CUTOFF, 2)).alias("hv"),
        _last(ints(P.ASYMMETRY, 4)).alias("as"),
        F.bool_or(t.rlike(r"(?i)repeat\s+procedure")).alias("has_repeat"),
    )
    lo = lambda c, i, j: F.least(F.get(c, i), F.get(c, j))
    hi = lambda c, i, j: F.greatest(F.get(c, i), F.get(c, j))
    return facts.select(
        *keys, F.get("b", 0).alias("base"), F.coalesce(lo("lv4", 0, 1), lo("lv2", 0, 1)).alias("lv_lo"), F.coalesce(hi("lv4", 0, 1), hi("lv2", 0, 1)).alias("lv_hi"),
        lo("lv4", 2, 3).alias("hyst_lo"), hi("lv4", 2, 3).alias("hyst_hi"), lo("hv", 0, 1).alias("hv_lo"), hi("hv", 0, 1).alias("hv_hi"),
        *[F.get("as", i).alias(n) for i, n in enumerate(("trip_lo_pct", "trip_hi_pct", "reset_lo_pct", "reset_hi_pct"))], "has_repeat",
    )


def _whole(c: Column) -> Column:
    return c.cast("int")


def line_voltage(base: Column, bn: Column) -> Column:
    """Y-B voltage of a star with R-N = Y-N = ``base`` and B-N = ``bn``: the length of the difference of two phasors 240° apart, cut to a whole number.

    Complex arithmetic can land just below an exact whole root ((120, 13) and (240, 26) among the usual bases); the closed form does not.
    """
    b, x = base.cast("double"), bn.cast("double")
    return _whole(F.sqrt(b * b + x * x + b * x))


def phase_for_line(base: Column, target: Column) -> Column:
    """The smallest B-N voltage in 1..base with the given Y-B voltage, or NULL. A voltage bounds the search."""
    return F.get(F.filter(F.sequence(F.lit(1), base), lambda x: line_voltage(base, x) == target), 0)


def layout_b_delays(steps: DataFrame, seconds: int = P.SPURIOUS_SECONDS) -> DataFrame:
    """Drop narrative delays; an off-column text found in ``on_delay`` moves to an empty ``off_delay``."""
    on, off = F.col("on_delay"), F.col("off_delay")
    on = F.when(~is_spurious_delay(on, seconds), on)
    off = F.when(~is_spurious_delay(off, seconds), off)
    misplaced = filled(on) & F.coalesce(strip(on).rlike(r"(?i)<=|<\s*=|msec|less\s+than|^\s*-\s*$"), F.lit(False))
    moves = misplaced & (~filled(off) | strip(off).isin("", "-", "null"))
    new_off = F.when(moves, strip(on)).otherwise(off)
    return steps.withColumns(
        {"on_delay": F.when(~moves, on), "off_delay": F.when(~is_spurious_delay(new_off, seconds), new_off)}
    )


def layout_b_voltages(steps: DataFrame, ctx: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Step kind to voltages, LEDs and relay from the page context; label steps are blanked, settings always go."""
    d = steps.join(ctx, list(keys), "left")
    raw = F.lower(strip(F.coalesce("step_name", F.lit(""))))
    n = strip(F.regexp_replace(raw, r"\s*\(repeat block\)\s*$", ""))
    has = lambda t: F.contains(n, F.lit(t))
    label = has("couple all voltages") | F.startswith(n, F.lit("repeated tests"))
    base, lo, hi, hvl, hvh = (F.col(c) for c in ("base", "lv_lo", "lv_hi", "hv_lo", "hv_hi"))
    r3 = P.SQRT3
    near = lambda c: F.bround(c / r3).cast("int")
    cut = lambda c: _whole(c / r3)
    pp = _whole(base * r3)
    recovery = has("recovery")
    reverse_recovery = n.rlike(r"phase\s+reverse\s+recovery")
    reverse = n.rlike(r"phase\s+reverse") & ~reverse_recovery
    recover, change = F.array(F.lit("(recover phase angle)")), F.array(F.lit("(change phase angle)"))
    three = F.size("voltages_pn") == 3
    angle = F.when(three & reverse, F.concat("voltages_pn", change)).when(three & reverse_recovery, F.concat("voltages_pn", recover)).otherwise(F.col("voltages_pn"))

    # kinds that follow from the base voltage
    known = base.isNotNull() & (base != 0)
    healthy = known & (n == "healthy condition")
    fail = known & has("phase fail") & ~recovery
    turned = known & has("phase reverse") & ~recovery & ~healthy & ~fail & ~reverse_recovery
    restored = known & reverse_recovery & ~healthy
    pn = (
        F.when(healthy, phases(PN, base)).when(restored, F.concat(phases(PN, base), recover)).when(fail, phases(PN, base, base, F.lit(0)))
        .when(turned, F.concat(phases(PN, base), change))
    )
    vv = F.when(healthy | restored | turned, phases(PP, pp)).when(fail, phases(PP, pp, base, base))
    # low and high cut-off
    rec = hi + F.floor((F.col("hyst_lo") + F.col("hyst_hi")) / 2).cast("int")
    lv_kind = (
        F.when(has("lower cut off healthy"), F.struct(near(hi).alias("pn"), hi.alias("pp"))).when(n == "lower cut off", F.struct(near(lo).alias("pn"), lo.alias("pp")))
        .when(has("lower cut off not recovery"), F.struct(near(hi).alias("pn"), hi.alias("pp")))
        .when(has("lower cut off recovery") & rec.isNotNull(), F.struct(near(rec).alias("pn"), rec.alias("pp")))
    )
    hv_kind = F.when(has("higher cut off healthy"), F.struct(cut(hvl).alias("pn"), hvl.alias("pp"))).when(
        n == "higher cut off", F.struct(cut(hvh).alias("pn"), hvh.alias("pp"))
    )
    step_v = F.coalesce(F.when(hvl.isNotNull(), hv_kind), F.when(lo.isNotNull(), lv_kind))
    # asymmetry
    tl, th, rh = (F.col(c) for c in ("trip_lo_pct", "trip_hi_pct", "reset_hi_pct"))
    target = F.bround((lo + _whole(lo * rh / 100)) * r3).cast("int")
    bn = (
        F.when(has("healthy"), _whole(cut(hi) * (100 - tl) / 100)).when(has("faulty"), _whole(cut(lo) * th / 100))
        .when(has("not recovery"), (F.floor(base * th / 100) - 1).cast("int")).when(recovery & ~has("not"), phase_for_line(base, target))
    )
    bn = F.when(known & lo.isNotNull() & has("asymmetry") & tl.isNotNull(), bn)
    yb = line_voltage(base, bn)
    pn_all = F.when(bn.isNotNull(), phases(PN, base, base, bn)).when(step_v.isNotNull(), phases(PN, step_v["pn"])).otherwise(F.coalesce(pn, angle))
    pp_all = F.when(bn.isNotNull(), phases(PP, pp, yb, yb)).when(step_v.isNotNull(), phases(PP, step_v["pp"])).otherwise(F.coalesce(vv, "voltage_pp"))
    led = F.transform(
        F.when(turned, F.array(F.lit(RED_BLINK))).otherwise(F.col("leds")),
        lambda x: F.when(F.contains(F.upper(x), F.lit("BLINK")), RED_BLINK).otherwise(F.regexp_replace(x, r"R\s*\(\s*RED", "R (RED")),
    )
    off = F.col("off_delay")
    off = F.when(~filled(off) & healthy, "-").when(~filled(off) & turned, "Instant OFF").otherwise(off)
    keep = lambda c: F.when(~label, c)
    arr = lambda c: F.when(label, _none()).otherwise(c)
    return d.withColumns(
        {
            "step_name": F.when(n != raw, n).otherwise(F.col("step_name")), "settings": _none(), "voltages_pn": arr(pn_all), "voltage_pp": arr(pp_all),
            "leds": arr(led), "relay_status": keep(F.when(turned, "Instant OFF").otherwise(F.col("relay_status"))),
            "on_delay": keep(F.col("on_delay")), "off_delay": keep(off), "section_break": label | F.col("section_break"),
        }
    ).select(*steps.columns)


def layout_b_postprocess(steps: DataFrame, ctx: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return layout_b_delays(layout_b_voltages(layout_b_delays(steps), ctx, keys))


def layout_b_required(steps: DataFrame, ctx: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Insert the couple label, the repeated-tests label and, where the text asks for it, a second low cut-off block.

    Everything inserted is decided from one aggregate per variant; new rows get ordinals between their neighbours.
    """
    k = list(keys)
    n = F.lower(F.coalesce("step_name", F.lit("")))
    idx = F.col("step_idx")
    has = lambda t: F.contains(n, F.lit(t))
    healthy = has("lower cut off healthy")
    counted = with_running(steps, k, "step_idx", _before=running_sum(healthy.cast("int"), inclusive=False))
    fields = [c for c in steps.columns if c not in (*k, "step_idx")]
    body = F.struct(*fields)
    template = lambda name: F.min_by(body, F.when(n == name.lower(), idx))
    facts = counted.groupBy(*k).agg(
        F.bool_or(has("couple all")).alias("_couple"), F.min(F.when(has("asymmetry recovery"), idx)).alias("_asym_rec"), F.min(F.when(healthy, idx)).alias("_lv1"),
        F.min(F.when(healthy & (F.col("_before") == 1), idx)).alias("_lv2"), F.bool_or(has("asymmetry")).alias("_asym"),
        F.bool_or(F.startswith(n, F.lit("repeated tests"))).alias("_rep"), F.min(F.when(has("lower cut off recovery"), idx)).alias("_rec"),
        *[template(x).alias(f"_t{i}") for i, x in enumerate(LV_BLOCK)],
    ).join(ctx.select(*k, "trip_lo_pct", "has_repeat"), k, "left")

    def blank(name: str, broken: bool) -> Column:
        values = blank_step(steps, F.lit(name), F.lit(0), broken)
        return F.struct(*[values[c].alias(c) for c in fields])

    at = lambda ordinal, step: F.when(ordinal.isNotNull(), F.struct(ordinal.cast("double").alias("at"), step.alias("s")))
    couple = F.when(~F.col("_couple"), F.coalesce(F.col("_asym_rec") + 0.5, F.col("_lv1") - 0.5))
    repeated = F.when((F.col("trip_lo_pct").isNotNull() | F.col("_asym")) & ~F.col("_rep"), F.col("_lv2") - 0.25)
    again = F.when(F.coalesce("has_repeat", F.lit(False)) & F.col("_lv2").isNull(), F.col("_rec"))
    inserts = [at(couple, blank("Couple all Voltages", True)), at(repeated, blank("Repeated Tests -", True))]
    inserts += [at(again + 0.1 * (i + 1), F.coalesce(F.col(f"_t{i}"), blank(x, False))) for i, x in enumerate(LV_BLOCK)]
    added = facts.select(*k, F.explode(F.filter(F.array(*inserts), lambda x: x.isNotNull())).alias("x")).select(*k, F.col("x.at").alias("step_idx"), "x.s.*")
    joined = steps.withColumn("step_idx", idx.cast("double")).unionByName(added.select(*steps.columns))
    return renumber(joined, k, "step_idx", "step_idx")


def layout_b_finalize(steps: DataFrame, ctx: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Without an asymmetry row in the pages, asymmetry and repeated-tests steps go."""
    d = steps.join(ctx.select(*keys, F.col("trip_lo_pct").isNotNull().alias("_asym")), list(keys), "left")
    n = F.lower(strip(F.coalesce("step_name", F.lit(""))))
    extra = F.contains(n, F.lit("asymmetry")) | F.startswith(n, F.lit("repeated tests"))
    return d.filter(F.coalesce("_asym", F.lit(False)) | ~extra).select(*steps.columns)
