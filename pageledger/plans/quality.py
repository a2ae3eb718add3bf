"""From extracted specs and steps to flags, repaired specs and the machine roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pageledger.operators import quality as Q


@dataclass
class QualityReport:
    specs: DataFrame
    steps: DataFrame
    spec_flags: DataFrame
    variants: DataFrame
    machines: DataFrame


def flag_steps(steps: DataFrame, specs: DataFrame) -> DataFrame:
    """Cleaned steps with all their flags in the array ``step_flags``: one join, one pass.

    Specs of one variant count together, so no step is there twice: what one of them expects (five labels at most) should be shown.
    """
    labels = Q.expected_led_labels(F.col("led_indications"))
    expected = specs.groupBy("variant").agg(F.array_distinct(F.flatten(F.collect_set(labels))).alias("expected"))
    before = F.concat(Q.voltage_rule_set(), Q.led_rule_set(), Q.step_delay_rule_set())
    cleaned = Q.clean_voltages(steps.join(expected, "variant").withColumn("_before", before))
    return cleaned.withColumn("step_flags", F.concat("_before", Q.step_rule_set())).drop("_before", "expected")


def spec_flags(specs: DataFrame, steps: DataFrame) -> DataFrame:
    row_rules = [Q.unit_rule_set(), Q.range_rule_set(), Q.percent_rule_set(), Q.order_rule_set(), Q.delay_rule_set()]
    rows = Q.emit(specs, Q.SPEC_KEYS, "spec", *row_rules)
    return rows.unionByName(Q.no_steps(specs, steps)).unionByName(Q.peer_consistency(specs))


def quality_report(specs: DataFrame, steps: DataFrame) -> QualityReport:
    flagged = flag_steps(steps, specs)
    flags = spec_flags(specs, steps)
    # R4 and R5 are row rules, so the repair needs no join: the clash is seen in the row itself
    raised = F.transform(Q.order_rule_set(), lambda f: f["rule_id"])
    clear = {f: F.when(~F.array_contains(raised, "R4"), F.col(f)) for f in ("uv_range", "ov_range")}
    clear["hv_cutoff"] = F.when(~F.array_contains(raised, "R5"), F.col("hv_cutoff"))
    repaired = specs.withColumns(clear)
    kept = Q.flags_after_sanitize(flags)
    counted = flagged.withColumn("flagged", F.size("step_flags") > 0)
    variants = Q.variant_summary(repaired, counted, kept)
    return QualityReport(repaired, flagged, kept, variants, Q.machine_summary(variants))
