"""The composed layouts: what one rule changes, the next one sees."""

import pytest
from pyspark.sql import functions as F

from pageledger.plans import procedure as PR

STEPS = (
    "variant string, step_idx int, step_name string, settings array<string>, voltages_pn array<string>, voltage_pp array<string>, leds array<string>, relay_status string, on_delay string, "
    "off_delay string, section_break boolean"
)


def step(idx, name, pn=(), settings=(), pp=(), leds=(), on=None, off=None):
    return ("V1", idx, name, list(settings), list(pn), list(pp), list(leds), None, on, off, False)


def three(v):
    return [f"{x} : {v}" for x in ("RN", "YN", "BN")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([("V1", 1, "symmetrically reduce the voltage to 300 V")], "variant string, page_num int, text string")


def test_layout_a(spark, pages):
    steps = [
        step(1, "healthy condition", three(240)), step(2, "Under Voltage test"), step(3, "UV symmetrical Healthy condition", three(200), ["UV = 8 %"]), step(4, "supply off change"),
        step(5, "Supply couple at 415 VAC"), step(6, "healthy condition", three(110)), step(7, "supply off"), step(8, "healthy condition", three(110)), step(9, "OV hysteresis recovery (sym)", three("230.46")),
    ]
    rows = PR.layout_a(spark.createDataFrame(steps, STEPS), pages, names=F.lit("V1")).orderBy("step_idx").collect()
    # the label and the repeats are gone, the marker was not needed as one is there, numbers are dense
    assert [(r.step_idx, r.step_name) for r in rows] == [
        (1, "healthy condition"), (2, "UV symmmetrical Healthy condition"), (3, "supply off change"), (4, "Supply couple at 415 VAC"), (5, "healthy condition"), (6, "OV hystersis recovery"),
    ]
    # the later section is corrected to the nominal of the couple step, and phase-phase voltages follow from what was corrected
    assert rows[4].voltages_pn == three("239.6") and rows[4].voltage_pp[0].startswith("RY : 41")
    assert rows[5].voltages_pn == three("239.6")


def test_layout_a_marker(spark, pages):
    steps = [step(1, "healthy condition", three(240)), step(2, "UV symmetrical Healthy condition", three(200))]
    rows = PR.layout_a(spark.createDataFrame(steps, STEPS), pages, names=F.lit("V1")).orderBy("step_idx").collect()
    assert [(r.step_name, r.section_break) for r in rows] == [("healthy condition", False), ("Supply couple at 300 VAC", True), ("UV symmmetrical Healthy condition", False)]


def test_layout_b_is_dense_and_has_its_label(spark, pages):
    steps = [step(1, "healthy condition", three(240)), step(2, "Lower Cut Off Healthy", three(180), on="62 sec"), step(3, "Lower Cut Off Recovery", three(190))]
    rows = PR.layout_b(spark.createDataFrame(steps, STEPS), pages).orderBy("step_idx").collect()
    assert [r.step_idx for r in rows] == list(range(1, len(rows) + 1)) and "Couple all Voltages" in {r.step_name for r in rows}
    assert all(r.on_delay != "62 sec" for r in rows)
