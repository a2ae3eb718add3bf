"""Steps that share a number: what the SQL leaves no choice about."""

from pyspark.sql import functions as F

from pageledger.operators import steps as S
from pageledger.operators.ordered import running_max, with_running
from test_rules import STEP, context, step


def test_steps_of_one_number_enter_the_later_section_together(spark):
    pn = ["RN : 100", "YN : 100", "BN : 100"]
    df = spark.createDataFrame([step(1, "a", pn), step(2, "x", pn), step(2, "Supply OFF change", pn), step(2, "y", pn), step(3, "b", pn)], STEP).repartition(1)
    state = S.derive_phase_phase(S.section_state(df, context(spark)))
    assert {r.step_name: (r.later, len(r.voltage_pp)) for r in state.collect()} == {"a": (False, 0), "x": (True, 3), "Supply OFF change": (True, 0), "y": (True, 3), "b": (True, 3)}


def test_peers_are_seen_in_chunks_too(spark):
    df = spark.range(40).select(F.lit("k").alias("k"), (F.col("id") / 4).cast("int").alias("i"), (F.col("id") % 4).alias("v"))
    got = with_running(df, ["k"], "i", 4, m=running_max(F.when(F.col("i") == 3, F.col("v")), peers=True)).collect()
    assert len(got) == 40 and all(r.m == (None if r.i < 3 else 3) for r in got)


def test_one_healthy_step_stays_of_those_that_share_its_number(spark):
    rows = [step(1, "healthy condition"), step(2, "Supply OFF change"), step(2, "healthy condition"), step(2, "healthy condition"), step(3, "healthy condition"), step(3, "b")]
    df = spark.createDataFrame([*rows, step(4, "healthy condition")], STEP)
    got = sorted((r.step_idx, r.step_name) for r in S.dedupe_healthy(df).collect())
    assert got == [(1, "healthy condition"), (2, "Supply OFF change"), (2, "healthy condition"), (3, "b")]
