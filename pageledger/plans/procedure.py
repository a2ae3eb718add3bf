"""The step rules composed in the order in which they depend on one another.

Layout A: the couple marker comes first, as its name is one that section labels must not swallow; canonical names come before everything that looks at names; the
section state is read once from the canonical steps, and every later rule takes it along. Layout B: delays and voltages are treated before the required steps are
inserted and again after, so that inserted steps get theirs too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pageledger.operators import replies as J, steps as A, steps_b as B
from pageledger.operators.ordered import UNKNOWN, width_for
from pageledger.session import materialize

STATE = ("later", "pair", "nominal", "ov_seen")


def layout_a(steps: DataFrame, pages: DataFrame, keys: Sequence[str] = A.KEYS, names: Column | None = None) -> DataFrame:
    """Raw steps of layout A to the house form, numbered anew."""
    context = materialize(A.layout_a_context(pages, keys, names))
    # a variant gets one marker and loses steps: where none is long now, none will be, and nobody needs to look again
    width = UNKNOWN if width_for(steps, list(keys), "step_idx") else None
    named = A.canonical_leds(A.canonical_step_names(A.drop_section_labels(A.insert_couple_marker(steps, pages, keys, width))))
    named = A.renumbered(named, keys, width)  # the section state asks for neighbours
    state = A.drop_repeat_supply_off(A.section_state(named, context, keys, width))
    state = A.runtime_dip_pair(state, context, keys)
    state = A.symmetric_ov(A.section_b_settings(state, context, keys), context, keys)
    state = A.correct_nominal(A.derive_phase_phase(A.settings_spacing(state)))
    voiced = A.phase_angle_entry(state)
    once = A.dedupe_healthy(voiced if width is None else materialize(voiced), keys, width)
    return A.renumbered(J.normalize_step(_as_sent(once.drop(*STATE))), keys, width)


def _as_sent(steps: DataFrame) -> DataFrame:
    """Phase-phase voltages as JSON text, as a reply has them."""
    return steps.withColumn("voltage_pp", F.to_json("voltage_pp"))


def layout_b(steps: DataFrame, pages: DataFrame, keys: Sequence[str] = A.KEYS) -> DataFrame:
    """Raw steps of layout B with voltages, LEDs and required steps, numbered anew."""
    context = materialize(B.layout_b_context(pages, keys))
    first = B.layout_b_postprocess(A.renumbered(A.drop_section_labels(steps), keys), context, keys)
    whole = B.layout_b_postprocess(B.layout_b_required(materialize(first), context, keys), context, keys)
    return A.renumbered(B.layout_b_finalize(whole, context, keys), keys)
