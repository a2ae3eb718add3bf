"""Texts are searched and lengths looked at once."""

from pyspark.sql import functions as F

from pageledger.operators import ordered, steps as S
from pageledger.plans import procedure as PR
from test_rules import STEP, step


def test_layout_a_looks_at_lengths_once(spark, monkeypatch):
    looked, whole = [], ordered.width_for
    for module in (ordered, S, PR):
        monkeypatch.setattr(module, "width_for", lambda *a, **k: looked.append(a) or whole(*a, **k), raising=False)
    pages = spark.createDataFrame([("v", 1, "symmetrically reduce the voltage to 300 V")], "variant string, page_num int, text string")
    df = spark.createDataFrame([step(1, "healthy condition"), step(2, "UV symmetrical Healthy condition")], STEP)
    assert PR.layout_a(df, pages, names=F.lit("v")).count() == 3 and len(looked) == 1


def test_texts_are_searched_once_for_specs(spark):
    texts = [(1, 1, "x 150 to 170 VAC"), (1, 2, "REF. VOLTAGE 240 VAC"), (1, 3, "260 - 280 VAC, 010 to 020 VAC, 5s"), (2, 1, "100 to 110 VAC 120-130 vac"), (3, 1, None)]
    pages = spark.createDataFrame(texts, "doc_id int, page_num int, text string")
    specs = spark.createDataFrame([(i, None, None, None, None, True) for i in (1, 2, 3)], "doc_id int, ref_voltage string, on_delay string, uv_range string, ov_range string, has_reply boolean")
    got = S.enrich_specs(specs, pages)
    assert {r.doc_id: tuple(r)[1:5] for r in got.collect()} == {1: ("240", "5 sec", "150-170 VAC", "260-280 VAC"), 2: (None, None, "100-110 VAC", "120-130 VAC"), 3: (None,) * 4}
    assert "VOLTAGE" not in got._jdf.queryExecution().optimizedPlan().toString()
