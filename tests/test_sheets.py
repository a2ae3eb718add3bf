"""Cells of a sheet are made and compared where its steps were placed."""

from pageledger.operators import compare as C, layout as L
from pageledger.plans.queries_layout import as_sheet, with_perturbed
from test_rules import STEP, step

SPECS = "variant string, ref_voltage string, uv_threshold_pct string, ov_threshold_pct string, uv_range string, ov_range string, lv_cutoff string, hv_cutoff string, dip_switches array<string>"


def tables(spark):
    bare = (None,) * 7
    specs = spark.createDataFrame([("v", *bare, ["1 : ON"]), ("v", *bare, []), ("w", *bare, []), ("x", "240", *bare[1:], [])], SPECS)
    return specs, spark.createDataFrame([step(i, f"healthy {i}", ["RN : 1", "YN : 2"]) for i in range(1, 30)], STEP)


def assert_dealt_below_cells(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Generate explode")]


def test_cells_are_not_dealt_out(spark):
    specs, steps = tables(spark)
    assert_dealt_below_cells(L.sheet_cells(specs, steps))


def test_headers_and_notices(spark):
    specs, steps = tables(spark)
    cells = {(r.variant, r.row_no, r.col_no): r.value for r in L.sheet_cells(specs, steps).collect()}
    header = {(v, *at): t for v in "vw" for at, t in [((3, 6), "DIP S/W setting"), ((9, 8), "PH-N")]}
    assert header.items() <= cells.items() and ("x", 9, 8) not in cells
    assert cells["v", 3, 7] == "1 : ON" and cells["w", 10, 6] == L.NO_DATA and L.NO_DATA not in {t for (v, _, _), t in cells.items() if v != "w"}
    # two specs: each step is written twice, one below the other
    assert sorted(t for (v, _, c), t in cells.items() if v == "v" and c == 6 and t.startswith("healthy")) == sorted(f"healthy {i}" for i in range(1, 30) for _ in "AB")


def test_sheets_are_compared_where_they_are_made(spark):
    specs, steps = tables(spark)
    assert_dealt_below_cells(C.accuracy_of(with_perturbed(as_sheet(L.sheet_cells(specs, steps)))))


def test_what_stands_twice_is_compared_with_each_of_the_other_side(spark):
    kind = "sheet string, row_no int, col_no int, value string"
    ref = spark.createDataFrame([("s", 1, 1, "a"), ("s", 1, 1, "b"), ("s", 2, 1, " "), ("s", None, 1, "n"), ("r", 1, 1, "x"), ("e", 1, 1, None)], kind)
    gen = spark.createDataFrame([("s", 1, 1, " a "), ("s", 1, 1, "a"), ("s", 1, 2, "c"), ("s", None, 1, "n"), ("g", 1, 1, "y"), ("e", 1, 1, "z")], kind)
    want = {"s": (2, 2, 1, 2, 5, 40.0, "FAIL"), "r": (None,) * 6 + ("ERROR: not in generated",), "g": (None,) * 6 + ("ERROR: not in reference",), "e": (0, 0, 0, 1, 0, 0.0, "FAIL")}
    assert {r.sheet: tuple(r)[1:] for r in C.accuracy(ref, gen).collect()} == want
