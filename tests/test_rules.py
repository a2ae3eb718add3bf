"""Golden rows for rules that are easy to get wrong."""


import pytest
from pyspark.sql import functions as F

from pageledger.functions.text import split_lines, wide_gaps
from pageledger.functions.values import parse_range
from pageledger.operators import compare as C, families as FA, grid as G, layout as L, quality as Q, replies as J, steps as S, steps_b as B, text as T
from pageledger.plans.quality import quality_report


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("r")).first().r


@pytest.mark.parametrize("text, want", [("240 ± 5", (5.0, 240.0)), ("160V to 180V", (160.0, 180.0)), ("7", (7.0, 7.0)), ("none", None), ("200-100 VAC", (100.0, 200.0))])
def test_ranges(spark, text, want):
    got = one(spark, parse_range(F.col("t")), t=text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "headers, want",
    [(["MG100A", "MG101A/2A"], ["MG100A", "MG101A", "MG102A"]), (["A100/121"], ["A100", "A121"]), (["MG100/1/2", "MG777"], ["MG100", "MG101", "MG102", "MG777"]), (["/", "AB1"], ["AB1"])],
)
def test_packed_headers(spark, headers, want):
    assert one(spark, FA.expand_headers(F.col("h")), h=headers) == want


def test_title_list_is_three_valued(spark):
    tables = spark.createDataFrame([(f, 0, "t", "spec", ["AB1", "AB2"]) for f in "uen"], "family string, table_idx int, title string, kind string, columns array<string>")
    families = spark.createDataFrame([("u", None, True), ("e", [], True), ("n", ["ZZ1"], False)], "family string, title_submachines array<string>, external boolean")
    outcome, flags = FA.prefix_vote(tables, families)
    assert dict(map(tuple, outcome.collect())) == {"u": "could_not_run", "e": "ran", "n": "na"}
    assert [r.family for r in flags.collect()] == ["u"]


def test_lv_clash_alone_keeps_the_ranges(spark):
    specs = spark.createDataFrame([("m", "v", "100 to 110", "120 to 130", "200", "150")], "machine string, variant string, uv_range string, ov_range string, lv_cutoff string, hv_cutoff string")
    flags = Q.order_rules(specs)
    assert [r.rule_id for r in flags.collect()] == ["R5"]
    assert tuple(Q.sanitize_specs(specs, flags).first()) == ("m", "v", "100 to 110", "120 to 130", "200", None)
    assert tuple(Q.sanitize_specs(specs, flags, compat=True).first()) == ("m", "v", None, None, "200", "150")


def test_a_clash_clears_its_own_row_only(spark):
    rows = [("m", "v", "100 to 110", "105 to 130", "200", "250"), ("m", "v", "100 to 110", "120 to 130", "200", "150"), ("m", "v", "90 to 95", "120 to 130", "200", "250")]
    specs = spark.createDataFrame(rows, "machine string, variant string, uv_range string, ov_range string, lv_cutoff string, hv_cutoff string")
    flags = Q.order_rules(specs)
    got = lambda compat: sorted((tuple(r)[2:] for r in Q.sanitize_specs(specs, flags, compat=compat).collect()), key=str)
    whole = ("90 to 95", "120 to 130", "200", "250")
    assert got(False) == sorted([(None, None, "200", "250"), ("100 to 110", "120 to 130", "200", None), whole], key=str)
    assert got(True) == sorted([(None, None, "200", "250"), (None, None, "200", "150"), whole], key=str)
    assert Q.sanitize_specs(specs, flags.limit(0)).exceptAll(specs).count() == 0


def test_specs_that_share_a_variant_do_not_multiply_its_steps(spark):
    cols = ("voltage_unit", "ref_voltage", "uv_threshold_pct", "ov_threshold_pct", "uv_range", "ov_range", "asymmetry", "lv_cutoff", "hv_cutoff", "on_delay", "off_delay")
    blank = ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in cols)
    specs = spark.sql(f"SELECT 'm' AS machine, variant, {blank}, map(led, 'on') AS led_indications FROM VALUES ('v', 'UV'), ('v', 'OV'), ('w', 'UV'), ('w', 'OV') t(variant, led)")
    steps = spark.sql(
        """SELECT 'v' AS variant, step_idx, 'x' AS step_name, array('UV = 1%') AS settings, array(v, 'YN : 1', 'BN : 1') AS voltages_pn, CAST(array() AS ARRAY<STRING>) AS voltage_pp, array(led) AS leds, 'ON' AS relay_status,
 '1 s' AS on_delay, '1 s' AS off_delay, false AS section_break FROM VALUES (1, 'RN : 1', 'UV : ON'), (2, 'none', 'UV : ON'), (2, 'none', 'UV : ON') t(step_idx, v, led)"""
    )
    report = quality_report(specs, steps)
    assert report.steps.count() == 3
    counted = Q.step_counts(report.steps.withColumn("flagged", F.size("step_flags") > 0)).first()
    assert (counted.n_steps, counted.n_voltage_steps, counted.flagged_steps) == (3, 3, 2)
    flags = {r.variant: (r.n, r.spec_flags) for r in report.variants.groupBy("variant").agg(F.count("*").alias("n"), F.max("spec_flags").alias("spec_flags")).collect()}
    raised = report.spec_flags.groupBy("variant").agg(F.count_if(F.col("rule_id") != "NO_STEPS").alias("n")).collect()
    others = {r.variant: r.n for r in raised}
    assert flags == {"v": (2, others.get("v", 0)), "w": (2, others.get("w", 0) + 1)}


def test_a_page_used_twice_is_listed_twice(spark):
    v = spark.createDataFrame([("v",), ("w",)], "variant string")
    pages = spark.createDataFrame([("v", 1, 2), ("v", 2, 1), ("v", 3, 1)], "variant string, rank int, page_num int")
    got = {r.variant: (r.spec_pages, r.proc_pages, r.raw_step_count) for r in Q.audit(v, pages, pages.limit(0), v, pages, ["variant"]).collect()}
    assert got == {"v": ([1, 1, 2], [], 3), "w": ([], [], 0)}


def test_steps_that_share_the_first_number_are_all_first(spark):
    rows = [("v", i, n, d) for i, n, d in ((1, "DIP S/W setting", 1), (1, "DIP S/W setting", 2), (2, "DIP S/W setting", 3), (2, "healthy", 4), (2, "healthy", 5), (3, "healthy", 6))]
    steps = spark.createDataFrame(rows, "variant string, step_idx int, step_name string, d int").selectExpr(
        "*", "array() AS settings", "array('RN : 1') AS voltages_pn", "array('RY : 1') AS voltage_pp", "array('UV : ON') AS leds", "'ON' AS relay_status", "false AS section_break"
    )
    kinds = L.step_advance(steps, spark.createDataFrame([("v", "A"), ("v", "B")], "variant string, layout string")).select("layout", "d", "kind", "advance").collect()
    assert [r.kind for r in sorted(kinds) if r.layout == "A"] == ["header_dip", "header_dip", "dip", "step", "step", "step"]
    # with layout B the first step takes three rows more, the others two
    assert [r.advance for r in sorted(kinds) if r.layout == "B" and r.kind == "step"] == [6, 6, 5]


def test_specs_that_share_a_variant_write_a_header_once(spark):
    text = ("uv_threshold_pct", "ov_threshold_pct", "uv_range", "ov_range", "lv_cutoff", "hv_cutoff")
    one = "variant string, ref_voltage string, dip_switches array<string>"
    specs = spark.createDataFrame([("v", "240", ["1 : ON"]), ("v", None, []), ("v", None, ["2: OFF", "3: ON"])], one).withColumns({c: F.lit("5") for c in text})
    steps = spark.createDataFrame([], "variant string, leds array<string>")
    cells = L.header_cells(specs, L.detect_layout(specs, steps), steps).select("c.*").collect()
    assert len(cells) == len({(c.row, c.col) for c in cells}) == len(L.HEADER["A"]) + 3
    assert [c.value for c in cells if c.col == 7 and c.row in (3, 4)] == ["2: OFF", "3: ON"] and cells[-1].value == L.NO_DATA


@pytest.mark.parametrize("base, yb, bn", [(240, 415, 240), (240, 239, None), (120, 159, 61)])
def test_line_voltage_and_its_inverse(spark, base, yb, bn):
    assert one(spark, B.phase_for_line(F.col("b"), F.col("y")), b=base, y=yb) == bn
    if bn:
        assert one(spark, B.line_voltage(F.col("b"), F.col("x")), b=base, x=bn) == yb


@pytest.mark.parametrize("v, want", [("RN : 239.96", "RN : 240"), ("RN : 240.25", "RN : 240.2"), ("RY : 415.9", "RY : 415"), ("x", "x"), ("RN : abc", "RN : abc")])
def test_voltage_rounding(spark, v, want):
    assert one(spark, J.round_voltage(F.col("v")), v=v) == want


def test_na_fills_right_before_it_is_dropped(spark):
    rows = [(1, 1, 0, ["P", "MG10A", "MG11B", "MG12C"]), (1, 1, 1, ["UV RANGE", "NA", "", "5 V"]), (1, 1, 2, ["OFF DELAY", "1 s", "", ""])]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, row_idx int, cells array<string>")
    got = {(r.variant, r.param): r.value for r in G.variant_params(df).collect()}
    assert got == {("MG12C", "uv_range"): "5 V", ("MG10A", "off_delay"): "1 s", ("MG11B", "off_delay"): "1 s", ("MG12C", "off_delay"): "1 s"}


def test_dip_states(spark):
    assert one(spark, L.dip_states(F.col("s")), s=["DIP S/W 1-5 : 00101"]) == ["1 : OFF", "2: OFF", "3: ON", "4: OFF", "5: ON"]
    assert one(spark, L.dip_states(F.col("s")), s=["2 : on", "3:OFF", "x", "DIP S/W : 01", "4 : ON"]) == ["2 : ON", "3: OFF", "1 : OFF", "2: ON"]


STEP = "variant string, step_idx int, step_name string, settings array<string>, voltages_pn array<string>, voltage_pp array<string>, leds array<string>, relay_status string, on_delay string, off_delay string, section_break boolean"


def step(i, name, pn=()):
    return ("v", i, name, [], list(pn), [], [], None, None, None, False)


def context(spark, nominal=None):
    cols = "variant string, ov_recovery double, trip_lo double, trip_hi double, sym_hyst_hi double, section_b_dips array<string>, run_time_dips array<string>, ov_pct string, delay string, nominal double"
    return spark.createDataFrame([("v", None, None, None, None, None, None, None, None, nominal)], cols)


def test_run_time_pairs_alternate(spark):
    names = ["Run time DIP a", "Run time DIP b", "DIP S/W Change", "Run time DIP c", "DIP S/W x", "x", "Run time DIP d", "y"]
    df = spark.createDataFrame([step(i, n) for i, n in enumerate(names, 1)], STEP)
    assert [r.pair for r in S.section_state(df, context(spark)).orderBy("step_idx").collect()] == [1, 2, 0, 1, 2, 0, 0, 0]


def test_nominal_voltage_precedence(spark):
    steps = [step(1, "Supply couple at 240 VAC"), step(2, "Supply OFF change"), step(3, "Supply couple at 415 VAC"), step(4, "Supply couple at 100 V"), step(5, "Supply couple", ["RN : 120"])]
    df = spark.createDataFrame(steps, STEP)
    assert [r.nominal for r in S.section_state(df, context(spark)).orderBy("step_idx").collect()] == [None, None, 239.6, 239.6, 120.0]
    assert [r.nominal for r in S.section_state(df, context(spark, 230.0)).orderBy("step_idx").collect()] == [230.0, 230.0, 230.0, 230.0, 120.0]


def test_compare_with_itself_is_perfect(spark):
    cells = spark.createDataFrame([("s", 1, 1, " a "), ("s", 1, 2, None), ("s", 2, 1, "b")], "sheet string, row_no int, col_no int, value string")
    r = C.accuracy(cells, cells).first()
    assert (r.correct, r.wrong, r.missing, r.extra, r.percent, r.status) == (2, 0, 0, 0, 100.0, "PASS")


def test_name_ties_go_to_the_first_seen(spark):
    pages = spark.createDataFrame([(1, 1, "SM20 SM10"), (1, 2, "SM10 SM20"), (2, 1, "alpha beta beta the the the"), (3, 1, "x")], "doc_id int, page_num int, text string")
    assert dict(map(tuple, T.dominant_name(pages).collect())) == {1: "SM20", 2: "BETA", 3: "UNKNOWN"}


def test_scope_runs_over_pages(spark):
    pages = spark.createDataFrame([(1, 1, "x. SCOPE: SM1 / MAG1A"), (1, 2, "SM2_A"), (1, 3, "SM3, SM4"), (1, 4, "SM5")], "doc_id int, page_num int, text string")
    assert [r.member for r in T.scope_members(pages).orderBy("member_no").collect()] == ["SM1", "MAG1A", "SM2_A", "SM3"]


def test_lines_are_those_of_python(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\n\n", "a\r\n", "a\r\nb\n", "\r", "a\x85b\n", "a ", "\n\r", "é\nü\n", "a\x1c\n", "a\x0b", "ab\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines(F.col("t")).alias("lines")).collect()
    assert {r.t: r.lines for r in got} == {t: t.splitlines() or [""] for t in texts}


def test_names_in_scope_are_searched_once(spark):
    pages = spark.createDataFrame([(1, 1, "SCOPE: SM10 / MAG03"), (2, 1, "MAG03D MAG03D MAG03D")], "doc_id int, page_num int, text string")
    names = T.block_names(pages)
    assert {tuple(r) for r in names.collect()} == {(1, "SM10"), (1, "MAG03"), (2, "MAG03D")}
    assert "SCOPE" not in names._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text, want", [("a  b \t c\nd", 2), ("a\u00a0 b  é", 2), ("é \x1fx", 1), ("a\x85b", 0), ("", 0)])
def test_wide_gaps(spark, text, want):
    assert one(spark, wide_gaps(F.col("t")), t=text) == want


def test_a_table_that_is_read_once_is_not_stored(spark):
    from pageledger.plans.registry import QUERIES
    from pageledger.session import tables_made

    before = len(tables_made)
    for name in ("pgc_01_score_table_pages_manual", "pgc_02_tag_pages_manual", "grd_01_grid_rows_manual", "seg_01_tag_section_lines_manual"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(tables_made) == before
