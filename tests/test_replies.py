"""What a value in a reply is follows from its JSON type."""

from pageledger.operators import replies as J

BODY = (
    '{"steps": [{"step_name": 5, "note": {"step_name": "x"}}, {"step_name": "c", "x": {"section_break": "yes"}, "section_break": false, "settings": ["a", 0, null, 7, "", false, true, {}], "leds": "one",'
    ' "voltage_pp": "[RY : 1", "on_delay": 0, "off_delay": "0"}, {"step_name": "r", "step_name": "last", "section_break": {"a": 1}, "voltage_pp": ["RY : 2.5", ""], "relay_status": null}, ["step_name"], null]} {"x": 1}'
)


def test_types_decide(spark):
    rows = J.explode_steps(spark.createDataFrame([(1, BODY), (2, "no object"), (3, None), (4, '{"steps": {"step_name": "a"}}'), (5, '{"test_steps": [], "procedure": [{"step_name": "p"}]}')], "k int, body string"), ["k"]).orderBy("k", "step_idx").collect()
    got = [(r.k, r.step_idx, r.step_name, r.section_break) for r in rows]
    assert got == [(1, 2, "c", False), (1, 3, "last", True), (5, 1, "p", None)]
    assert (rows[0].settings, rows[0].leds, rows[0].voltage_pp, rows[0].on_delay, rows[0].off_delay) == (["a", "7", "true"], None, ["[RY : 1"], None, "0")
    assert (rows[1].voltage_pp, rows[1].relay_status) == (["RY : 2.5"], None)
