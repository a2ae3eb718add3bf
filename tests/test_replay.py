"""Malformed replies: whatever is not kept is flagged, and a reply that lost anything is not clean."""

import json

import pytest
from pyspark.sql import functions as F

from pageledger.operators import replies as J
from pageledger.plans.replay import replay

ROW = {"parameter": "UV trip", "setting": "8%", "values": ["1", "2"]}


def table(rows):
    return {"kind": "spec", "title": "t", "submachine_columns": ["AB1", "AB2"], "rows": rows}


REPLIES = {
    "good": {"family_label": "F", "title_submachines": ["AB1", "AB2"], "tables": [table([ROW, ROW])]},
    "row": {"family_label": "F", "title_submachines": ["AB1", "AB2"], "tables": [table([ROW, "stray", ROW])]},
    "table": {"family_label": "F", "title_submachines": ["AB1", "AB2"], "tables": ["stray", table([ROW])]},
    "list": [{"tables": [table([ROW])]}],
    "number": 7,
}


@pytest.fixture(scope="module")
def replayed(spark):
    replies = spark.createDataFrame([(k, json.dumps(v)) for k, v in REPLIES.items()], "family string, body string")
    meta = spark.createDataFrame([], "family string, label string, title_submachines array<string>, external boolean")
    return replay(replies, meta)


def test_clean_means_nothing_was_lost(replayed):
    status = {r.family: r.status for r in replayed.status.collect()}
    assert status == {"good": "CLEAN", **dict.fromkeys(("row", "table", "list", "number"), "NOT CLEAN")}


def test_good_items_beside_bad_ones_are_kept(replayed):
    rows = {r.family: r["count"] for r in replayed.rows.groupBy("family").count().collect()}
    assert rows == {"good": 2, "row": 2, "table": 1}
    kinds = {r.family: r.kind for r in replayed.tables.collect()}
    assert kinds == {"good": "spec", "row": "unverified", "table": "spec"}
    flags = {(r.family, r.rule_id) for r in replayed.flags.filter("NOT info").collect()}
    assert flags == {("row", "malformed_row"), ("table", "malformed_table"), ("list", "not_an_object"), ("number", "not_an_object")}


def test_steps_are_read_one_by_one(spark):
    body = '{"steps": [{"step_name": "a", "section_break": "yes"}, "plain", {"step_name": 5}, {"step_name": "z", "section_break": 0}]}'
    got = J.explode_steps(spark.createDataFrame([(1, body)], "k int, body string"), ["k"]).orderBy("step_idx").select("step_idx", "step_name", F.coalesce("section_break", F.lit(False))).collect()
    assert [tuple(r) for r in got] == [(1, "a", True), (4, "z", False)]
