"""A cross-section of the registered queries against their SQL at the smallest scale (all of them: ``python tests/oracle.py <dir>``)."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
NAMES = (
    "txt_03_strip_repeated_lines", "dq_17_variant_summary", "cmp_02_accuracy", "run_04_run_outputs", "grd_05_combine_grids", "fam_11_family_status", "jsn_02_coalesce_chunks", "stp_12_correct_nominal",
    "stp_18_layout_b_required", "out_05_sheet_cells_steps", "str_02_run_totals_stream",
)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    rows, problems = oracle.compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert rows > 0 and not problems, problems


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
