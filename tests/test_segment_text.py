"""Blocks are found without dealing out the text of lines again."""

import re

from pageledger.functions import patterns as P
from pageledger.operators import segment as S


def test_table_specs_are_told_without_text(spark):
    pages = spark.createDataFrame([(1, 1, "PROCESS: a\nTABLE 1\n(PRODUCT\nSETTINGS\nPROCESS: b\nTABLE\nPROCESS: c\n(PRODUCT SETTINGS"), (1, 2, "PROCESS: d\nUnder Voltage\n(UV)\nx\n150\nto 170 VAC")], "doc_id int, page_num int, text string")
    found = S.table_spec_blocks(S.segment_blocks(pages)[1])
    assert sorted(r.block_idx for r in found.collect()) == [1, 4]
    assert "line:string" not in found._jdf.queryExecution().executedPlan().toString()


def test_every_part_of_a_broken_reference_is_kept():
    for whole in ("REFER THE FOLLOWING TABLES", "REFER TABLE", "TABLE BELOW", "TABLES GIVEN", "TABLE 01", "TABLE 2", "AS PER TABLE"):
        words = whole.split()
        for cuts in range(1 << (len(words) - 1)):
            lines = "".join(w + ("\n" if cuts >> k & 1 else " ") for k, w in enumerate(words)).strip().split("\n")
            assert re.search(P.DANGLING_REFERENCE, "\n".join(lines))
            assert all(re.search(P.DANGLING_PART.replace(r"\z", r"\Z"), x) for x in lines)
