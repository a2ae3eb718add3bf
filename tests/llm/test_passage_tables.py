"""Stored tables that no later step reads are deleted while passages are searched."""

import os

from pageledger.llm import passages
from pageledger.session import tables_made


def test_tables_are_deleted_when_read(spark):
    run = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"a b c {run} d"), (2, f"e {run} f g"), (3, "nothing here")], "doc_id long, text string")
    before = len(tables_made)
    found = passages.repeated_passages(docs)
    # the collisions, spans, open runs, and what the last comparison reads
    assert sum(os.path.exists(p) for p in tables_made[before:]) == 5
    assert [(r.doc_id, r.start_word, r.end_word, r.kept_doc_id, r.kept_start_word) for r in found.collect()] == [(2, 1, 81, 1, 3)]
