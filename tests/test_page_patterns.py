"""Patterns behind a search for words give what the patterns alone give, in any script."""

import random

from pyspark.sql import functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import LINE_BREAK, OTHER_BREAK, rx, rx_if, split_lines
from pageledger.operators import pageclass as G

PARTS = (
    "table", "TAble", "ﬆable", "product settings", "Product", "acceptable  limits", "ref. voltage", "refvoltage", "voltage", "Procedure", "process :", "PROCESS:", "functional\ntest", "dip s/w", "check point",
    "B] Goal :", "e]goal:", "lv cut off", "HV cutoff", "cut", "product labelling", "cleaning & packing", "factory setting", "Healthy condition", "asy x led", "d] goal:", "ſ", "ı", "K", "é", "ẗable", "\x85", "\r", " ", "1. A", "x", " ", "\n",
)


def texts(spark):
    rnd = random.Random(3)
    rows = [(i, 1, True, "".join(rnd.choice(PARTS) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 4)))) for i in range(4000)]
    return spark.createDataFrame([*rows, (4000, 1, True, None)], "doc_id long, page_num int, has_image boolean, text string")


def test_tags_are_those_of_the_patterns(spark):
    t = F.coalesce("text", F.lit(""))
    want = [rx(t, P.SPEC_PAGE), rx(t, P.PROCEDURE_PAGE), t.rlike(P.NUMBERED_STEP), rx(t, P.OTHER_PROCESS)]
    pages = texts(spark)
    found = pages.select("doc_id", F.array(*want).alias("want")).join(G.tag_pages(pages).select("doc_id", F.array("is_spec", "is_procedure", "has_numbered_step", "is_other_process").alias("got")), "doc_id")
    assert found.count() == 4001 and found.where("want <> got").isEmpty()
    kinds = found.select("want").distinct().count()
    assert kinds >= 8
    content = pages.select(rx(F.col("text"), P.TEST_CONTENT).alias("a"), rx(F.col("text"), f"(?=[a-fhiloprstu])(?:{P.TEST_CONTENT})").alias("b"))
    assert content.where("a <> b").isEmpty() and content.where("a").count() > 100


def test_words_decide_only_whether_a_pattern_is_tried(spark):
    rows = spark.createDataFrame([("a ﬆable",), ("aTaBle",), (None,), ("x",)], "text string")
    assert [r[0] for r in rows.select(rx_if(F.col("text"), F.upper("text"), ("TABLE",), "TABLE", "t").alias("r")).collect()] == [False, True, False, False]


def test_lines_of_any_script(spark):
    t = F.coalesce("text", F.lit(""))
    plain = F.split(F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t), "\n")
    want = F.when(t.rlike(OTHER_BREAK), F.split(F.regexp_replace(t, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK)).otherwise(plain)
    assert texts(spark).select(want.alias("a"), split_lines(F.col("text")).alias("b")).where("a <> b").isEmpty()
