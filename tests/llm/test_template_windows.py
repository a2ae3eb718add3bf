"""Template windows: which places count, and that a text is searched once and never copied for each window."""

from pageledger.llm import decontamination as D

TEXTS = [
    (1, None), (2, ""), (3, "one two three four five six seven"), (4, "one two three four five six seven eight"),
    (5, "a 1 b 2 c 3 d e f g"), (6, "a 1 b 2 c 3 d 4 e"), (7, "Take 5 KM north. (then) take 5 km <num> miles, south!"),
]


def test_places_of_windows(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert sorted((r.doc_id, r.pos) for r in D.windows(rows, "doc_id").collect()) == [(4, 0), (5, 0), (5, 1), (5, 2)]
    assert rows.where("doc_id = 7").select(D.template(rows.text).alias("t")).first().t == "take <num> <unit> north then take <num> <unit> <num> <unit> south"
    same = spark.createDataFrame([(1, "Go 7 miles on, then turn left at once"), (2, "go 9 km on then turn (left) at once")], "doc_id long, text string")
    got = D.windows(same, "doc_id").collect()
    assert len(got) == 4 and len({(r.pos, r.h) for r in got}) == 2


def test_a_text_is_searched_once(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    plan = D.windows(spark.read.parquet(f"{tmp_path}/t"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "slice(" not in plan
