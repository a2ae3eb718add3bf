"""Tokens are counted in hash tables, with the least place as one number."""

from pageledger.operators import text as T

ROWS = [(1, 2, "SM1 xx SM20"), (1, -1, "zz SM20"), (1, None, "SM3"), (2, 1, "plain"), (2, 3, None), (3, 1, "alpha BETA"), (3, 2, "BETA the the the"), (4, 1, "beta beta"), (4, 2, "AB1"), (5, 1, None), (6, 1, "two one two one")]


def test_names_and_places_are_the_same_for_any_kind_of_page_number(spark):
    for kind in ("int", "long"):
        pages = spark.createDataFrame(ROWS, f"doc_id int, page_num {kind}, text string")
        assert dict(map(tuple, T.dominant_name(pages).collect())) == {1: "SM20", 2: "UNKNOWN", 3: "BETA", 4: "AB1", 5: "UNKNOWN", 6: "TWO"}
        counts = T.identifier_counts(pages)
        assert dict(counts.dtypes)["first_at"] == f"struct<page_num:{'int' if kind == 'int' else 'bigint'},pos:int>"
        assert {(r.doc_id, r.token): (r.n, *r.first_at) for r in counts.collect()} == {(1, "SM1"): (1, 2, 0), (1, "SM20"): (2, -1, 0), (1, "SM3"): (1, None, 0), (4, "AB1"): (1, 2, 0)}


def test_tokens_are_not_sorted_to_be_counted(spark):
    pages = spark.createDataFrame(ROWS, "doc_id int, page_num int, text string")
    for counts in (T.identifier_counts(pages), T.detect_variants(pages).select("doc_id", "variant", "n")):
        assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    plan = T.dominant_name(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
