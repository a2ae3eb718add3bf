"""The page query on ids of every size, repeated pages and columns that clash."""

import hashlib

from pyspark.sql import functions as F

from pageledger.llm import warc

PAGES = "page_id long, url string, html string"
SAME = "<p>" + "same " * 300


def expected(rows):
    """Of equal payloads of 1000 bytes or more the largest id answers."""
    best = {}
    for page_id, _, html in rows:
        if html is not None and len(html.encode()) >= 1000 and page_id is not None:
            best[html] = max(best.get(html, page_id), page_id)
    return best


def test_the_largest_id_answers(spark):
    ids = [5, 10**17, 9 * 10**18, -(2**63), 2**63 - 1, 999_999_999_999_999_999]
    for some in (ids, ids[:3], [-(2**63), -9 * 10**18, -4]):
        rows = [(i, f"http://a.example/{i}", SAME) for i in some]
        got = {r.page_id: (r.record_type, r.refers_to) for r in warc.page_records(spark.createDataFrame(rows, PAGES)).collect()}
        assert got == {i: ("response", None) if i == max(some) else ("revisit", max(some)) for i in some}


def test_numbers_in_header_fields():
    assert [warc.whole_number(t) for t in ("9223372036854775807", "9223372036854775808", "-9223372036854775808", "007", "", "x", "1.0", "٣")] == [2**63 - 1, None, -(2**63), 7, None, None, None, None]


def test_clashing_columns_and_long_pages(spark):
    rows = [(1, "http://a.example/1", SAME), (2, "http://a.example/2", SAME), (3, None, None), (4, "http://a.example/4", ""), (5, "http://a.example/5", "ü" * 2_000_000), (6, "dns:a", "<b>short"), (7, "http://a.example/7", "<b>short")]
    df = spark.createDataFrame(rows, PAGES)
    for name in ("record_id", "payload", "type", "prefer", "refers_to", "path", "content", "http", "n", "target_id"):
        df = df.withColumn(name, F.lit("clash"))
    best = expected(rows)
    got = {r.page_id: r for r in warc.page_records(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for page_id, _, html in rows:
        body, r = (html or "").encode(), got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        chosen = best.get(html)
        assert (r.record_type, r.refers_to) == (("response", None) if chosen in (None, page_id) else ("revisit", chosen))
