"""Corpus text: lines, repeated lines, model codes and names.

All functions take ``pages(doc_id, page_num, text)``. Counting is by (document, line) or (document, token), so one
huge document spreads over all tasks; nothing is gathered per document except sets with a stated bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import WORD, split_lines, strip, whole_words
from pageledger.session import materialize

DOC = ("doc_id",)


def page_text(pages: DataFrame) -> DataFrame:
    """Text-only view; the image column is pruned from the scan."""
    return pages.select("doc_id", "page_num", "text")


def explode_lines(pages: DataFrame) -> DataFrame:
    """One row per non-blank line, trimmed, with its 1-based position on the page."""
    return (
        pages.select("doc_id", "page_num", F.posexplode(split_lines(F.col("text"))).alias("pos", "raw"))
        .select("doc_id", "page_num", (F.col("pos") + 1).alias("line_no"), strip(F.col("raw")).alias("line"))
        .filter("line <> ''")
    )


def repeated_lines(pages: DataFrame, min_share: float = 0.5, min_len: int = 10, keys: Sequence[str] = DOC) -> DataFrame:
    """Lines longer than ``min_len`` on at least max(2, min_share * pages) distinct pages of a document.

    A page lists each of its lines once before the explode, so counting rows counts pages and the aggregate is
    one shuffle with map-side combining.
    """
    long_lines = F.array_distinct(
        F.filter(F.transform(split_lines(F.col("text")), strip), lambda x: F.length(x) > min_len)
    )
    n_pages = pages.groupBy(*keys).agg(F.count("*").alias("_total"))
    return (
        pages.select(*keys, F.explode(long_lines).alias("line"))
        .groupBy(*keys, "line")
        .agg(F.count("*").alias("n_pages"))
        .filter("n_pages >= 2")
        .join(n_pages, list(keys))
        .filter(F.col("n_pages") >= F.col("_total") * F.lit(min_share))
        .select(*keys, "line", "n_pages")
    )


def strip_repeated_lines(pages: DataFrame, min_share: float = 0.5, keys: Sequence[str] = DOC) -> DataFrame:
    """Page text without its document's repeated lines; a document without any keeps its text as it is.

    The repeated lines of one document fit into an array: each takes at least ``min_share`` of the pages, so there are no
    more than (average lines per page) / min_share of them. Pages are filtered in place and never regrouped.
    """
    heads = repeated_lines(pages, min_share, keys=keys).groupBy(*keys).agg(F.collect_set("line").alias("_heads"))
    kept = F.filter(split_lines(F.col("text")), lambda x: ~F.array_contains(F.col("_heads"), strip(x)))
    return (
        pages.join(heads, list(keys), "left")
        .withColumn("text", F.when(F.col("_heads").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .select(*pages.columns)
    )


def _codes(pages: DataFrame, pattern: str, keys: Sequence[str], text: Column | None = None) -> DataFrame:
    """(keys, page_num, pos, token) for each whole-word match in upper-cased text."""
    source = F.upper(F.col("text") if text is None else text)
    found = F.regexp_extract_all(source, F.lit(whole_words(pattern)), F.lit(0))
    return pages.select(*keys, "page_num", F.posexplode(found).alias("pos", "token"))


def _first_at(tokens: DataFrame) -> Column:
    """Least place (page_num, pos) of a group, as one number where page numbers are integers: such a minimum is kept in a hash table, one of structs would have all tokens sorted."""
    if tokens.schema["page_num"].dataType.simpleString() not in ("int", "smallint", "tinyint"):
        return F.min(F.struct("page_num", "pos"))
    # a missing number comes before all others
    return F.min(F.coalesce(F.col("page_num").cast("long"), F.lit(-(1 << 31) - 1)) * F.lit(1 << 31) + F.col("pos"))


def _count_tokens(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"), _first_at(tokens).alias("first_at"))


def identifier_counts(pages: DataFrame, keys: Sequence[str] = DOC) -> DataFrame:
    """Occurrences of model codes per document, with the place of the first one."""
    counts = _count_tokens(_codes(pages, P.MODEL_CODE, keys), keys)
    if counts.schema["first_at"].dataType.simpleString() != "bigint":
        return counts
    number, kind = F.shiftright("first_at", 31), pages.schema["page_num"].dataType
    place = F.struct(F.when(number >= -(1 << 31), number).cast(kind).alias("page_num"), F.col("first_at").bitwiseAND((1 << 31) - 1).cast("int").alias("pos"))
    return counts.withColumn("first_at", place)


def dominant_name(pages: DataFrame, fallback: Column | str = "UNKNOWN", keys: Sequence[str] = DOC) -> DataFrame:
    """The most frequent model code (frequent and long ones first, then first seen); without any code the most frequent
    word of three or more letters outside the stop list if it occurs twice; else ``fallback``."""
    keys = list(keys)
    upper = F.upper("text")
    words = F.filter(F.regexp_extract_all(upper, F.lit(whole_words("[A-Z]{3,}")), F.lit(0)), lambda x: ~x.isin(*P.STOP_WORDS))
    # words count only where a document has no code at all, that is no row with one: a row with codes needs no words
    coded = pages.select(*keys, "page_num", "text", F.explode(F.array(F.regexp_extract_all(upper, F.lit(whole_words(P.MODEL_CODE)), F.lit(0)))).alias("_codes"))
    has_code = F.coalesce(F.size("_codes") > 0, F.lit(False))
    tokens = coded.select(*keys, "page_num", has_code.alias("_code"), F.posexplode_outer(F.when(has_code, F.col("_codes")).otherwise(words)).alias("pos", "token"))
    counts = tokens.groupBy(*keys, "_code", "token").agg(F.count("token").alias("n"), _first_at(tokens).alias("first_at"))
    weak = F.col("_code") & ~((F.col("n") >= 2) & (F.length("token") >= 4))
    # codes before words; a row without either only keeps its document
    best = F.min_by(F.struct("token", "_code", "n"), F.struct(F.col("token").isNull().alias("none"), (~F.col("_code")).alias("word"), weak.alias("weak"), -F.col("n"), "first_at")).alias("b")
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    name = F.when(F.col("b._code") | (F.col("b.n") >= 2), F.col("b.token"))
    return counts.groupBy(*keys).agg(best).select(*keys, F.coalesce(name, other).alias("machine"))


def scope_tails(pages: DataFrame, extra: str = "") -> DataFrame:
    """What follows the document's first ``SCOPE:`` as (doc_id, page_num, tail): letters, digits, slashes and space
    until the first other character, over as many pages as that takes."""
    allowed = rf"[\p{{L}}\p{{N}}_/\s{extra}]"
    joined = F.concat("text", F.lit("\n\n"))
    opening = rf"(?is)SCOPE\s*:\s*{allowed}"
    first = pages.filter(joined.rlike(opening)).groupBy("doc_id").agg(F.min("page_num").alias("_first"))
    # the first later page that holds another character closes the capture
    marked = pages.join(first, "doc_id").filter(F.col("page_num") >= F.col("_first"))
    tail = F.when(
        F.col("page_num") == F.col("_first"), F.regexp_extract(joined, rf"(?is)SCOPE\s*:\s*({allowed}+)", 1)
    ).otherwise(F.regexp_extract(joined, rf"^{allowed}*", 0))
    is_open = F.when(F.col("page_num") == F.col("_first"), joined.rlike(rf"(?is)^(?:(?!SCOPE\s*:\s*{allowed}).)*SCOPE\s*:\s*{allowed}+\z"))
    is_open = is_open.otherwise(joined.rlike(rf"^{allowed}*\z"))
    marked = marked.select("doc_id", "page_num", tail.alias("tail"), (~is_open).alias("_closes"))
    last = marked.filter("_closes").groupBy("doc_id").agg(F.min("page_num").alias("_last"))
    return (
        marked.join(last, "doc_id", "left")
        .filter("_last IS NULL OR page_num <= _last")
        .select("doc_id", "page_num", "tail")
    )


def scope_members(pages: DataFrame) -> DataFrame:
    """Model codes named after the first ``SCOPE:`` of a document, once each, in order (``member_no``)."""
    found = _codes(scope_tails(pages), P.SCOPE_CODE, DOC, F.col("tail"))
    once = found.groupBy("doc_id", "token").agg(F.min(F.struct("page_num", "pos")).alias("first_at"))
    w = Window.partitionBy("doc_id").orderBy("first_at")
    return once.select("doc_id", F.col("token").alias("member"), F.row_number().over(w).alias("member_no"))


def block_names(pages: DataFrame) -> DataFrame:
    """Names in the scope line, else those of the 20 most frequent codes that occur three times and have six characters."""
    in_scope = materialize(  # read twice below, and the pages are searched several times for it
        _codes(scope_tails(pages, ","), P.BLOCK_CODE, DOC, F.col("tail")).select("doc_id", F.col("token").alias("name")).distinct()
    )
    counts = _count_tokens(_codes(pages, P.BLOCK_CODE, DOC), DOC)
    w = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "first_at")
    frequent = (
        counts.withColumn("_rank", F.row_number().over(w))
        .filter("_rank <= 20")
        .filter("n >= 3 AND length(token) >= 6")
        .join(in_scope, "doc_id", "left_anti")
        .select("doc_id", F.col("token").alias("name"))
    )
    return in_scope.unionByName(frequent)


def detect_variants(pages: DataFrame, keys: Sequence[str] = DOC, limit: int = 8) -> DataFrame:
    """Variant codes of a text: letter first, letters and digits, 4 to 10 characters.

    Strong codes occur three times; only without any do weak ones count, which must stand in capitals in the text.
    The best ``limit`` by count, then length, then first seen, as ``rank``.
    """
    found = F.regexp_extract_all(F.upper("text"), F.lit(whole_words(P.VARIANT_CODE)), F.lit(0))
    tokens = pages.select(*keys, "page_num", "text", F.posexplode(found).alias("pos", "token"))
    tokens = tokens.select(*keys, "page_num", "pos", "token", F.contains("text", "token").alias("_verbatim"))
    counts = tokens.groupBy(*keys, "token").agg(
        F.count("*").alias("n"), _first_at(tokens).alias("first_at"), F.max("_verbatim").alias("_verbatim")
    )
    strong = F.col("n") >= 3
    w = Window.partitionBy(*keys).orderBy(strong.desc(), F.col("n").desc(), F.length("token"), "first_at")
    best = counts.filter(strong | F.col("_verbatim")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return (
        best.withColumn("_any", F.max(strong).over(Window.partitionBy(*keys)))
        .filter(strong | ~F.col("_any"))
        .select(*keys, F.col("token").alias("variant"), "n", "rank")
    )


def name_mentions(pages: DataFrame, names: DataFrame) -> DataFrame:
    """How often each known name of a document is mentioned on each page, as a whole word in any case.

    ``names(doc_id, name)``: the names of one document are few (its members), so they travel to the pages as an array and
    only matching words are exploded. Pages without a mention give no row.
    """
    listed = names.groupBy("doc_id").agg(F.collect_set(F.upper("name")).alias("_names"))
    words = F.regexp_extract_all(F.upper("text"), F.lit(f"{WORD}+"), F.lit(0))
    return (
        pages.join(listed, "doc_id")
        .select("doc_id", "page_num", F.explode(F.filter(words, lambda x: F.array_contains("_names", x))).alias("name"))
        .groupBy("doc_id", "page_num", "name")
        .agg(F.count("*").alias("n"))
    )


def requested_present(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested names found in the document. A document where none is found keeps no filter, so gives no row."""
    mentions = name_mentions(pages, requested.select("doc_id", F.col("machine").alias("name"))).select("doc_id", "name").distinct()
    return requested.join(
        mentions, (requested.doc_id == mentions.doc_id) & (F.upper(requested.machine) == mentions.name), "left_semi"
    )
