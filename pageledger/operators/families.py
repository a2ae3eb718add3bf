"""Limit-table families: grouping pages, parsing tables, integrity checks, reports.

``tables(family, table_idx, title, kind, columns)`` has one row per table, ``rows(family, table_idx, row_idx, parameter,
setting, vals)`` one per table row. Header work happens inside a table's row; a table with very many rows is only ever
aggregated or joined, never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import filled, strip
from pageledger.operators.ordered import previous, running_sum, with_running

TABLE = ["family", "table_idx"]
STRINGS = "array<string>"
FLAG_COLUMNS = ("family", "table_idx", "rule_id", "detail", "message", "info")


def _empty() -> Column:
    return F.array().cast(STRINGS)


def _listed(names: Column) -> Column:
    """['a', 'b'] as text."""
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


# ---- pages to families -------------------------------------------------------------------------------------------------

PAGE_META = (
    "array<struct<page_num:int,content_type:string,family_label:string,submachines_in_title:array<string>,table_title:string>>"
)


def page_meta(pages: DataFrame, replies: DataFrame, chunk_pages: int = 12) -> DataFrame:
    """Classification of every page. ``replies(doc_id, chunk_idx, body)`` answer for ``chunk_pages`` pages each; a page without
    a readable entry is a procedure page, and the last of several entries counts."""
    body = F.from_json(strip_fences(F.col("body")), PAGE_META, {"mode": "PERMISSIVE"})
    entries = replies.select("doc_id", "chunk_idx", F.posexplode(body).alias("pos", "e")).select("doc_id", "chunk_idx", "pos", "e.*")
    last = entries.groupBy("doc_id", "chunk_idx", "page_num").agg(
        F.max_by(F.struct("content_type", "family_label", "submachines_in_title", "table_title"), "pos").alias("m")
    )
    chunk = F.floor((F.col("page_num") - 1) / F.lit(chunk_pages)).cast("int")
    return (
        pages.select("doc_id", "page_num", chunk.alias("chunk_idx"))
        .join(last, ["doc_id", "chunk_idx", "page_num"], "left")
        .select(
            "doc_id", "page_num", F.coalesce("m.content_type", F.lit("procedure")).alias("content_type"), "m.family_label",
            F.coalesce("m.submachines_in_title", _empty()).alias("submachines_in_title"), "m.table_title",
        )
    )


def family_pages(meta: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each page with the number of its family; pages before the first start fall away, a document without a start is one family."""
    start = F.col("content_type").isin("family_start", "mixed") & filled(F.col("family_label"))
    marked = meta.withColumn("_start", F.coalesce(start, F.lit(False)))
    first = meta.groupBy(*keys).agg(F.min("page_num").alias("_first"))
    with_start = marked.filter("_start").select(*keys).distinct().withColumn("_has", F.lit(True))
    numbered = with_running(marked, keys, "page_num", family_no=running_sum(F.col("_start").cast("int")))
    out = numbered.join(first, list(keys)).join(with_start, list(keys), "left")
    whole = F.col("_has").isNull()
    return (
        out.filter(whole | (F.col("family_no") > 0))
        .withColumn("family_no", F.when(whole, 1).otherwise(F.col("family_no")).cast("int"))
        .withColumn("_start", F.when(whole, F.col("page_num") == F.col("_first")).otherwise(F.col("_start")))
        .drop("_has", "_first")
    )


def group_families(meta: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per family: label, first and last page, number of pages, title list of the start page."""
    has_title = "submachines_in_title" in meta.columns
    title = F.col("submachines_in_title") if has_title else _empty()
    pages = family_pages(meta, keys)
    return pages.groupBy(*keys, "family_no").agg(
        F.coalesce(F.nullif(F.max(F.when(F.col("_start"), F.col("family_label"))), F.lit("")), F.concat(F.lit("FAMILY_"), F.max("family_no"))).alias("label"),
        F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"), F.count("*").alias("n_pages"),
        F.coalesce(F.max_by(title, F.when(F.col("_start"), 1)), _empty()).alias("title_submachines"),
    )


def strip_fences(raw: Column) -> Column:
    inner = F.regexp_replace(F.trim(raw), r"(?m)^```(?:json)?\s*", "")
    return F.trim(F.regexp_replace(inner, r"(?m)\s*```\s*$", ""))


#: Tables and rows stay JSON texts until each is read by itself: what is no object is flagged and costs nothing else.
REPLY = "struct<family_label:string,title_submachines:array<string>,page_range:array<int>,tables:array<string>>"
TABLE_REPLY = "struct<kind:string,title:string,submachine_columns:array<string>,rows:array<string>>"
ROW_REPLY = "struct<parameter:string,setting:string,`values`:array<string>>"


def _is_object(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("{"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """``replies(family, body)`` with the parsed reply in ``r``; ``readable`` is false for broken JSON, ``is_object`` for anything but an object."""
    bare = replies.withColumn("body", strip_fences(F.col("body")))
    valid = bare.withColumn("readable", F.try_parse_json("body").isNotNull()).withColumn("is_object", F.coalesce(_is_object(F.col("body")), F.lit(False)))
    return valid.withColumn("r", F.when(F.col("is_object"), F.from_json("body", REPLY)))


def _table_items(parsed: DataFrame) -> DataFrame:
    items = parsed.select("family", F.posexplode("r.tables").alias("table_idx", "item"))
    return items.withColumn("t", F.when(_is_object(F.col("item")), F.from_json("item", TABLE_REPLY)))


def malformed(parsed: DataFrame) -> DataFrame:
    """A flag for every table and row of a reply that is not an object."""
    items = _table_items(parsed)
    rows = items.select(*TABLE, F.explode("t.rows").alias("item"))
    bad = lambda df, rule, text: _flag_rows(df.filter(~F.coalesce(_is_object(F.col("item")), F.lit(False))), rule, F.left("item", F.lit(80)), F.lit(text))
    return bad(items, "malformed_table", "a table of the reply is not an object").unionByName(bad(rows, "malformed_row", "a row of the table is not an object"))


def raw_tables(parsed: DataFrame) -> DataFrame:
    return _table_items(parsed).filter("t IS NOT NULL").select(
        "family", "table_idx", strip(F.coalesce("t.title", F.lit(""))).alias("title"), F.coalesce("t.kind", F.lit("spec")).alias("kind"),
        F.transform(F.filter(F.coalesce("t.submachine_columns", _empty()), lambda c: filled(c)), strip).alias("columns"),
    )


def raw_rows(parsed: DataFrame) -> DataFrame:
    rows = _table_items(parsed).select("family", "table_idx", F.posexplode("t.rows").alias("pos", "item"))
    rows = rows.filter(_is_object(F.col("item"))).withColumn("w", F.from_json("item", ROW_REPLY))
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    return rows.select(
        "family", "table_idx", (F.col("pos") + 1).alias("row_idx"), text("w.parameter").alias("parameter"), text("w.setting").alias("setting"),
        F.transform(F.coalesce("w.values", _empty()), strip).alias("vals"),
    )


def family_meta(parsed: DataFrame, meta: DataFrame) -> DataFrame:
    """Label, title list and source of every family: the enriched reply, else ``meta(family, label, title_submachines, external)``,
    else derived from the reply's own spec columns. An unknown title (NULL) stays apart from an empty one."""
    spec_columns = F.flatten(
        F.transform(
            F.filter(F.transform(F.filter(F.coalesce("r.tables", _empty()), _is_object), lambda t: F.from_json(t, TABLE_REPLY)), lambda t: t["kind"] == "spec"),
            lambda t: F.filter(F.transform(F.coalesce(t["submachine_columns"], _empty()), strip), lambda c: c != ""),
        )
    )
    m = meta.select("family", F.col("label").alias("_label"), F.col("title_submachines").alias("_title"), F.col("external").alias("_ext"), F.lit(True).alias("_meta"))
    own, side = F.col("r.family_label").isNotNull(), F.col("_meta").isNotNull()
    return parsed.join(m, "family", "left").select(
        "family",
        F.when(own, F.col("r.family_label")).when(side, F.col("_label")).otherwise(F.trim(F.replace("family", F.lit("_"), F.lit(" ")))).alias("label"),
        F.when(own, F.col("r.title_submachines")).when(side, F.col("_title")).otherwise(F.array_distinct(spec_columns)).alias("title_submachines"),
        F.when(own, True).when(side, F.coalesce("_ext", F.lit(True))).otherwise(False).alias("external"),
        F.when(own, "reply").when(side, "meta").otherwise("derived").alias("source"),
    )


# ---- headers and rows --------------------------------------------------------------------------------------------------


def _parts(header: Column) -> Column:
    return F.filter(F.transform(F.split(header, "/"), strip), lambda p: p != "")


def expand_headers(headers: Column) -> Column:
    """Unpack "A100/121": shorter parts take their missing prefix from the first one, up to the most common length of the
    headers that are not packed (first seen wins a tie; without any, the first part's length)."""
    lengths = F.transform(F.filter(headers, lambda h: ~F.contains(h, F.lit("/")) & (strip(h) != "")), F.length)
    votes = F.transform(
        lengths,
        lambda x: F.struct(
            F.size(F.filter(lengths, lambda y: y == x)).alias("n"), (-F.array_position(lengths, x)).alias("at"), x.alias("len")
        ),
    )
    expected = F.array_max(votes)["len"]

    def unpack(header: Column) -> Column:
        parts = _parts(header)
        head = F.get(parts, 0)
        want = F.coalesce(expected, F.length(head))

        def complete(p: Column, i: Column) -> Column:
            lack = want - F.length(p)
            return F.when((i > 0) & (lack > 0) & (lack <= F.length(head)), F.concat(F.substring(head, F.lit(1), lack), p)).otherwise(p)

        return F.transform(parts, complete)

    return F.flatten(F.transform(headers, unpack))


def expand_slash(tables: DataFrame) -> DataFrame:
    return tables.withColumn("columns", expand_headers(F.col("columns")))


def parse_tables(tables: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, rows, flags): expanded headers; values given per packed header repeated to fit; a table with a row that
    still does not fit becomes ``unverified``. Values are never padded or trimmed."""
    squeezed = F.transform(expand_headers(F.col("columns")), lambda c: F.regexp_replace(c, r"\s*-\s*", "-"))
    heads = tables.withColumn("_raw", F.col("columns")).withColumn(
        "columns", F.when(F.col("kind") == "spec", squeezed).otherwise(_empty())
    )
    counts = F.transform("_raw", lambda h: F.size(_parts(h)))
    joined = rows.join(heads.select(*TABLE, "title", "kind", F.size("columns").alias("_n"), counts.alias("_counts")), TABLE)
    spec = F.col("kind") == "spec"
    packed = (F.size("vals") == F.size("_counts")) & (F.size("vals") != F.col("_n"))
    repeated = F.flatten(F.zip_with("vals", "_counts", lambda v, n: F.array_repeat(v, n)))
    fitted = joined.withColumn("vals", F.when(spec & packed, repeated).otherwise(F.col("vals")))
    fitted = fitted.withColumn("_bad", spec & (F.size("vals") != F.col("_n")))
    bad_tables = fitted.filter("_bad").groupBy(*TABLE).agg(F.count("*").alias("_bad_rows"))
    checked = heads.join(bad_tables, TABLE, "left").withColumn(
        "kind", F.when(F.col("_bad_rows").isNotNull(), "unverified").otherwise(F.col("kind"))
    )
    message = F.format_string(
        "[%s] row '%s'/'%s': %d values vs %d columns, so the table is not verified", F.col("title"), F.col("parameter"), F.col("setting"), F.size("vals"), F.col("_n")
    )
    flags = _flag_rows(fitted.filter("_bad"), "pad_trim_ban", F.col("parameter"), message)
    return checked.drop("_raw", "_bad_rows"), fitted.select(*rows.columns), flags


def _flag_rows(df: DataFrame, rule: str, detail: Column, message: Column, info: bool = False) -> DataFrame:
    return df.select(*TABLE, F.lit(rule).alias("rule_id"), detail.alias("detail"), message.alias("message"), F.lit(info).alias("info"))


def torn_rows(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of spec tables (as sent) whose parameter has fewer than two letters."""
    p = strip(F.col("parameter"))
    torn = (p != "") & (F.length(F.regexp_replace(p, "[^A-Za-z]", "")) < 2)
    spec = tables.filter("kind = 'spec'").select(*TABLE, "title")
    message = F.format_string("[%s] the row looks torn: parameter '%s' names nothing", F.col("title"), p)
    return _flag_rows(rows.filter(torn).join(spec, TABLE), "torn_row", p, message)


# ---- integrity checks --------------------------------------------------------------------------------------------------


def _is_placeholder(c: Column) -> Column:
    return (strip(c) == "") | strip(c).rlike(f"(?i){P.PLACEHOLDER_COLUMN}")


def _is_non_model(c: Column) -> Column:
    return strip(c).rlike(f"(?i){P.NON_MODEL_COLUMN}")


def _is_fragment(c: Column) -> Column:
    """White space followed by digits, %, brackets or signs; a bracketed brand name at the end does not count."""
    bare = strip(F.regexp_replace(strip(c), P.BRAND_SUFFIX, ""))
    return bare.rlike(rf"(?s)^\S+\s+.*(?:{P.VALUE_SUFFIX})")


def _is_split(c: Column) -> Column:
    return strip(F.regexp_replace(c, P.BRAND_SUFFIX, "")).rlike(P.SPLIT_HEADER)


def check_headers(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, flags). The chain stops at its first failure: placeholder → unverified; mostly numeric → aux; value fragment →
    unverified; a split-looking header is only flagged. ``reached`` lists the checks that were made."""
    cols = F.col("columns")
    bad = {
        "unreadable_header": F.filter(cols, _is_placeholder), "non_model_column": F.filter(cols, _is_non_model),
        "value_fragment": F.filter(cols, _is_fragment), "split_header": F.filter(cols, _is_split),
    }
    in_scope = (F.col("kind") == "spec") & (F.size(cols) > 0)
    failed = (
        F.when(F.size(bad["unreadable_header"]) > 0, 0).when(F.size(bad["non_model_column"]) * 2 > F.size(cols), 1)
        .when(F.size(bad["value_fragment"]) > 0, 2)
    )
    chain = F.array(*[F.lit(c) for c in P.ALL_CHECKS[1:5]])
    marked = tables.withColumn("_fail", F.when(in_scope, failed)).withColumn(
        "reached", F.when(in_scope, F.slice(chain, F.lit(1), F.coalesce(F.col("_fail") + 1, F.lit(4)))).otherwise(_empty())
    )
    out = marked.withColumn(
        "kind", F.when(F.col("_fail").isin(0, 2), "unverified").when(F.col("_fail") == 1, "aux").otherwise(F.col("kind"))
    )
    text = (
        F.when(F.col("_fail") == 0, F.format_string("[%s] headers that cannot be read: %s, so the table is not verified", F.col("title"), _listed(bad["unreadable_header"])))
        .when(F.col("_fail") == 1, F.format_string("[%s] headers that are voltages: %s, so the table is auxiliary", F.col("title"), _listed(bad["non_model_column"])))
        .otherwise(F.format_string("[%s] headers cut from values: %s, so the table is not verified", F.col("title"), _listed(bad["value_fragment"])))
    )
    stopped = marked.filter("_fail IS NOT NULL").select(
        *TABLE, F.element_at(chain, F.col("_fail") + 1).alias("rule_id"), F.lit(None).cast("string").alias("detail"), text.alias("message"), F.lit(False).alias("info")
    )
    suspicious = marked.filter(in_scope & F.col("_fail").isNull()).select(*TABLE, "title", F.explode(bad["split_header"]).alias("c"))
    split = _flag_rows(suspicious, "split_header", F.col("c"), F.format_string("[%s] the header looks split: '%s'", F.col("title"), F.col("c")))
    return out.drop("_fail"), stopped.unionByName(split)


def _prefixes(names: Column) -> Column:
    return F.transform(names, lambda s: F.upper(F.substring(F.regexp_extract(strip(s), "^([A-Za-z]+)", 1), 1, 3)))


def _most_common(xs: Column) -> Column:
    """Most frequent element, first seen on a tie."""
    votes = F.transform(
        xs, lambda x: F.struct(F.size(F.filter(xs, lambda y: y == x)).alias("n"), (-F.array_position(xs, x)).alias("at"), x.alias("v"))
    )
    return F.array_max(votes)["v"]


def prefix_vote(tables: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome per family, flags). ``families(family, title_submachines, external)``. Outcome: ``ran``, ``na`` (title derived from
    the table itself) or ``could_not_run`` (title unknown), which is itself a flag."""
    title = F.col("title_submachines")
    outcome = F.when(title.isNull(), "could_not_run").when(~F.col("external"), "na").otherwise("ran")
    judged = families.select("family", title, outcome.alias("outcome"))
    unknown = judged.filter("outcome = 'could_not_run'").select(
        "family", F.lit(None).cast("int").alias("table_idx"), F.lit(P.ALL_CHECKS[5]).alias("rule_id"), F.lit(None).cast("string").alias("detail"),
        F.lit("the vote on prefixes needs the title list, which is unknown").alias("message"),
        F.lit(False).alias("info"),
    )
    votes = judged.filter("outcome = 'ran'").select("family", _most_common(_prefixes(F.filter(title, lambda s: s != ""))).alias("_title"))
    own = F.array_distinct(_prefixes(F.col("columns")))
    uniform = (
        tables.filter((F.col("kind") == "spec") & (F.size("columns") > 0) & (F.size(own) == 1))
        .select(*TABLE, "title", F.get(own, 0).alias("_own"))
        .join(votes, "family")
        .filter((F.col("_own") != "") & (F.col("_title") != "") & (F.col("_own") != F.col("_title")))
    )
    message = F.format_string(
        "[%s] all columns begin with '%s', the title's models with '%s'; reported, not changed", F.col("title"), F.col("_own"), F.col("_title")
    )
    return judged.select("family", "outcome"), unknown.unionByName(_flag_rows(uniform, P.ALL_CHECKS[5], F.col("_own"), message))


def title_coverage(tables: DataFrame, families: DataFrame) -> DataFrame:
    """(family, side, code): codes only in the title (``title``) or only in spec tables (``table``), where a title is known."""
    known = families.filter("external AND size(title_submachines) > 0").select("family", "title_submachines")
    in_title = known.select("family", F.explode("title_submachines").alias("code")).distinct().withColumn("_t", F.lit(1))
    in_tables = (
        tables.filter("kind = 'spec'").join(known.select("family"), "family", "left_semi")
        .select("family", F.explode("columns").alias("code")).distinct().withColumn("_c", F.lit(1))
    )
    return (
        in_title.join(in_tables, ["family", "code"], "full")
        .filter("_t IS NULL OR _c IS NULL")
        .select("family", F.when(F.col("_c").isNull(), "title").otherwise("table").alias("side"), "code")
    )


def coverage_flags(coverage: DataFrame) -> DataFrame:
    """One INFO flag per family and side; it never affects CLEAN."""
    names = _listed(F.array_sort(F.collect_set("code")))
    message = F.when(
        F.col("side") == "title",
        F.concat(F.lit("only in the title: "), F.col("names"), F.lit(" stand in no spec table")),
    ).otherwise(F.concat(F.lit("only in tables: "), F.col("names")))
    return coverage.groupBy("family", "side").agg(names.alias("names")).select(
        "family", F.lit(None).cast("int").alias("table_idx"), F.lit("title_coverage").alias("rule_id"), F.col("side").alias("detail"),
        message.alias("message"), F.lit(True).alias("info"),
    )


def submachine_union(tables: DataFrame) -> DataFrame:
    """Distinct codes of the spec tables in first-seen order."""
    codes = tables.filter("kind = 'spec'").select(*TABLE, F.posexplode("columns").alias("pos", "code"))
    first = codes.groupBy("family", "code").agg(F.min(F.struct("table_idx", "pos")).alias("at"))
    return first.select("family", "code", F.row_number().over(Window.partitionBy("family").orderBy("at")).alias("code_no"))


# ---- results -----------------------------------------------------------------------------------------------------------


def family_checks(tables: DataFrame, votes: DataFrame) -> DataFrame:
    """(family, run, na, not_run): the six checks by what happened to them. ``tables`` as left by ``check_headers``."""
    made = tables.groupBy("family").agg(
        *[F.bool_or(F.array_contains("reached", c)).alias(c) for c in P.ALL_CHECKS[1:5]], F.bool_or(F.size("reached") > 0).alias("_any")
    )
    none = ~F.coalesce("_any", F.lit(False))
    joined = votes.join(made, "family", "left")
    ran = F.filter(
        F.array(
            F.lit(P.ALL_CHECKS[0]), *[F.when(none | F.col(c), c) for c in P.ALL_CHECKS[1:5]],
            F.when(F.col("outcome") == "ran", P.ALL_CHECKS[5]),
        ),
        lambda x: x.isNotNull(),
    )
    na = F.when(F.col("outcome") == "na", F.array(F.lit(P.ALL_CHECKS[5]))).otherwise(_empty())
    every = F.array(*[F.lit(c) for c in P.ALL_CHECKS])
    out = joined.select("family", ran.alias("run"), na.alias("na"))
    return out.withColumn("not_run", F.array_except(F.array_except(every, F.col("run")), F.col("na")))


def family_status(checks: DataFrame, flags: DataFrame) -> DataFrame:
    """CLEAN: every check ran or is not applicable, and there is no flag but INFO ones."""
    counts = flags.groupBy("family").agg(F.count_if(~F.col("info")).alias("flags"), F.count_if(F.col("info")).alias("infos"))
    n = F.coalesce("flags", F.lit(0))
    status = F.when((F.size("not_run") == 0) & (n == 0), "CLEAN").otherwise("NOT CLEAN")
    return checks.join(counts, "family", "left").select(
        "family", status.alias("status"), "run", "na", "not_run", n.alias("flags"), F.coalesce("infos", F.lit(0)).alias("infos")
    )


def limits_by_model(tables: DataFrame, rows: DataFrame, chunk: int | None = None) -> DataFrame:
    """Long limits of the spec tables per model, without NA. The parameter is blank where it equals that of the model's previous
    kept row in the table."""
    first = F.filter(
        F.transform("columns", lambda c, i: F.struct(c.alias("model"), i.alias("idx"))),
        lambda s: F.array_position("columns", s["model"]) == s["idx"] + 1,
    )
    heads = tables.filter("kind = 'spec'").select(*TABLE, "title", first.alias("_models"))
    long = (
        rows.join(heads, TABLE)
        .select(*TABLE, "title", "row_idx", "parameter", "setting", "vals", F.explode("_models").alias("m"))
        .select(*TABLE, "title", "row_idx", F.col("m.model").alias("model"), "parameter", "setting", F.coalesce(F.get("vals", F.col("m.idx")), F.lit("")).alias("limit"))
        .filter(F.upper(strip(F.col("limit"))) != "NA")
    )
    opts = {} if chunk is None else {"chunk": chunk}
    seen = with_running(long, [*TABLE, "model"], "row_idx", _before=previous(F.col("parameter")), **opts)
    shown = F.when(F.col("_before").eqNullSafe(F.col("parameter")), "").otherwise(F.col("parameter"))
    return seen.withColumn("parameter", shown).drop("_before")


def aux_rows(tables: DataFrame, rows: DataFrame) -> DataFrame:
    aux = tables.filter("kind = 'aux'").select(*TABLE, "title")
    return rows.join(aux, TABLE).select(*TABLE, "title", "row_idx", "parameter", "setting", F.array_join("vals", ", ").alias("limit"))


def family_report(families: DataFrame, status: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Per family: status, pages, checks, tables and rows by kind, flags."""
    per_table = tables.select(*TABLE, "kind").join(rows.groupBy(*TABLE).agg(F.count("*").alias("n")), TABLE, "left")
    kinds = ("spec", "aux", "unverified")
    counts = per_table.groupBy("family").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_tables") for k in kinds], F.sum(F.when(F.col("kind") == "spec", F.col("n")).otherwise(0)).alias("spec_rows")
    )
    return families.select("family", "first_page", "last_page").join(status, "family").join(counts, "family", "left").select(
        "family", "status", "first_page", "last_page", F.size("run").alias("checks_run"), F.array_join("na", ", ").alias("checks_na"),
        F.array_join("not_run", ", ").alias("checks_not_run"), *[F.coalesce(f"{k}_tables", F.lit(0)).alias(f"{k}_tables") for k in kinds],
        F.coalesce("spec_rows", F.lit(0)).alias("spec_rows"), "flags", "infos",
    )


def blocked_tables(tables: DataFrame, rows: DataFrame, flags: DataFrame, sample: int = 3) -> DataFrame:
    """Unverified tables with the number of their flags and their first rows."""
    blocked = tables.filter("kind = 'unverified'").select(*TABLE, "title")
    reasons = flags.groupBy(*TABLE).agg(F.count("*").alias("reasons"))
    w = Window.partitionBy(*TABLE).orderBy("row_idx")
    head = rows.join(blocked, TABLE, "left_semi").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= sample)
    return (
        blocked.join(reasons, TABLE, "left")
        .join(head, TABLE, "left")
        .select(*TABLE, "title", F.coalesce("reasons", F.lit(0)).alias("reasons"), "row_idx", "parameter", "setting", F.array_join("vals", "|").alias("vals"))
    )


def top_families(tables: DataFrame, rows: DataFrame, k: int = 2, sample: int = 8) -> DataFrame:
    """The ``k`` families with the most spec rows, and the first rows of each one's largest spec table."""
    spec = tables.filter("kind = 'spec'").select(*TABLE, "title")
    sizes = spec.join(rows.groupBy(*TABLE).agg(F.count("*").alias("n")), TABLE, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per_family = sizes.groupBy("family").agg(
        F.sum("n").alias("spec_rows"), F.max_by(F.struct("table_idx", "title"), F.struct(F.col("n"), -F.col("table_idx"))).alias("t")
    )
    best = per_family.orderBy(F.col("spec_rows").desc(), "family").limit(k)
    best = best.select("family", "spec_rows", "t.table_idx", "t.title")
    w = Window.partitionBy(*TABLE).orderBy("row_idx")
    head = rows.join(best, TABLE).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= sample)
    return head.select(*TABLE, "title", "spec_rows", "row_idx", "parameter", "setting", F.array_join("vals", "|").alias("vals"))
