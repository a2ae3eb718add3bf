"""Page classes, the anchor page of a variant, and page budgets.

``pages(doc_id, page_num, text, has_image)``; ``targets(doc_id, variant)`` are the variants to look for, at most eight per block.
Repeated lines are found once per document and names are counted once per page, whatever the number of variants.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import rx, rx_if, strip, wide_gaps
from pageledger.operators import text as T
from pageledger.operators.ordered import running_sum, with_running
from pageledger.session import materialize

PAGE = ["doc_id", "page_num"]
ONE = ["doc_id", "variant"]


def score_table_pages(pages: DataFrame) -> DataFrame:
    """+2 for a keyword, +1 for more than 20 numbers, +1 for more than 10 wide gaps, -1 per procedure term; 3 makes a table page."""
    up = F.upper("text")
    any_of = lambda words: [F.contains(up, F.lit(w)).cast("int") for w in words]
    score = (
        F.greatest(*any_of(P.TABLE_KEYWORDS)) * 2 + (F.regexp_count("text", F.lit(r"\d+")) > 20).cast("int") + (wide_gaps(F.col("text")) > 10).cast("int")
    )
    for term in any_of(P.PROCEDURE_TERMS):
        score = score - term
    return pages.select(*PAGE, score.alias("score"), ((score >= 3) & F.col("has_image") & (F.length("text") > 0)).alias("is_table"))


def tag_pages(pages: DataFrame) -> DataFrame:
    """Spec and procedure markers of every page."""
    return pages.select(*PAGE, "has_image", *_tags(F.coalesce("text", F.lit(""))))


def _tags(t: Column) -> list[Column]:
    up = F.upper(t)
    procedure = rx_if(t, up, ("PROCE", "FUNCTIONAL", "S/W", "CHECK", "GOAL", "CUT"), P.PROCEDURE_PAGE, "a-fhlpt")
    return [
        rx_if(t, up, ("TABLE", "PRODUCT", "VOLTAGE"), P.SPEC_PAGE, "aprt").alias("is_spec"), procedure.alias("is_procedure"),
        t.rlike(P.NUMBERED_STEP).alias("has_numbered_step"), rx_if(t, up, ("PROCESS",), P.OTHER_PROCESS, "p").alias("is_other_process"),
    ]


def search_names(targets: DataFrame) -> DataFrame:
    """(doc_id, variant, own): the names that stand for a variant; with the suffix EG also the base name."""
    v = F.replace(F.upper("variant"), F.lit("_"), F.lit(""))
    base = F.when(F.endswith(v, F.lit("EG")) & (F.length(v) > 2), F.left(v, F.length(v) - 2))
    return targets.select(*ONE, F.filter(F.array(v, base), lambda x: x.isNotNull()).alias("own"))


def _names(name: Column, *around: tuple[str, str]) -> Column:
    """A pattern with the variant's name between the given texts; names are letters and digits, so they can stand in it."""
    return F.concat(F.lit("(?i)"), F.concat_ws("|", *[F.concat(F.lit(b), name, F.lit(a)) for b, a in around]))


def _cutoff_heading(name: Column) -> Column:
    head = r"PROCEDURE\s+FOR\s+CAT\s+ID\s*:.*"
    return F.coalesce(F.rlike("body", _names(name, (head, r".*R\s*LED"), (head + r"R\s*LED.*", ""))), F.lit(False))


def _heading_bonus(name: Column) -> Column:
    functional = F.rlike("body", _names(name, (r"FUNCTIONAL\s+TEST\s+PROCEDURE\s+FOR.*", "")))
    other = F.rlike("body", _names(name, (r"CAT\s+ID\s*:\s*", ""), (r"PROCEDURE\s+FOR\s+", "")))
    return F.when(_cutoff_heading(name), 15).when(functional, 10).when(other, 3).otherwise(0)


@dataclass(frozen=True)
class Prepared:
    """What several page operators need, computed once per set of pages."""

    tags: DataFrame
    bodies: DataFrame
    procedures: DataFrame
    mentions: DataFrame
    own: DataFrame


def prepare(pages: DataFrame, targets: DataFrame, names: DataFrame, cut: bool = True) -> Prepared:
    """Tags, texts without repeated lines, numbered procedure pages and mentions per page.

    With ``cut`` the results are checkpointed: everything that follows starts from these small tables instead of parsing
    the text again.
    """
    keep = materialize if cut else (lambda df: df)
    stripped = T.strip_repeated_lines(pages.select(*PAGE, "text", "has_image", F.col("text").alias("_raw")))
    tagged = keep(stripped.select(*PAGE, "has_image", *_tags(F.coalesce("_raw", F.lit(""))), F.col("text").alias("body")))
    tags, bodies = tagged.drop("body"), tagged.select(*PAGE, "has_image", "body")
    kept = tags.filter("has_image AND is_procedure AND NOT is_other_process").select(*PAGE)
    procedures = with_running(kept, ["doc_id"], "page_num", pos=running_sum(F.lit(1))).join(bodies.select(*PAGE, "body"), PAGE)
    own = search_names(targets)
    return Prepared(tags, bodies, keep(procedures), keep(_mentions(bodies, own, names, keep)), own)


def _mentions(bodies: DataFrame, own: DataFrame, names: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, variant, page_num, own_n, other_n): mentions of a variant and of all other block names.

    Names and counts are small and read twice each: with ``keep`` the pages are searched once for either.
    """
    own_long = own.select(*ONE, F.explode("own").alias("name"))
    block_names = keep(names.select("doc_id", F.upper("name").alias("name")).distinct()).withColumn("_block", F.lit(True))
    looked_for = own_long.select("doc_id", "name").unionByName(block_names.drop("_block"))
    counted = keep(T.name_mentions(bodies.withColumnRenamed("body", "text"), looked_for).join(block_names, ["doc_id", "name"], "left"))
    in_block = F.when(F.col("_block"), F.col("n")).otherwise(0)
    total = counted.groupBy(*PAGE).agg(F.sum(in_block).alias("all_n"))
    per_variant = counted.join(own_long, ["doc_id", "name"]).groupBy(*ONE, "page_num").agg(F.sum("n").alias("own_n"), F.sum(in_block).alias("own_block_n"))
    return per_variant.join(total, PAGE).select(*ONE, "page_num", "own_n", (F.col("all_n") - F.col("own_block_n")).alias("other_n"))


def anchor_page(p: Prepared) -> DataFrame:
    """The procedure page most exclusively about a variant: own minus other mentions, plus 15, 10 or 3 for its heading.

    Gives (doc_id, variant, page_num, pos, score, is_cutoff); the earlier page wins a tie.
    """
    rows = p.procedures.join(p.mentions, PAGE).filter(rx(F.col("body"), f"(?=[a-fhiloprstu])(?:{P.TEST_CONTENT})")).join(p.own, ONE)
    full, base = F.get("own", 0), F.get("own", 1)
    # the base name counts only where the full name has no heading
    own_bonus = _heading_bonus(full)
    bonus = F.when((own_bonus > 0) | base.isNull(), own_bonus).otherwise(_heading_bonus(base))
    cutoff = _cutoff_heading(full) | (base.isNotNull() & _cutoff_heading(base))
    scored = rows.withColumns({"score": F.col("own_n") - F.col("other_n") + bonus, "is_cutoff": cutoff})
    best = scored.groupBy(*ONE).agg(F.min_by(F.struct("page_num", "pos", "score", "is_cutoff"), F.struct(-F.col("score"), "pos")).alias("b"))
    return best.select(*ONE, "b.*")


def page_window(p: Prepared, anchors: DataFrame) -> DataFrame:
    """From the anchor (or the page before, if it mentions the variant and the anchor is no cut-off page) eight procedure pages, three for
    cut-offs, up to the first later page with another variant's heading; that page stays if more than 30 % of it comes before."""
    before = (
        anchors.filter("NOT is_cutoff").select(*ONE, (F.col("pos") - 1).alias("pos"))
        .join(p.procedures.select(*PAGE, "pos"), ["doc_id", "pos"])
        .join(p.mentions.select(*ONE, "page_num"), [*ONE, "page_num"], "left_semi")
        .select(*ONE, F.col("pos").alias("_start"))
    )
    start = anchors.join(before, ONE, "left").withColumn("start", F.coalesce("_start", "pos"))
    span = F.when(F.col("is_cutoff"), 3).otherwise(P.PAGE_CAP)
    wanted = start.select(*ONE, "is_cutoff", "start", F.explode(F.sequence(F.col("start"), F.col("start") + span - 1)).alias("pos"))
    rows = wanted.join(p.procedures, ["doc_id", "pos"]).join(p.own, ONE)
    foreign = F.concat(
        F.lit(r"(?i)(?:FUNCTIONAL\s+TEST\s+PROCEDURE\s+FOR|PROCEDURE\s+FOR\s+CAT\s+ID\s*:)\s*(?!.*(?:"), F.array_join("own", "|"), F.lit("))")
    )
    hit = F.when(F.col("pos") > F.col("start"), F.regexp_instr("body", foreign)).otherwise(0)
    rows = rows.withColumn("_hit", hit)
    share = F.length(strip(F.substring("body", F.lit(1), F.col("_hit") - 1))) / F.greatest(F.length("body"), F.lit(1))
    # at most eight rows per variant
    stop = F.min(F.when(F.col("_hit") > 0, F.col("pos"))).over(Window.partitionBy(*ONE))
    rows = rows.withColumn("_stop", stop).filter(
        F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")) | ((F.col("pos") == F.col("_stop")) & (share > 0.30))
    )
    return rows.select(*ONE, "page_num", (F.col("pos") - F.col("start") + 1).alias("rank"), "is_cutoff")


def _ranked(rows: DataFrame, order: list, limit: int) -> DataFrame:
    w = Window.partitionBy(*ONE).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def merge_narrative(p: Prepared, window: DataFrame) -> DataFrame:
    """Cut-off variants: pages with the variant's functional-test heading first, then the window; each page once, eight in all."""
    cutoff = window.filter("is_cutoff").select(*ONE).distinct()
    name = F.replace(F.upper("variant"), F.lit("_"), F.lit(""))
    headed = p.bodies.filter(F.col("has_image") & rx(F.col("body"), r"FUNCTIONAL\s+TEST\s+PROCEDURE\s+FOR\s"))
    narrative = headed.join(cutoff, "doc_id").filter(F.rlike("body", F.concat(F.lit(r"(?i)FUNCTIONAL\s+TEST\s+PROCEDURE\s+FOR\s+.*"), name)))
    both = narrative.select(*ONE, "page_num", F.lit(0).alias("tier"), F.col("page_num").cast("long").alias("rank")).unionByName(
        window.select(*ONE, "page_num", F.lit(1).alias("tier"), F.col("rank").cast("long"))
    )
    once = both.groupBy(*ONE, "page_num").agg(F.min(F.struct("tier", "rank")).alias("at"))
    return _ranked(once, ["at"], P.PAGE_CAP).select(*ONE, "page_num", "rank")


def page_fallbacks(p: Prepared, targets: DataFrame, small: int = 20) -> DataFrame:
    """Procedure pages per variant as (doc_id, variant, page_num, rank, source).

    A block of at most ``small`` pages: pages with a marker that mention the variant, if there are three. Else the anchor's window with
    narrative pages; without an anchor the first procedure pages; without those any page with a procedure marker.
    """
    tags = p.tags
    size = tags.groupBy("doc_id").agg(F.count("*").alias("_pages"))
    marked = tags.filter("has_image AND (is_procedure OR has_numbered_step)").join(size.filter(F.col("_pages") <= small), "doc_id")
    own = marked.join(p.mentions, PAGE).select(*ONE, "page_num")
    enough = own.groupBy(*ONE).agg(F.count("*").alias("_n")).filter("_n >= 3").select(*ONE)
    w = Window.partitionBy(*ONE).orderBy("page_num")
    first = own.join(enough, ONE, "left_semi").withColumn("rank", F.row_number().over(w)).withColumn("source", F.lit("mentions"))
    rest = targets.select(*ONE).distinct().join(enough, ONE, "left_anti")
    anchors = materialize(anchor_page(p).join(enough, ONE, "left_anti"))
    window = materialize(page_window(p, anchors))
    second = merge_narrative(p, window).withColumn("source", F.lit("anchor"))
    plain = window.filter("NOT is_cutoff").select(*ONE, "page_num", F.col("rank").cast("int").alias("rank"), F.lit("anchor").alias("source"))
    second = second.join(plain.select(*ONE).distinct(), ONE, "left_anti").unionByName(plain)
    lost = rest.join(anchors, ONE, "left_anti")
    # the first eight pages of a document, found once per document
    head = lambda flag: _head(tags.filter(flag))
    third = lost.join(head("has_image AND is_procedure AND NOT is_other_process"), "doc_id").withColumn("source", F.lit("procedure"))
    last = lost.join(third.select("doc_id").distinct(), "doc_id", "left_anti").join(head("has_image AND is_procedure"), "doc_id").withColumn("source", F.lit("marker"))
    cols = [*ONE, "page_num", "rank", "source"]
    return first.select(cols).unionByName(second.select(cols)).unionByName(third.select(cols)).unionByName(last.select(cols))


def _head(pages: DataFrame, limit: int = P.PAGE_CAP) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("page_num")
    return pages.select(*PAGE).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def spec_pages(pages: DataFrame, fallback: int = 6) -> DataFrame:
    """Table pages (the first eight); without any the pages with a spec marker; without those the first pages with an image."""
    tables = _head(score_table_pages(pages).filter("is_table")).withColumn("source", F.lit("table"))
    marked = tag_pages(pages).filter("has_image AND is_spec").join(tables.select("doc_id").distinct(), "doc_id", "left_anti")
    # all of them: the budget is set by their number
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num"))
    marked = marked.select(*PAGE).withColumn("rank", place).withColumn("source", F.lit("marker"))
    seen = tables.select("doc_id").union(marked.select("doc_id")).distinct()
    rest = _head(pages.filter("has_image").join(seen, "doc_id", "left_anti"), fallback).withColumn("source", F.lit("first"))
    return tables.unionByName(marked).unionByName(rest)


def budget_pages(pages: DataFrame, kind: str, chunk: int = P.PAGE_CAP, keys: list[str] = ONE) -> DataFrame:
    """(keys, page_num, rank) cut to the budget of a call and numbered in chunks.

    Specs: up to 8 pages all, up to 20 ten, else twelve. Procedures: up to 10 all, up to 20 twelve, else sixteen.
    """
    whole, some, most = (8, 10, 12) if kind == "spec" else (10, 12, 16)
    total = pages.groupBy(*keys).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("rank")
    top = pages.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    allowed = F.when(F.col("_n") <= whole, F.col("_n")).when(F.col("_n") <= 20, some).otherwise(most)
    cut = top.join(total, keys).filter(F.col("rank") <= allowed)
    return cut.select(*keys, "page_num", "rank", F.floor((F.col("rank") - 1) / F.lit(chunk)).cast("int").alias("chunk_idx"))


def call_pages(procedure: DataFrame, specs: DataFrame) -> DataFrame:
    """Pages of one procedure call: up to three spec pages first where there are at most four procedure pages, eight in all."""
    few = procedure.groupBy(*ONE).agg(F.count("*").alias("_n")).filter("_n <= 4").select(*ONE)
    context = specs.filter("rank <= 3").select("doc_id", "page_num", "rank").join(few, "doc_id").join(procedure.select(*ONE, "page_num"), [*ONE, "page_num"], "left_anti")
    both = context.select(*ONE, "page_num", F.struct(F.lit(0).alias("t"), "rank").alias("at")).unionByName(
        procedure.select(*ONE, "page_num", F.struct(F.lit(1).alias("t"), "rank").alias("at"))
    )
    return _ranked(both, ["at"], P.PAGE_CAP).select(*ONE, "page_num", "rank")
