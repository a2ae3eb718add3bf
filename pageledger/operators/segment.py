"""Sections of a document.

A block is never one big string. It is a row of ``blocks`` plus the lines that carry its number, so a block of any length stays
spread over tasks. Offsets count characters of the trimmed lines with one line break each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import rx, rx_if, split_lines, strip
from pageledger.operators import text as T
from pageledger.operators.ordered import following, previous, running_last, running_max, running_sum, width_for, with_running
from pageledger.operators.splits import reached, successors
from pageledger.session import materialize

DOC = ["doc_id"]
BLOCK = ["doc_id", "block_idx"]
RECENT = 200


def _first_heading(line: Column) -> Column:
    """Number of the first heading pattern that matches, NULL without one."""
    out = F.when(rx(line, P.SECTION_PATTERNS[0]), 1)
    for i, p in enumerate(P.SECTION_PATTERNS[1:], 2):
        out = out.when(rx(line, p), i)
    return out


def _heading_text(line: Column, number: Column) -> Column:
    out = F.when(number == 1, F.regexp_extract(line, f"(?i){P.SECTION_PATTERNS[0]}", 0))
    for i, p in enumerate(P.SECTION_PATTERNS[1:], 2):
        out = out.when(number == i, F.regexp_extract(line, f"(?i){p}", 0))
    return out


def tag_section_lines(lines: DataFrame) -> DataFrame:
    """Lines that look like section headings: pattern number, matched text and whether they always split."""
    # every pattern needs one of these words: nearly all lines end here
    line, words = F.col("line"), ("TESTING", "PROCE", "PRODUCT", "FUNCTIONAL", "NEUTRAL", "DMS", "MG")
    heads = lines.filter(rx_if(line, F.upper(line), words, r"testing|process|procedure|product|functional|^neutral|^dms\d|^mg\d", "dfmnpt"))
    numbered = heads.withColumn("pattern_no", _first_heading(F.col("line")))
    forced = rx(F.col("line"), "|".join(f"(?:{p})" for p in P.FORCE_SPLIT_PATTERNS))
    numbered = numbered.filter("pattern_no IS NOT NULL")
    return numbered.withColumns({"header": _heading_text(F.col("line"), F.col("pattern_no")), "is_forced": forced})


def line_offsets(pages: DataFrame) -> DataFrame:
    """Non-blank lines with the character offsets ``o`` and ``e`` of their start and end in the document.

    Blank lines count one character. Within a page the sum runs over that page's lines; pages are chained by a chunked running sum. What needs the neighbours' text is told here, where a page's
    lines are together: ``prev_e``, the end of the page's line before, ``nth``, the place among the page's lines, ``is_table`` and ``spec`` (see ``_spec_bits``). So no text is dealt out again for it.
    """
    trimmed = F.transform(split_lines(F.col("text")), strip)
    # a page of no text has no line
    listed = F.when(F.length("text") > 0, trimmed).otherwise(F.array().cast("array<string>"))
    size = F.aggregate(listed, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x) + 1)
    placed = with_running(pages.select("doc_id", "page_num", listed.alias("_lines"), size.alias("_size")), DOC, "page_num", _start=running_sum(F.col("_size"), inclusive=False))
    lines = placed.select("doc_id", "page_num", "_start", F.posexplode("_lines").alias("pos", "line"))
    w = Window.partitionBy("doc_id", "page_num").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))
    lines = lines.withColumn("o", F.col("_start") + before).withColumn("e", F.col("o") + F.length("line")).filter("line <> ''")
    w = Window.partitionBy("doc_id", "page_num").orderBy("pos")
    near = lines.withColumns({"prev_e": F.lag("e").over(w), "nth": F.row_number().over(w), "_l1": F.lead("line", 1).over(w), "_l2": F.lead("line", 2).over(w)})
    is_table = _starts(F.concat_ws("\n", "line", "_l1", "_l2"), P.TABLE_STRUCTURE, "TABLE")
    return near.select("doc_id", "page_num", (F.col("pos") + 1).alias("line_no"), "line", "o", "e", "prev_e", "nth", is_table.alias("is_table"), _spec_bits().alias("spec"))


SETTINGS, MARKER, SPAN = r"TABLE\s*\d?\s*\(PRODUCT\s*SETTINGS", r"Under\s*Voltage\s*\(UV\)", r"\d+\s+to\s+\d+\s+VAC"


def _spec_bits() -> Column:
    """Table-spec markers that begin in a line, three bits each for the line alone, with the next one and with the next two: a marker may be broken over lines, but not over the end of a block.

    The bits stand for a table spec, an under-voltage marker and a voltage range.
    """
    bits = F.lit(0)
    for k, others in enumerate(((), ("_l1",), ("_l1", "_l2"))):
        c = F.concat_ws("\n", "line", *others)
        for i, found in enumerate((_starts(c, SETTINGS, "TABLE") | _starts(c, rf"{MARKER}[^\n]*?{SPAN}", "VOLTAGE"), _starts(c, MARKER, "VOLTAGE"), _starts(c, SPAN, "VAC"))):
            bits = bits + F.when(found, 1 << (3 * k + i)).otherwise(0)
    return bits


def _starts(ctx: Column, pattern: str, word: str) -> Column:
    """The marker begins in the first line of the context. Without ``word`` (in capitals) there is none."""
    return F.contains(F.upper(ctx), F.lit(word)) & ctx.rlike(rf"(?i)^[^\n]*?(?:{pattern})")


def _recent_text(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, o, recent): the last 200 characters before each heading.

    Lines meet headings by equal 256-character stretch, so a heading looks at no more than two stretches. A line that can have no part in a dangling reference is sent as a dot.
    """
    stretch = lambda c: F.floor(c / 256).cast("long")
    near = heads.select("doc_id", "o", F.explode(F.array(stretch(F.col("o") - 1), stretch(F.col("o") - 1) - 1)).alias("s"))
    ends = lines.select("doc_id", F.col("e").alias("_e"), F.when(F.upper("line").rlike(P.DANGLING_PART), F.right("line", F.lit(RECENT))).otherwise(".").alias("_line"), stretch(F.col("e")).alias("s"))
    rows = near.join(ends, ["doc_id", "s"]).filter((F.col("_e") < F.col("o")) & (F.col("_e") > F.col("o") - RECENT))
    part = F.right("_line", (F.col("_e") - (F.col("o") - RECENT)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("_e", part.alias("t"))))
    return rows.groupBy("doc_id", "o").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("recent"))


def split_candidates(lines: DataFrame) -> DataFrame:
    """Heading lines with all that decides a split: end of the line before (``prev_e``), dangling reference in the text before, and the offset
    of the last table structure before them."""
    heads = materialize(tag_section_lines(lines).select("doc_id", "o", "page_num", "line_no", "header", "is_forced", "prev_e"))
    recent = _recent_text(heads, lines)
    tables = lines.filter("is_table").select("doc_id", "o", F.col("o").alias("_table"), F.lit(None).cast("string").alias("header"))
    # before the first line of a page stands the last line of the page before that has one
    ends = lines.groupBy("doc_id", "page_num").agg(F.max("e").alias("_end"))
    ends = with_running(ends, DOC, "page_num", _before=previous(F.col("_end"))).select("doc_id", "page_num", "_before")
    # only headings and structure lines are put in order here, both rare
    both = heads.select("doc_id", "o", F.lit(None).cast("long").alias("_table"), "header").unionByName(tables)
    both = both.groupBy("doc_id", "o").agg(F.max("_table").alias("_table"), F.max("header").alias("header"))
    last = with_running(both, DOC, "o", last_table=running_max(F.col("_table"), inclusive=False)).filter("header IS NOT NULL")
    dangling = rx(F.upper("recent"), P.DANGLING_REFERENCE)
    return (
        heads.join(ends, ["doc_id", "page_num"]).withColumn("prev_e", F.coalesce("prev_e", "_before")).drop("_before").join(last.select("doc_id", "o", "last_table"), ["doc_id", "o"]).join(recent, ["doc_id", "o"], "left")
        .withColumn("dangling", F.coalesce(dangling, F.lit(False))).drop("recent")
    )


def segment_blocks(pages: DataFrame, min_size: int = P.MIN_BLOCK_SIZE) -> tuple[DataFrame, DataFrame]:
    """(blocks, block_lines).

    A heading starts a block when the current one is empty, or always for some headings, or when the current one has more than ``min_size``
    characters and no dangling table reference. So a heading splits any block that began no later than some place: the end of the line before it less ``min_size``, for a dangling one no
    later than the last table before it either. Each beginning has the first heading that splits it as its successor; blocks begin at what the first line and the headings that
    always split lead to. Only headings and their numbers take part, never text.
    """
    # parsed once, then read by every step below
    lines = materialize(line_offsets(pages))
    first = lines.groupBy("doc_id").agg(F.min("o").alias("first_o"))
    candidates = materialize(split_candidates(lines))
    reach = F.col("prev_e") - min_size - 1
    reach = F.when(F.col("is_forced"), F.col("o") - 1).when(F.col("dangling"), F.when(F.col("last_table").isNotNull(), F.least(reach, "last_table"))).otherwise(reach)
    begins = candidates.select("doc_id", F.col("o").alias("at"), F.col("is_forced").alias("marked")).unionByName(first.select("doc_id", F.col("first_o").alias("at"), F.lit(True).alias("marked")))
    begins = begins.groupBy("doc_id", "at").agg(F.bool_or("marked").alias("marked"))
    graph = successors(begins, candidates.select("doc_id", reach.alias("reach"), F.col("o").alias("place")), DOC).join(begins, ["doc_id", "at"])
    accepted = reached(graph, DOC).withColumnRenamed("at", "o").join(candidates.select("doc_id", "o"), ["doc_id", "o"], "left_semi").withColumn("_split", F.lit(1))
    # a block begins at its heading, the first one of a document at the first line; beginnings and lines are put in one order, and each line is told the number of beginnings so far
    starts = accepted.select("doc_id", "o").unionByName(first.select("doc_id", F.col("first_o").alias("o"))).distinct()
    own = [c for c in lines.columns if c not in ("doc_id", "o")]
    placed = lines.select("doc_id", "o", (2 * F.col("o") + 1).alias("_pos"), F.lit(0).alias("_is_start"), *own)
    placed = placed.unionByName(starts.select("doc_id", "o", (2 * F.col("o")).alias("_pos"), F.lit(1).alias("_is_start")), allowMissingColumns=True)
    numbered = with_running(placed, DOC, "_pos", block_idx=running_sum(F.col("_is_start"))).withColumn("block_idx", F.col("block_idx").cast("int"))
    block_lines = numbered.filter("_is_start = 0").select(*BLOCK, "page_num", "line_no", "line", "o", "e", "nth", "spec")
    heads = candidates.select("doc_id", "o", "header").join(accepted.select("doc_id", "o"), ["doc_id", "o"], "left_semi")
    starts = with_running(starts, DOC, "o", block_idx=running_sum(F.lit(1))).withColumn("block_idx", F.col("block_idx").cast("int")).join(heads, ["doc_id", "o"], "left")
    total = pages.groupBy("doc_id").agg(F.sum(_text_size()).alias("_total"))
    starts = with_running(starts, DOC, "o", _next=following(F.col("o"))).join(total, DOC)
    # the first block also holds blank lines before its first line, unless a heading opens it
    begin = F.when((F.col("block_idx") == 1) & F.col("header").isNull(), F.lit(0)).otherwise(F.col("o"))
    sized = starts.select(*BLOCK, F.col("o").alias("start_o"), F.coalesce("header", F.lit("")).alias("header"), (F.coalesce("_next", "_total") - begin).alias("n_chars"))
    sized = materialize(sized)  # names read it several times
    label = F.concat(F.lit("MACHINE_"), F.col("block_idx").cast("string"))
    names = T.dominant_name(sized.select(*BLOCK, F.lit(0).alias("page_num"), F.col("header").alias("text")), label, BLOCK)
    return sized.join(names, BLOCK), block_lines


def _text_size() -> Column:
    listed = F.when(F.length("text") > 0, F.transform(split_lines(F.col("text")), strip)).otherwise(F.array().cast("array<string>"))
    return F.aggregate(listed, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x) + 1)


def block_pages(pages: DataFrame, block_lines: DataFrame) -> DataFrame:
    """Pages of each block. A page also belongs to the block that was open when it began."""
    own = block_lines.select(*BLOCK, "page_num").distinct()
    ends = block_lines.groupBy("doc_id", "page_num").agg(F.max("block_idx").alias("_last"))
    opened = with_running(pages.select("doc_id", "page_num").join(ends, ["doc_id", "page_num"], "left"), DOC, "page_num", block_idx=running_max(F.col("_last"), inclusive=False))
    return own.unionByName(opened.filter("block_idx IS NOT NULL").select(*BLOCK, "page_num")).distinct()


def table_spec_blocks(block_lines: DataFrame) -> DataFrame:
    """Blocks with a product-settings table, or an under-voltage marker followed by a voltage range. Reads the bits of ``line_offsets``, no text."""
    lines_left = F.max("nth").over(Window.partitionBy("doc_id", "page_num", "block_idx")) - F.col("nth")
    marked = block_lines.select(*BLOCK, "page_num", "o", "spec", F.least(lines_left, F.lit(2)).alias("_more")).filter("spec <> 0")
    found = lambda i: F.get(F.array(*[F.col("spec").bitwiseAND(1 << (3 * k + i)) != 0 for k in range(3)]), F.col("_more"))
    facts = marked.groupBy(*BLOCK).agg(
        F.bool_or(found(0)).alias("_here"), F.min(F.when(found(1), F.col("o"))).alias("_uv"), F.max(F.when(found(2), F.col("o"))).alias("_span")
    )
    return facts.filter(F.col("_here") | (F.col("_span") > F.col("_uv"))).select(*BLOCK)


def merge_short_blocks(blocks: DataFrame, with_spec: DataFrame, min_size: int = P.MIN_MERGE_SIZE) -> DataFrame:
    """(doc_id, block_idx, merged_idx): a short block without a table spec absorbs the next one; both are then done.

    In a row of short blocks every second one is absorbed by the one before it, so the position in the row decides.
    """
    b = blocks.join(with_spec.withColumn("_spec", F.lit(True)), BLOCK, "left")
    short = (F.col("n_chars") < min_size) & F.col("_spec").isNull()
    b = b.withColumn("_short", short).select(*BLOCK, "_short")
    near = with_running(
        b, DOC, "block_idx", _prev=previous(F.col("_short")), _next=following(F.lit(True)),
        _other=running_last(F.when(~F.col("_short"), F.col("block_idx")), inclusive=False),
    )
    place = F.col("block_idx") - F.coalesce("_other", F.lit(0))
    absorbed = F.coalesce("_prev", F.lit(False)) & ((place - 1) % 2 == 1)
    kept = near.withColumn("_kept", (~absorbed).cast("int"))
    return with_running(kept, DOC, "block_idx", merged_idx=running_sum(F.col("_kept"))).select(*BLOCK, F.col("merged_idx").cast("int").alias("merged_idx"))


def merged_blocks(blocks: DataFrame, merge: DataFrame) -> DataFrame:
    """Blocks after merging: name and heading of the first part, sizes added."""
    b = blocks.join(merge, BLOCK)
    first = F.min_by(F.struct("machine", "header", "start_o"), "block_idx")
    return b.groupBy("doc_id", F.col("merged_idx").alias("block_idx")).agg(first.alias("f"), F.sum("n_chars").alias("n_chars")).select(*BLOCK, "f.*", "n_chars")


def resolve_names(blocks: DataFrame, block_lines: DataFrame) -> DataFrame:
    """Placeholder names replaced by the dominant name of the block's text, if it has one."""
    open_ = blocks.filter(F.startswith("machine", F.lit("MACHINE_"))).select(*BLOCK)
    text = block_lines.join(open_, BLOCK, "left_semi").select(*BLOCK, F.col("o").alias("page_num"), F.col("line").alias("text"))
    found = T.dominant_name(text, F.lit(None).cast("string"), BLOCK).withColumnRenamed("machine", "_name")
    return blocks.join(found, BLOCK, "left").withColumn("machine", F.coalesce("_name", "machine")).select(*blocks.columns)


def dedupe_names(blocks: DataFrame) -> DataFrame:
    """The k-th repeat of a name gets the suffix _k."""
    counted = with_running(blocks, ["doc_id", "machine"], "block_idx", _k=running_sum(F.lit(1)))
    name = F.when(F.col("_k") > 1, F.concat("machine", F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col("machine"))
    return counted.withColumn("machine", name).select(*blocks.columns)


def filter_merge_requested(blocks: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested blocks as (doc_id, block_idx, machine, request_no): blocks of one name share a request number and keep their order, so the
    merged block is the union of their lines and pages."""
    wanted = requested.select("doc_id", F.upper("machine").alias("machine"), "request_no")
    return blocks.withColumn("machine", F.upper("machine")).join(wanted, ["doc_id", "machine"]).select(*BLOCK, "machine", "request_no")


def merged_summary(kept: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per requested name: first block, number of blocks and of distinct pages."""
    counts = kept.join(pages, BLOCK).select("doc_id", "machine", "page_num").distinct().groupBy("doc_id", "machine").agg(F.count("*").alias("n_pages"))
    blocks = kept.groupBy("doc_id", "machine", "request_no").agg(F.min("block_idx").alias("first_block"), F.count("*").alias("n_blocks"))
    return blocks.join(counts, ["doc_id", "machine"])


def scope_fanout(pages: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Two or more scope members: one block per member, each standing for all pages of the document (pages are referred to, not copied)."""
    members = T.scope_members(pages)
    several = members.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n >= 2").select("doc_id")
    blocks = members.join(several, "doc_id", "left_semi").select(
        "doc_id", F.col("member_no").alias("block_idx"), F.col("member").alias("machine"), F.lit(True).alias("is_scope")
    )
    if requested is None:
        return blocks
    named = requested.select("doc_id", F.upper("machine").alias("machine")).distinct().withColumn("_want", F.lit(True))
    asked = requested.select("doc_id").distinct().withColumn("_asked", F.lit(True))
    kept = blocks.join(named, ["doc_id", "machine"], "left").join(asked, "doc_id", "left").filter("_asked IS NULL OR _want")
    return kept.select(*blocks.columns)


def density_split(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, group_no): a new group where a page has two or more variants, other ones than the group so far, and the group has
    two pages.

    Pages with two or more variants are anchors (so is the first page); the pages from one anchor to the next are a stretch. Once a group's variants equal those of an anchor, they
    go on as if the group had begun there. So the next group begins at the next anchor that differs from the stretch before it. Only if an anchor stands right after the group's first
    page, where no group can begin, the anchor after that is compared with both stretches. Stretches are compared by counting, as rows of (stretch, variant); no
    document or group is ever one row.
    """
    found = materialize(T.detect_variants(pages, ["doc_id", "page_num"]).select("doc_id", "page_num", "variant"))
    many = found.groupBy("doc_id", "page_num").agg((F.count("*") >= 2).alias("_many"))
    numbered = with_running(pages.select("doc_id", "page_num"), DOC, "page_num", n=running_sum(F.lit(1)))
    numbered = numbered.join(many, ["doc_id", "page_num"], "left")
    anchor = ((F.col("n") == 1) | F.coalesce("_many", F.lit(False))).cast("int")
    placed = materialize(with_running(numbered.withColumn("_anchor", anchor), DOC, "page_num", k=running_sum(F.col("_anchor"))).drop("_many"))
    held = found.join(placed, ["doc_id", "page_num"])
    # what an anchor holds, beside what the stretch before it and the one before that hold
    sides = F.array(
        F.struct((F.col("k") + 1).alias("k"), F.lit(1).alias("side")), F.struct((F.col("k") + 2).alias("k"), F.lit(2).alias("side")),
        F.when(F.col("_anchor") == 1, F.struct(F.col("k").alias("k"), F.lit(0).alias("side"))),
    )
    seen = held.select("doc_id", "variant", F.explode(sides).alias("s")).where("s IS NOT NULL").groupBy("doc_id", "s.k", "variant")
    seen = seen.agg(*[F.bool_or(F.col("s.side") == i).alias(n) for i, n in enumerate(("_own", "_one", "_two"))])
    differs = seen.groupBy("doc_id", "k").agg(F.bool_or(F.col("_own") != F.col("_one")).alias("_other"), F.bool_or(F.col("_own") != (F.col("_one") | F.col("_two"))).alias("_other_two"))
    anchors = placed.where("_anchor = 1").select("doc_id", "k", "n").join(differs, ["doc_id", "k"], "left").withColumn("_back", -F.col("k"))
    # in falling order "last" is the next one
    other = F.when((F.col("k") > 1) & F.col("_other"), F.col("n"))
    width = width_for(anchors, DOC, "_back")
    ahead = with_running(anchors, DOC, "_back", width=width, _n1=previous(F.col("n")), _change=running_last(other, inclusive=False), _two=previous(F.col("_other_two")))
    ahead = with_running(ahead, DOC, "_back", width=width, _n2=previous(F.col("_n1")), _two2=previous(F.col("_two")), _change2=previous(F.col("_change")))
    ahead = with_running(ahead, DOC, "_back", width=width, _change3=previous(F.col("_change2")))
    close = F.col("_n1") == F.col("n") + 1
    # without the anchor right behind: the next one, if it differs from both stretches, else the next change after it
    following_ = F.when(close, F.when(F.col("_two2"), F.col("_n2")).otherwise(F.col("_change3"))).otherwise(F.col("_change"))
    graph = ahead.select("doc_id", F.col("n").alias("at"), following_.alias("next"), (F.col("n") == 1).alias("marked"))
    starts = reached(graph, DOC).select("doc_id", F.col("at").alias("n"), F.lit(1).alias("_s"))
    opened = placed.join(starts, ["doc_id", "n"], "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    out = with_running(opened, DOC, "page_num", group_no=running_sum(F.col("_s")))
    return out.select("doc_id", "page_num", F.col("group_no").cast("int").alias("group_no"))


def select_variants(blocks: DataFrame, detected: DataFrame, requested: DataFrame, present: DataFrame, max_blocks: int = 5) -> DataFrame:
    """(doc_id, block_idx, machine, variant, source): what to extract from each block.

    A scope block stands for itself. Else requested variants present in the text, else detected ones, else the machine. A repeated machine
    is skipped; without a request only the first ``max_blocks`` blocks count. ``requested(doc_id, machine, variant)`` (variant may be NULL),
    ``present(doc_id, block_idx, variant)``: requested variants found, ``detected(doc_id, block_idx, variant, rank)``.
    """
    asked = requested.select("doc_id").distinct().withColumn("_asked", F.lit(True))
    wanted = requested.select("doc_id", "machine").distinct().withColumn("_want", F.lit(True))
    order = with_running(blocks, DOC, "block_idx", _no=running_sum(F.lit(1)))
    open_ = order.join(asked, "doc_id", "left").join(wanted, ["doc_id", "machine"], "left")
    open_ = open_.filter(F.col("_want") | (F.col("_asked").isNull() & (F.col("_no") <= max_blocks)))
    first = open_.groupBy("doc_id", "machine").agg(F.min(F.struct("block_idx", "is_scope")).alias("b")).select("doc_id", "machine", "b.*")
    by_scope = first.filter("is_scope").select(*BLOCK, "machine", F.col("machine").alias("variant"), F.lit(1).alias("tier"))
    plain = first.filter("NOT is_scope").select(*BLOCK, "machine")
    named = requested.filter("variant IS NOT NULL").select("doc_id", "machine", "variant").distinct()
    by_request = plain.join(named, ["doc_id", "machine"]).join(present, [*BLOCK, "variant"], "left_semi").select(*BLOCK, "machine", "variant", F.lit(2).alias("tier"))
    seen = detected.filter(F.col("variant").rlike("^[A-Z0-9][A-Z0-9_]*$") & (F.length("variant") >= 3) & F.col("variant").rlike("[A-Z]"))
    by_detection = plain.join(seen.select(*BLOCK, "variant"), BLOCK).filter("variant <> machine").select(*BLOCK, "machine", "variant", F.lit(3).alias("tier"))
    itself = plain.select(*BLOCK, "machine", F.upper("machine").alias("variant"), F.lit(4).alias("tier"))
    every = by_scope.unionByName(by_request).unionByName(by_detection).unionByName(itself)
    best = every.groupBy(*BLOCK).agg(F.min("tier").alias("tier"))
    source = F.get(F.array(*[F.lit(x) for x in ("scope", "request", "detected", "machine")]), F.col("tier") - 1)
    return every.join(best, [*BLOCK, "tier"], "left_semi").select(*BLOCK, "machine", "variant", source.alias("source"))
