"""Benchmark decontamination by templates, with DataFrame functions only.

A text becomes a template: numbers, units after numbers and names (capitalised words inside a sentence) are replaced by typed placeholders, word by word, the rest
is lower-cased and freed of punctuation at word ends. Windows of ``WINDOW`` template words are hash-joined with those of the benchmark. Matches on each
diagonal of a document and an item are gathered; then the words behind the placeholders are compared: a re-parameterised question replaces each value of
the item by one value throughout. Diagonals with consistent slots are taken together with those a few words above, as words put in or left out shift what follows.
Documents that match enough of an item so, or hold a long run of its words as it is, are contaminated. An item without a usable window counts where all its words stand.

Defined results: null and empty texts, and items shorter than ``SHORTEST`` words, match nothing. Rows without doc_id or item_id take no part. Repeated rows with one doc_id or
item_id count as one (any of equal texts, else the last by text), items with equal texts as the one with the smallest item_id. Of several places the one with most windows is reported, then the earlier. Other columns
do not matter. Empty tables give an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageledger.llm.common import WORD
from pageledger.session import materialize

#: Template words of a window, and how many of them must be literal: windows of placeholders say nothing.
WINDOW, LITERAL = 8, 5
#: Share of an item's windows, or of its words by the windows that match, that must match on diagonals no more than ``BAND`` words apart.
COVERAGE, WORD_COVERAGE, BAND = 0.5, 0.6, WINDOW
#: So many equal words in a row count by themselves. Shorter items than ``SHORTEST`` words are common phrases.
VERBATIM, SHORTEST = 20, 3

NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
UNITS = (
    "km", "cm", "mm", "kg", "mg", "ml", "kilometers", "kilometres", "miles", "meters", "metres", "feet", "inches", "grams", "kilograms", "pounds", "liters", "litres", "gallons",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "cents", "euros", "percent", "degrees", "kwh", "mph",
)
# Each begins with a look at one character that most places fail: a look behind at every character takes longer.
NUMBER_PATTERN = r"(?=[0-9])(?<![\p{L}\p{N}.,])[0-9]+(?:[.,:][0-9]+)*(?![\p{L}\p{N}])"
UNIT_PATTERN = r"(?i)(<num> )(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
NAME_PATTERN = r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;>] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
TRIM_PATTERN = (
    r"(?![a-z0-9 ])(?:(?<=[\p{L}\p{N}>])[^\p{L}\p{N}<>\x20\x09-\x0D]++(?=[\x20\x09-\x0D]|$)|(?<=[\x20\x09-\x0D]|^)[^\p{L}\p{N}<>\x20\x09-\x0D]++(?=[\p{L}\p{N}<]))"
)


def template(text: Column) -> Column:
    """The text with placeholders; it has as many words as before, so places in both agree."""
    out = F.regexp_replace(text, NAME_PATTERN, NAME)
    out = F.regexp_replace(out, NUMBER_PATTERN, NUMBER)
    out = F.regexp_replace(out, UNIT_PATTERN, f"$1{UNIT}")
    return F.regexp_replace(F.lower(out), TRIM_PATTERN, "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]+", "")


def windows(rows: DataFrame, key: str) -> DataFrame:
    """``key, pos, h`` for every window of a text with enough literal words.

    Words are hashed once and windows take hashes by their place: a slice of an array copies the whole array first, once for each window.
    """
    # never null, and exploded with "outer": else the optimizer filters nulls and empty arrays first and makes the template twice
    w = rows.select(key, words(template(F.coalesce("text", F.lit("")))).alias("w"))
    t = w.select(key, F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("w", lambda x: F.startswith(x, F.lit("<")).cast("int")).alias("signs"))
    placed = t.select(key, "hashes", "signs", F.posexplode_outer("signs").alias("pos", "sign")).where(F.col("pos") + WINDOW <= F.size("signs"))
    at = lambda name: [F.get(name, F.col("pos") + k) for k in range(WINDOW)]
    return placed.where(reduce(lambda a, b: a + b, at("signs")) <= WINDOW - LITERAL).select(key, "pos", F.xxhash64(*at("hashes")).alias("h"))


def one_row_each(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("text").alias("text"))


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, text``: items with the same text count as the one with the smallest item_id, so copies in the benchmark do not multiply matches."""
    return one_row_each(benchmark.select("item_id", "text"), "item_id").groupBy("text").agg(F.min("item_id").alias("item_id"))


def matches(docs: DataFrame, own: DataFrame) -> DataFrame:
    """``doc_id, item_id, diag, at, item_windows``: places of an item's windows on each diagonal of a document and the item."""
    total = own.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    found = windows(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id").join(own, "h")
    by_diagonal = found.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diag")).agg(F.sort_array(F.collect_set("item_pos")).alias("at"))
    return by_diagonal.join(total, "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, first_word, n_windows, item_windows, n_slots, verbatim``: documents that hold an item, as it is or with other numbers, names or units."""
    # of equal windows of an item the first counts, so each window of a document meets an item once
    own = materialize(windows(distinct_items(benchmark), "item_id").groupBy("item_id", "h").agg(F.min("pos").alias("item_pos")))
    found = materialize(matches(docs, own))
    items = materialize(distinct_items(benchmark).select("item_id", words(F.col("text")).alias("item_raw"), words(template(F.col("text"))).alias("item_w")))
    # a pair whose windows cannot cover enough, all diagonals taken together, needs no texts
    sums = found.join(items.select("item_id", F.size("item_w").alias("n")), "item_id").groupBy("doc_id", "item_id").agg(
        F.sum(F.size("at")).alias("s"), F.max("item_windows").alias("m"), F.max("n").alias("n"), F.max(F.element_at("at", -1) - F.get("at", 0)).alias("longest")
    )
    enough = (F.col("s") >= COVERAGE * F.col("m")) | (WINDOW * F.col("s") >= WORD_COVERAGE * F.col("n")) | (F.col("longest") + WINDOW >= VERBATIM)
    found = materialize(found.join(sums.where(enough).select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi"))
    texts = one_row_each(docs.select("doc_id", "text").join(found.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    # stored, else the words are made anew for each diagonal
    texts = materialize(texts.select("doc_id", words(F.col("text")).alias("raw"), words(template(F.col("text"))).alias("w")))

    def words_on(p: Column) -> Column:
        lo = F.get(p["at"], 0)
        size = F.element_at(p["at"], -1) - lo + WINDOW
        z = F.arrays_zip(
            F.slice("item_raw", lo + 1, size).alias("i"), F.slice("item_w", lo + 1, size).alias("iw"),
            F.slice("raw", lo + p["diag"] + 1, size).alias("d"), F.slice("w", lo + p["diag"] + 1, size).alias("dw"),
        )
        return F.struct(p["diag"].alias("diag"), p["at"].alias("at"), z.alias("z"))

    # both texts come once for all diagonals
    by_pair = found.groupBy("doc_id", "item_id", "item_windows").agg(F.collect_list(F.struct("diag", "at")).alias("parts"))
    aligned = by_pair.join(items, "item_id").join(texts, "doc_id").select("doc_id", "item_id", "item_windows", F.size("item_w").alias("item_words"), F.explode(F.transform("parts", words_on)).alias("p"))
    aligned = aligned.select("doc_id", "item_id", "item_windows", "item_words", "p.*")
    slots = F.transform(F.filter("z", lambda s: is_slot(s["iw"]) & (s["iw"] == s["dw"])), lambda s: F.struct(s["iw"].alias("kind"), bare(s["i"]).alias("item"), bare(s["d"]).alias("doc")))
    # one sign for each word: a run of equal words counts by itself
    signs = F.array_join(F.transform("z", lambda s: F.when(bare(s["i"]) == bare(s["d"]), "=").otherwise("x")), "")
    out = aligned.withColumn("slots", slots).withColumn("run", F.contains(signs, F.lit("=" * VERBATIM)))
    sources = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item"]))))
    fits = out.withColumn("fits", F.size(F.array_distinct("slots")) == sources).where("fits OR run").drop("z")
    # what fits on a diagonal and on the next ones above it
    band = Window.partitionBy("doc_id", "item_id").orderBy("diag").rangeBetween(0, BAND)
    part = F.struct("diag", "at", "slots")
    banded = fits.withColumn("parts", F.collect_list(F.when(F.col("fits"), part)).over(band)).withColumn("parts", F.when(F.col("fits"), F.col("parts")).otherwise(F.array(part)))
    all_at = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["at"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + (WINDOW - 1))))))
    counted = banded.withColumn("at", all_at).select(
        "doc_id", "item_id", "run", "item_windows", "item_words", F.size("at").cast("long").alias("n_windows"), covered.alias("covered"), F.flatten(F.transform("parts", lambda p: p["slots"])).alias("slots"),
        F.array_min(F.transform("parts", lambda p: F.get(p["at"], 0) + p["diag"])).cast("long").alias("first_word"),
    )
    holds = counted.where(F.col("run") | (F.col("n_windows") >= COVERAGE * F.col("item_windows")) | (F.col("covered") >= WORD_COVERAGE * F.col("item_words")))
    best = F.max(F.struct("n_windows", (-F.col("first_word")).alias("o"), "first_word", "item_windows", "slots")).alias("m")
    return holds.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*").select(
        "doc_id", "item_id", "first_word", "n_windows", "item_windows", F.size("slots").cast("long").alias("n_slots"), F.forall("slots", lambda s: s["item"] == s["doc"]).alias("verbatim"),
    ).unionByName(whole_items(docs, benchmark, own))


def plain(text: Column) -> Column:
    """Lower-cased words, freed of punctuation at their ends."""
    return words(F.regexp_replace(F.lower(text), TRIM_PATTERN, ""))


def whole_items(docs: DataFrame, benchmark: DataFrame, own: DataFrame) -> DataFrame:
    """The same rows for items without a usable window, which count where all their words stand one after another."""
    rest = distinct_items(benchmark).join(own.select("item_id").distinct(), "item_id", "left_anti").select("item_id", plain(F.col("text")).alias("item"))
    rest = materialize(rest.where(F.size("item") >= SHORTEST).withColumn("n", F.least(F.size("item"), F.lit(WINDOW))).withColumn("h", F.xxhash64("n", F.transform(F.slice("item", 1, F.col("n")), lambda x: F.xxhash64(x)))))
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.transform(plain(F.coalesce("text", F.lit(""))), lambda x: F.xxhash64(x)).alias("hashes"))
    # at most WINDOW lengths; without such items no text is read
    lengths = sorted(r.n for r in rest.select("n").distinct().collect())

    def starts_of(n: int) -> Column:
        places = F.when(F.size("hashes") >= n, F.sequence(F.lit(0), F.size("hashes") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(n), F.array(*[F.get("hashes", i + k) for k in range(n)])).alias("h")))

    empty = "doc_id LONG, item_id LONG, first_word LONG, n_windows LONG, item_windows LONG, n_slots LONG, verbatim BOOLEAN"
    if not lengths:
        return docs.sparkSession.createDataFrame([], empty)
    starts = rows.select("doc_id", F.explode(F.concat(*[starts_of(n) for n in lengths])).alias("x")).select("doc_id", "x.pos", "x.h").join(rest.select("item_id", "item", "h"), "h")
    texts = one_row_each(docs.select("doc_id", "text"), "doc_id").select("doc_id", plain(F.col("text")).alias("w"))
    held = starts.join(texts, "doc_id").where(F.slice("w", F.col("pos") + 1, F.size("item")) == F.col("item"))
    one = F.lit(1).cast("long")
    return held.groupBy("doc_id", "item_id").agg(F.min("pos").cast("long").alias("first_word")).select(
        "doc_id", "item_id", "first_word", one.alias("n_windows"), one.alias("item_windows"), F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("verbatim")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
