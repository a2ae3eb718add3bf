"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule is a boolean column over text features. Its cost (seconds a row) and its selectivity (rows rejected) are measured on a bounded sample; the cascade
asks the rules in the order of rejections per cost, so most bad documents never meet the dear rules. The order decides speed only: a document is kept
if no rule rejects it, whatever the order.

Defined results: null, empty and blank texts have no words, 0 for every feature, and fail ``too_few_words``. Repeated rows are judged each by itself. Other
columns do not matter. An empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pageledger.llm.common import LOWER, SPACE, UPPER, word_array

#: Symbols that count against a text.
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are measured; it decides the order only.
SAMPLE_ROWS = 1_000


def count_chars(c: Column, chars: str) -> Column:
    return F.char_length(c) - F.char_length(F.translate(c, chars, ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _run_hashes(words: Column) -> Column:
    """A hash for each run of three words."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _repeated_places(runs: Column) -> Column:
    """Sorted places of the runs that stand twice or more: those with an equal neighbour among the sorted runs."""
    placed = F.sort_array(F.transform(runs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    twice = let(placed, lambda s: F.filter(s, lambda x, k: x["g"].eqNullSafe(F.get(s, k - 1)["g"]) | x["g"].eqNullSafe(F.get(s, k + 1)["g"])))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words in runs that begin at the places: three each, less where the next one begins earlier."""
    own = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
    return F.aggregate(own, F.lit(0), lambda a, x: a + x)


def _repeat_words() -> Column:
    runs = let(F.col("_words"), _run_hashes)
    return let(runs, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(_repeated_places(g))).otherwise(0))


def _lines() -> Column:
    return F.filter(F.split("_text", "\n", -1), lambda x: F.char_length(F.translate(x, SPACE, "")) > 0)


#: Columns by name, each after those it is made of.
FEATURES = {
    "_text": ((), lambda: F.coalesce("text", F.lit(""))),
    "_words": (("_text",), lambda: word_array(F.col("_text"))),
    "n_words": (("_words",), lambda: F.size("_words")),
    "word_chars": (("_text",), lambda: F.char_length(F.translate("_text", SPACE, ""))),
    "n_symbols": (("_text",), lambda: count_chars(F.col("_text"), SYMBOLS)),
    "n_lines": (("_text",), lambda: F.size(_lines())),
    "n_dup_lines": (("_text",), lambda: let(_lines(), lambda x: F.size(x) - F.size(F.array_distinct(x)))),
    "n_repeat_words": (("_words",), _repeat_words),
    "n_upper": (("_text",), lambda: count_chars(F.col("_text"), UPPER)),
    "n_lower": (("_text",), lambda: count_chars(F.col("_text"), LOWER)),
}
COUNTS = tuple(n for n in FEATURES if not n.startswith("_"))


def needed(names: Iterable[str]) -> list[str]:
    """The names with all they are made of, in order."""
    want = set(names)
    for n in reversed(FEATURES):
        if n in want:
            want.update(FEATURES[n][0])
    return [n for n in FEATURES if n in want]


def add_features(d: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add columns that are not there yet."""
    for n in needed(names):
        if n not in d.columns:
            d = d.withColumn(n, FEATURES[n][1]().cast("long") if n in COUNTS else FEATURES[n][1]())
    return d


def with_features(docs: DataFrame) -> DataFrame:
    """Add all counts as long columns."""
    return add_features(docs.drop(*FEATURES), COUNTS).select(*[c for c in docs.columns if c not in FEATURES], *COUNTS)


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for a document to be dropped; ``base`` marks the rules that everyone agrees on."""

    name: str
    reject: Column
    needs: tuple[str, ...]
    base: bool = False


def rules() -> list[Rule]:
    """Bounds that ordinary prose is far from."""
    n = F.col("n_words")
    return [
        Rule("too_few_words", n < 50, ("n_words",), base=True),
        Rule("repeated_runs", 100 * F.col("n_repeat_words") > 50 * n, ("n_repeat_words", "n_words"), base=True),
        Rule("symbols", 100 * F.col("n_symbols") > 20 * n, ("n_symbols", "n_words")),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 40 * F.col("n_lines"), ("n_dup_lines", "n_lines")),
        Rule("word_length", (2 * F.col("word_chars") < 5 * n) | (F.col("word_chars") > 12 * n), ("word_chars", "n_words")),
        Rule("capitals", 100 * F.col("n_upper") > 60 * (F.col("n_upper") + F.col("n_lower")), ("n_upper", "n_lower")),
    ]


def measured_order(docs: DataFrame, given: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a bounded sample; ties and unused rules keep their place."""
    total = docs.count()
    sample = docs.select("text").sample(fraction=min(1.0, sample_rows / max(total, 1)), seed=11).cache()

    def run(reject: Column, needs: tuple[str, ...]) -> tuple[float, int]:
        start = time.perf_counter()
        n = add_features(sample, needs).agg(F.sum(F.when(reject, 1).otherwise(0))).collect()[0][0] or 0
        return time.perf_counter() - start, n

    try:
        sample.count()
        idle = min(run(F.lit(False), ())[0] for _ in range(2))
        worth = {}
        for r in given:
            seconds, rejected = run(r.reject, r.needs)
            worth[r.name] = rejected / max(seconds - idle, 1e-3)
    finally:
        sample.unpersist()
    return sorted(given, key=lambda r: -worth[r.name])


def cascade(order: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F.when(order[0].reject, order[0].name)
    for r in order[1:]:
        out = out.when(r.reject, r.name)
    return out


def judged(docs: DataFrame, given: list[Rule] | None = None) -> DataFrame:
    """The documents with their features, ``base_failed``, ``failed_rule`` (of the cascade) and ``kept``."""
    given = rules() if given is None else given
    order = measured_order(docs, given)
    base = [r.reject for r in given if r.base]
    failed = F.lit(False)
    for r in base:
        failed = failed | r
    return with_features(docs).withColumn("base_failed", failed).withColumn("failed_rule", cascade(order)).withColumn("kept", F.col("failed_rule").isNull())


def passed(docs: DataFrame, given: list[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects. Each rule's features are computed only for rows that all rules before it let through."""
    d = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    for r in measured_order(docs, rules() if given is None else given):
        # a column that is not deterministic keeps each filter where it is: moved down, it would compute its features again, and before the others
        d = add_features(d, r.needs).withColumn("_stay", F.monotonically_increasing_id()).where(~F.coalesce(r.reject, F.lit(False)) & (F.col("_stay") >= 0))
    return d.select("_row.*")
