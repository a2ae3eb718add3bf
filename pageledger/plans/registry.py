"""The list of registered queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageledger.functions.text import LINE_BREAK, SPACE_CHARS
from pageledger.plans.fixtures import fixture, fixture_sql
from pageledger.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Fixtures of one run by name: ``fx.specs`` is the table ``fx_specs``.

    Page fixtures are stored once per run, as the domain tables they stand for would be: text operators read them several times.
    Step fixtures are not: most queries read all their columns once only, and a second look takes few columns.
    """

    STORED = ("pages", "manual", "proc_pages")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.STORED:
            return self.stored(name)
        return self.unstored(name)

    def unstored(self, name: str) -> DataFrame:
        """For queries that read a table's text once: writing it first would cost more than it saves."""
        return fixture(self.spark, self.sf_dir, f"fx_{name}")

    def stored(self, name: str) -> DataFrame:
        key = f"_stored_{name}"
        if key not in self.__dict__:
            self.__dict__[key] = materialize(fixture(self.spark, self.sf_dir, f"fx_{name}"))
        return self.__dict__[key]


def register(name: str, sql: str | None = None, uses: tuple[str, ...] | str = ()):
    """Register ``fn(inputs) -> DataFrame``; ``uses`` names the fixtures the SQL reads."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_fixtures(uses, sql)
        return fn

    return wrap


def with_fixtures(uses: tuple[str, ...] | str, sql: str) -> str:
    names = (uses,) if isinstance(uses, str) else uses
    ctes = [f"fx_{n} AS ({fixture_sql('fx_' + n)})" for n in names]
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {lit(SPACE_CHARS)})"


def sql_lines(x: str) -> str:
    """Lines without the empty one after a final line break."""
    parts = f"string_split_regex({x}, {lit(LINE_BREAK)})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def sql_words(x: str, pattern: str) -> str:
    """Whole word runs of upper-cased text that fully match, in order."""
    return (
        rf"list_filter(regexp_extract_all(upper(replace({x}, 'ß', 'SS')), '[\p{{L}}\p{{N}}_]+'), "
        f"lambda w: regexp_full_match(w, {lit(pattern)}))"
    )


def sql_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"
