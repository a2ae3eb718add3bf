"""Replay of stored table replies: parse, check, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pageledger.functions import patterns as P
from pageledger.operators import families as FA


@dataclass
class Replay:
    tables: DataFrame
    rows: DataFrame
    flags: DataFrame
    checks: DataFrame
    status: DataFrame


def check_tables(tables: DataFrame, rows: DataFrame, families: DataFrame, malformed: DataFrame | None = None) -> Replay:
    """All integrity checks on raw ``tables`` and ``rows``; ``families(family, title_submachines, external)``. A table with a malformed row
    (flags of ``families.malformed``) is unverified."""
    parsed, fitted, pad_flags = FA.parse_tables(tables, rows)
    if malformed is not None:
        short = malformed.filter("rule_id = 'malformed_row'").select(*FA.TABLE).distinct().withColumn("_short", F.lit(True))
        kind = F.when(F.col("_short") & (F.col("kind") == "spec"), "unverified").otherwise(F.col("kind"))
        parsed = parsed.join(short, FA.TABLE, "left").withColumn("kind", kind).drop("_short")
        pad_flags = pad_flags.unionByName(malformed)
    torn = FA.torn_rows(tables, rows)
    checked, header_flags = FA.check_headers(parsed)
    votes, vote_flags = FA.prefix_vote(checked, families)
    infos = FA.coverage_flags(FA.title_coverage(checked, families))
    flags = pad_flags.unionByName(torn).unionByName(header_flags).unionByName(vote_flags).unionByName(infos)
    checks = FA.family_checks(checked, votes)
    return Replay(checked, fitted, flags, checks, FA.family_status(checks, flags))


def replay(replies: DataFrame, meta: DataFrame) -> Replay:
    """From ``replies(family, body)`` and ``meta(family, label, title_submachines, external)`` to the checked tables."""
    parsed = FA.parse_replies(replies)
    families = FA.family_meta(parsed, meta)
    broken = parsed.filter(~(F.col("readable") & F.col("is_object"))).select("family", "readable")
    done = check_tables(FA.raw_tables(parsed), FA.raw_rows(parsed), families.join(broken, "family", "left_anti"), FA.malformed(parsed))
    none = F.array().cast("array<string>")
    unread = broken.select(
        "family", F.array(F.lit(P.ALL_CHECKS[0])).alias("run"), none.alias("na"), F.array(*[F.lit(c) for c in P.ALL_CHECKS[1:]]).alias("not_run")
    )
    errors = broken.select(
        "family", F.lit(None).cast("int").alias("table_idx"), F.when(F.col("readable"), "not_an_object").otherwise("json_parse").alias("rule_id"), F.lit(None).cast("string").alias("detail"),
        F.when(F.col("readable"), "the reply is not an object").otherwise("the reply is no JSON").alias("message"), F.lit(False).alias("info"),
    )
    flags, checks = done.flags.unionByName(errors), done.checks.unionByName(unread)
    return Replay(done.tables, done.rows, flags, checks, FA.family_status(checks, flags))
