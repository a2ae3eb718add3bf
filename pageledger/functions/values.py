"""Column helpers for the values inside specification text: ranges, delays, voltages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import SPACE_CHARS


def _number(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("double")


def parse_range(c: Column) -> Column:
    """``struct(lo, hi)`` of "a to b", "a-b" or "a ± b" (as two numbers); a lone number is both ends; else NULL."""
    a, b = _number(F.regexp_extract(c, P.RANGE, 1)), _number(F.regexp_extract(c, P.RANGE, 2))
    one = _number(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1))
    pair = F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    return F.when(a.isNotNull() & b.isNotNull(), pair).when(one.isNotNull(), F.struct(one.alias("lo"), one.alias("hi")))


def has_digit(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\d"), F.lit(False))


def has_time_unit(c: Column) -> Column:
    return c.rlike(f"(?i){P.TIME_WORDS}") | c.rlike(f"(?i){P.TIME_SUFFIX}")


def is_spurious_delay(c: Column, seconds: int = P.SPURIOUS_SECONDS) -> Column:
    """A narrative delay ("62 sec") that does not belong to a test step."""
    flat = F.regexp_replace(c, r"\\[nrt]", " ")
    return F.coalesce(
        flat.rlike(rf"(?i)\b{seconds}\s*sec\b") | (F.btrim(flat, F.lit(SPACE_CHARS)) == str(seconds)), F.lit(False)
    )


def voltage_value(c: Column) -> Column:
    """The number after the colon in "RN : 240"."""
    return _number(F.regexp_extract(c, r":\s*([\d.]+)", 1))


def plain_number(c: Column) -> Column:
    """A number as text, without a trailing ".0"."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def phases(labels: tuple[str, str, str], *values: Column) -> Column:
    """("RN : a", "YN : b", "BN : c"); one value stands for all three."""
    vs = values if len(values) == 3 else (values[0],) * 3
    return F.array(*[F.concat(F.lit(f"{n} : "), v.cast("string")) for n, v in zip(labels, vs)])


PN, PP = ("RN", "YN", "BN"), ("RY", "YB", "BR")


def text_digits(c: Column) -> Column:
    return F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda v: v.rlike(r"\d"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


