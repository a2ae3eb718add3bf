"""Column helpers for text: lines, white space and word runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# White space as Python's str.strip() and line breaks as str.splitlines() see them.
SPACE_CHARS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
ASCII_BREAK = r"[\r\x0B\f\x1C-\x1E]"
OTHER_BREAK = r"[\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def wide_gaps(c: Column) -> Column:
    """Number of runs of two or more white-space characters. Only a text beyond ASCII has its white space mapped first, which takes longer than the search."""
    mapped = F.regexp_count(F.translate(c, SPACE_CHARS, " " * len(SPACE_CHARS)), F.lit(" {2,}"))
    return F.when(F.length(c) == F.octet_length(c), F.regexp_count(c, F.lit(r"[ \t\n\x0B\f\r\x1C-\x1F]{2,}"))).otherwise(mapped)


def split_lines(c: Column) -> Column:
    """Lines of a text; a final line break opens no further line.

    Most texts have no line break but ``\\n``, which is cut out without a pattern.
    """
    t = F.coalesce(c, F.lit(""))
    plain = F.split(F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t), "\n")
    # an ASCII text is searched for fewer characters, which takes a third of the time
    other = F.when(F.length(t) == F.octet_length(t), t.rlike(ASCII_BREAK)).otherwise(t.rlike(OTHER_BREAK))
    return F.when(other, F.split(F.regexp_replace(t, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK)).otherwise(plain)


def once(df: DataFrame, c: Column, name: str) -> DataFrame:
    """Add a column that is computed once per row, however often later filters and projections use it.

    The optimizer copies plain column expressions into each use; it does not copy through a generator.
    """
    return df.select(*df.columns, F.explode(F.array(c)).alias(name))


def whole_words(pattern: str) -> str:
    """Match ``pattern`` only as a whole run of letters, digits and underscores of any script."""
    return rf"(?<!{WORD})(?:{pattern})(?!{WORD})"


def rx(text: Column, pattern: str) -> Column:
    """Case-insensitive search."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def rx_if(text: Column, upper: Column, words: tuple[str, ...], pattern: str, starts: str) -> Column:
    """``rx`` for patterns that need one of ``words`` (in capitals) and begin with one of the letters ``starts``; ``upper`` is the text in capitals.

    Texts without any of the words need no pattern, and the first letter of a match is tried before its alternatives. Other letters with ASCII capitals only let more texts through to the pattern.
    """
    some = F.contains(upper, F.lit(words[0]))
    for w in words[1:]:
        some = some | F.contains(upper, F.lit(w))
    return F.coalesce(F.when(some, text.rlike(f"(?i)(?=[{starts}])(?:{pattern})")).otherwise(F.lit(False)), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def filled(c: Column) -> Column:
    """Present and not empty."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, NULL where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def plain_spaces(c: Column) -> Column:
    """White space of any script as plain spaces, trimmed. Native character mapping, no pattern."""
    return F.trim(F.translate(c, SPACE_CHARS, " " * len(SPACE_CHARS)))
