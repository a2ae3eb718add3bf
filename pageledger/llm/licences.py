"""Licence scan: an Aho-Corasick automaton over normalised words, and a shunting-yard parser for identifier expressions.

A text is lower-cased (A-Z) and reduced to its words, runs of ASCII letters, digits and characters beyond ASCII, joined by single spaces. One automaton
finds notice phrases and identifier tags in a single pass over whole texts. After a tag, the raw line is parsed as an expression of identifiers,
``and``, ``or``, ``with`` and brackets.

The score is how freely the document may be reused, from 0 (nothing found, or nothing permitted) to 1: ``and`` and separate notices take the
smaller value, ``or`` the larger, ``with`` adds half of what is missing to 1.

Defined results: null and empty texts have no words, no labels, score 0 and null places. Repeated phrases count at every place and their label
once. A malformed expression gives the identifiers it names, evaluated as if joined by ``and``. Other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from pageledger.llm.common import pieces, text_column

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases of well-known licences, with their labels.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How freely each licence lets a text be reused.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "apache-2": 0.9, "zlib": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6,
    "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN_FREEDOM = 0.1
#: Identifier beginnings and the label they stand for, longest first.
FAMILIES = (
    ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("apache-2", "apache-2"), ("lgpl", "lgpl"), ("agpl", "agpl"),
    ("gpl", "gpl"), ("mpl", "mpl"), ("epl", "epl"), ("bsd", "bsd"), ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "public-domain"),
)

RANK = {"or": 1, "and": 2, "with": 3}
RAW_TAG = re.compile(r"(?i)spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier\b[ \t]*:?")
TOKEN = re.compile(r"[()]|[0-9A-Za-z.+-]+")

_KEEP = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Bytes of UTF-8 text to lower-case words and blanks.
BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or (b + 32 if 65 <= b <= 90 else b) in _KEEP else 32 for b in range(256))


def label_of(identifier: str) -> str:
    name = identifier.lower()
    return next((label for start, label in FAMILIES if name.startswith(start)), name)


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: operators wait on a stack until one of lower rank comes; None if the expression is malformed."""
    out, stack, operand_next = [], [], True
    for t in tokens:
        rank = RANK.get(t.lower())
        if operand_next:
            if t == "(":
                stack.append(t)
            elif t == ")" or rank:
                return None
            else:
                out.append(t)
                operand_next = False
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif rank:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= rank:
                out.append(stack.pop())
            stack.append(t.lower())
            operand_next = True
        else:
            return None
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def expression_tokens(line: str) -> list[str]:
    """Tokens of the expression that begins a line: it ends where two operands meet or brackets close too often."""
    out, operand_next, depth = [], True, 0
    for t in TOKEN.findall(line):
        operator = t.lower() in RANK
        if operand_next and (operator or t == ")") or not operand_next and not operator and t != ")":
            break
        depth += (t == "(") - (t == ")")
        if depth < 0:
            break
        operand_next = operator or t == "("
        out.append(t)
    return out


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels named by an expression and its freedom."""
    names = [t for t in tokens if t not in "()" and t.lower() not in RANK]
    postfix = to_postfix(tokens)
    if postfix is None:
        labels = {label_of(t) for t in names}
        return labels, min((FREEDOM.get(x, UNKNOWN_FREEDOM) for x in labels), default=0.0)
    stack: list[tuple[set[str], float]] = []
    for t in postfix:
        if t in RANK:
            (b, y), (a, x) = stack.pop(), stack.pop()
            # what follows "with" is an exception, not a licence
            stack.append((a, x + (1 - x) / 2) if t == "with" else (a | b, min(x, y) if t == "and" else max(x, y)))
        else:
            label = label_of(t)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN_FREEDOM)))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for base, phrases in ((True, BASE_PHRASES), (False, NOTICE_PHRASES)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (base, label, len(phrase)))
    found.add_word(f" {TAG} ", (False, None, len(TAG)))
    found.make_automaton()
    return found


def scan(text: str, found: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = text.encode("utf-8", "surrogatepass").translate(BYTES).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "
    starts, base, labels, values, tagged = [], set(), set(), [], False
    for end, (is_base, label, size) in found.iter(joined):
        if label is None:
            tagged = True
            continue
        if is_base:
            starts.append(end - size)
            base.add(label)
        if label not in labels:
            labels.add(label)
            values.append(FREEDOM.get(label, UNKNOWN_FREEDOM))
    if tagged:
        for m in RAW_TAG.finditer(text):
            named, value = evaluate(expression_tokens(text[m.end() :].split("\n", 1)[0]))
            labels |= named
            values += [value] * bool(named)
    place = (lambda at: joined.count(" ", 0, at) - 1) if starts else None
    return (
        len(words), len(starts), place(min(starts)) if starts else None, place(max(starts)) if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)),
        float(min(values, default=0.0)),
    )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: places of the base phrases, labels and the reuse score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in pieces(batches):
            rows = [scan(t, found) for t in text_column(b).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
