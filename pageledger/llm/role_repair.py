"""Repair of conversations by generalised LR parsing of their roles.

The grammar of legal role orders is turned into LR tables. A conversation's rows are read once, in order; all its repairs are followed together on a
graph-structured stack. Cells of the stack share what lies below them; before and at each row the parser may insert an empty turn, keep the row, give it another
role or delete it, each at its price. Where several edits lead to the same top cell only the least (cost, audit) stays, so as many cells live as the grammar has stacks (six),
whatever the length of the conversation. The digest of the repaired turns is carried along each living cell.

Two audits never have to be compared as texts: after a row every living audit ends with that row's edit, so none is the beginning of another, and the order of two
audits is the order of (rank of the audit before, edits since). Audits are kept as shared chains and written out once.

Memory: a task streams its rows, sorted by conversation and turn; it holds one batch and, for the conversation at hand, some 100 bytes a row for the audit, which is a value of
the result. A digest over a conversation is one sequential hash, so a conversation is read by one task however long it is; damage, faults and repeats are found before that in
parallel, repeats by an aggregate that is combined before its shuffle.

Defined results: null roles and texts are one space. Rows of one turn are ordered by role, then text; rows without a turn come first. A null conv_id is a conversation like any
other. Repeated rows are duplicates. A conversation without rows has zeros, an empty audit and the hash of nothing. An empty table gives no row. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageledger.llm.common import SPACE
from pageledger.session import materialize

#: Roles as their initials: an optional system turn, then pairs of user and assistant; or nothing.
GRAMMAR = (("C", ()), ("C", ("T",)), ("T", ("T", "P")), ("T", ("s", "P")), ("T", ("P",)), ("P", ("u", "a")))
START, ROLES = "C", {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
NON_SPACE = r"[^\x20\x09-\x0D]"


class Tables(NamedTuple):
    """``go[state, symbol]``, the rules that are complete in a state (not those of the start symbol), and the states in which a start rule is complete."""

    go: dict[tuple[int, str], int]
    complete: dict[int, list[tuple[str, int]]]
    accepts: set[int]


def lr_tables(grammar: tuple = GRAMMAR, start: str = START) -> Tables:
    """LR(0) tables; conflicts are left to the parser, which follows all choices."""
    heads = {h for h, _ in grammar}

    def closed(items: frozenset) -> frozenset:
        todo, seen = list(items), set(items)
        while todo:
            rule, dot = todo.pop()
            body = grammar[rule][1]
            if dot < len(body) and body[dot] in heads:
                new = {(k, 0) for k, (h, _) in enumerate(grammar) if h == body[dot]} - seen
                seen |= new
                todo += new
        return frozenset(seen)

    first = closed(frozenset((k, 0) for k, (h, _) in enumerate(grammar) if h == start))
    states, todo, go = {first: 0}, [first], {}
    while todo:
        items = todo.pop()
        for symbol in {grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}:
            after = closed(frozenset((r, d + 1) for r, d in items if d < len(grammar[r][1]) and grammar[r][1][d] == symbol))
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            go[states[items], symbol] = states[after]
    complete = {n: [(grammar[r][0], d) for r, d in items if d == len(grammar[r][1]) and grammar[r][0] != start] for items, n in states.items()}
    accepts = {n for items, n in states.items() if any(grammar[r][0] == start and d == len(grammar[r][1]) for r, d in items)}
    return Tables(go, complete, accepts)


class Cell(NamedTuple):
    """A cell of the graph-structured stack: a state on top of a cell that others may share."""

    state: int
    below: "Cell | None"


ROOT = Cell(0, None)
TABLES = lr_tables()


@cache
def shifted(cell: Cell, terminal: str) -> tuple[Cell, ...]:
    """The tops after a terminal and all reductions that follow it."""
    if (cell.state, terminal) not in TABLES.go:
        return ()
    todo, out = [Cell(TABLES.go[cell.state, terminal], cell)], []
    while todo:
        top = todo.pop()
        for head, size in TABLES.complete[top.state]:
            base = top
            for _ in range(size):
                base = base.below
            todo.append(Cell(TABLES.go[base.state, head], base))
        if top.state in TABLES.accepts or any((top.state, t) in TABLES.go for t in "sua"):
            out.append(top)
    return tuple(out)


@cache
def inserted(cell: Cell) -> tuple[tuple[str, Cell], ...]:
    """Every top that inserted turns alone lead to, with the shortest run of inserted initials."""
    best, todo = {cell: ""}, [cell]
    for at in todo:
        for t in ROLES:
            for top in shifted(at, t):
                if top not in best:
                    best[top] = best[at] + t
                    todo.append(top)
    return tuple((run, top) for top, run in best.items())


class Move(NamedTuple):
    """Edits up to and including a row: price, letters, turns written (role or None for the row's own, whether with its text), top after it."""

    cost: int
    letters: str
    turns: tuple[tuple[str | None, bool], ...]
    top: Cell


@cache
def moves(cell: Cell, initial: str, must_go: bool, cut_off: bool) -> tuple[Move, ...]:
    """The cheapest move from a top to each other one over a row of that kind."""
    best: dict[Cell, Move] = {}
    for run, at in inserted(cell):
        price, letters, turns = INSERT * len(run), "I" * len(run), tuple((ROLES[t], False) for t in run)
        found = [Move(price + DELETE, letters + "D", turns, at)]
        if not must_go:
            extra = TRUNCATED * cut_off
            found += [Move(price + KEEP + extra, letters + "K", (*turns, (None, True)), top) for top in shifted(at, initial)]
            found += [Move(price + REROLE + extra, letters + "R", (*turns, (role, True)), top) for t, role in ROLES.items() for top in shifted(at, t)]
        for m in found:
            if m.top not in best or m[:2] < best[m.top][:2]:
                best[m.top] = m
    return tuple(best.values())


class Repair:
    """The living repairs of one conversation. ``tops`` has for each top cell: cost, rank of the audit, audit as a chain, digest of the turns written."""

    def __init__(self) -> None:
        self.tops: dict[Cell, tuple] = {ROOT: (0, 0, None, hashlib.sha256())}

    def row(self, role: str, text: str, must_go: bool, cut_off: bool) -> None:
        best: dict[Cell, tuple] = {}
        for cell, value in self.tops.items():
            for m in moves(cell, role[:1], must_go, cut_off):
                order = (value[0] + m.cost, value[1], m.letters)
                if m.top not in best or order < best[m.top][0]:
                    best[m.top] = (order, value, m, cell == ROOT)
        ranks = {o: k for k, o in enumerate(sorted({b[0][1:] for b in best.values()}))}
        self.tops = {top: (order[0], ranks[order[1:]], (value[2], m.letters), written(value[3], m.turns, first, role, text)) for top, (order, value, m, first) in best.items()}

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair, ties by audit."""
        best = None
        for cell, value in self.tops.items():
            for run, top in inserted(cell):
                if top.state in TABLES.accepts:
                    order = (value[0] + INSERT * len(run), value[1], "I" * len(run))
                    if best is None or order < best[0]:
                        best = (order, value, run, cell == ROOT)
        order, value, run, first = best
        letters, chain = [order[2]], value[2]
        while chain is not None:
            chain, edits = chain
            letters.append(edits)
        digest = written(value[3], tuple((ROLES[t], False) for t in run), first, "", "")
        return order[0], "".join(reversed(letters)), digest.hexdigest()


def written(digest, turns: tuple, first: bool, role: str, text: str):
    """The digest after more turns; the one before is left as it is, since other tops may go on from it."""
    if not turns:
        return digest
    digest = digest.copy()
    digest.update((("" if first else "\n") + "\n".join(f"{own or role}:{text if full else ''}" for own, full in turns)).encode())
    return digest


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The repaired turns as (role, text, edit), from the audit and the rows: what role a turn has follows from its place."""
    before = ""
    for edit in audit:
        here = "a" if before == "u" else "u"
        if edit == "I":
            yield ROLES[here], "", edit
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            here = role[:1] if edit == "K" else here
            yield (role if edit == "K" else ROLES[here]), text, edit
        before = here


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, there``: the rows after a damage that each row's key decides. A row that is dropped stays as a mark, ``there`` false, so that its
    conversation is not forgotten."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text = F.crc32(key) % 20, F.coalesce(F.col("text"), F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("there"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form that ``repairs`` reads."""
    return conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(True).alias("there"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``blank``, ``later`` (role and text stand in an earlier turn of the conversation) and ``cut_off``."""
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    seen = rows.where("there").groupBy("conv_id", _digest().alias("digest")).agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
    # stored, so that Spark sees its size: nearly all texts stand once, and then the texts need not move for this join
    seen = materialize(seen.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first"))
    found = rows.withColumn("digest", F.when(F.col("there"), _digest())).join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return found.select("conv_id", "turn", "role", "text", "there", (~F.col("text").rlike(NON_SPACE)).alias("blank"), F.coalesce(at > F.col("first"), F.lit(False)).alias("later"), (~last.isin(".", "!", "?")).alias("cut_off"))


def in_order(rows: DataFrame) -> DataFrame:
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Conversation:
    """Counts and repairs of the conversation at hand."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair, self.before, self.low, self.high, self.turns, self.illegal = conv_id, Repair(), None, None, None, 0, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def row(self, turn: int | None, role: str, text: str, blank: bool, later: bool, cut_off: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        fault = "blank" if blank else "duplicate" if later or (turn, role, text) == self.before else "truncated" if cut_off else None
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = (turn, role, text)
        self.repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, *self.repair.end())


def repairs(rows: DataFrame) -> DataFrame:
    """For each conversation of ``rows`` (as ``damaged`` or ``undamaged`` gives them): its faults, the price and audit of the cheapest repair, and the digest of the
    repaired turns."""
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv_id, there, *row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "there", "turn", "role", "text", "blank", "later", "cut_off"))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.summary())
                    now = Conversation(conv_id)
                if there:
                    now.row(*row)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, now.summary()))], schema=schema)

    return in_order(with_faults(rows).withColumn("conv_id", F.col("conv_id").cast("long"))).mapInArrow(run, SUMMARY)


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit``: the repaired turns themselves, from the rows and the audits of ``repairs``. Turns that a repair inserts have an empty text."""
    head = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), "audit", F.lit(True).alias("head"), F.lit("").alias("text"))
    body = rows.where("there").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.lit("").alias("audit"), F.lit(False).alias("head"), "text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "text"]
    mixed = head.unionByName(body).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text", "head")))

        def turns() -> Iterator[tuple]:
            stream = cells()
            for conv_id, audit, _, _, _ in stream:  # heads only: the audit takes exactly the rows of its conversation
                for n, turn in enumerate(replay(audit, ((c[2], c[3]) for c in stream))):
                    yield conv_id, n, *turn

        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        held, size = [], 0
        for t in turns():
            held.append(t)
            size += len(t[3])
            if len(held) >= 4096 or size > 4 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h)) for h in held], schema=schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h)) for h in held], schema=schema)

    return mixed.mapInArrow(run, "conv_id long, position long, role string, text string, edit string")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Damage the conversations and repair them."""
    return repairs(damaged(conversations))
