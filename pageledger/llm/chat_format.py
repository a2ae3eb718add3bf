"""Chat formatting of records in many layouts.

A record is a JSON text in any layout: prompt and completion, instruction and output, lists of messages. The set of its nested field paths is hashed, and the hash selects the
mapping that says in which fields the turns are; no field is looked for. ``LAYOUTS`` declares the mappings; each optional field doubles their hashes, all worked out once. The turns
are then written by a template in which every role has marks of its own. Inside texts each mark gets a backslash after its first character (and each mark that has backslashes there one more), so
that no mark is left in a text and the text can be had back exactly. A loss mask gives the places of the assistant's texts, as code points from the start of the formatted record.

Records are formatted where they are read; only formatted texts move, once, to be read back in order. A digest over a conversation is one sequential hash, so one task reads a conversation, record by
record, however long it is, and keeps two hash states.

Defined results: a null text is empty, a value that is no text is its JSON; a null role is empty. A record whose layout no mapping knows, or that is no JSON object, has no formatted text and
no layout (``unmapped`` gives them); it is never guessed at. Records of a conversation are read by turn (those without one first), then by ``tie``, then by formatted text. A null conv_id is a
conversation like any other. An empty table gives no row. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

Turn = tuple[str, str]


@dataclass(frozen=True)
class Fields:
    """Turns in fields of their own, in this order: path, role; the paths in ``optional`` may be missing."""

    name: str
    turns: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()

    def paths(self) -> tuple[str, ...]:
        return (*(p for p, _ in self.turns), *self.extra)

    def read(self, record: dict) -> Iterator[Turn]:
        for path, role in self.turns:
            value = record
            for key in path.split("."):
                value = value.get(key, Fields) if isinstance(value, dict) else Fields
            if value is not Fields:
                yield role, as_text(value)


@dataclass(frozen=True)
class Messages:
    """Turns in a list of objects; ``roles`` renames roles, others stay."""

    name: str
    path: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    optional: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    before: tuple[tuple[str, str], ...] = ()

    def paths(self) -> tuple[str, ...]:
        return (f"{self.path}[].{self.role}", f"{self.path}[].{self.text}", *(p for p, _ in self.before), *self.extra)

    def read(self, record: dict) -> Iterator[Turn]:
        for path, role in self.before:
            if path in record:
                yield role, as_text(record[path])
        value = record
        for key in self.path.split("."):
            value = value[key]
        for message in value:
            role = as_text(message.get(self.role))
            yield self.roles.get(role, role), as_text(message.get(self.text))


#: The declared layouts. ``[]`` in a path is a list.
LAYOUTS = (
    Fields("completion", (("system", "system"), ("prompt", "user"), ("completion", "assistant")), ("system", "prompt", "completion"), ("id",)),
    Fields("response", (("system", "system"), ("prompt", "user"), ("response", "assistant")), ("system",), ("id",)),
    Fields("instruction", (("system", "system"), ("instruction", "user"), ("output", "assistant")), ("system", "instruction", "output"), ("id",)),
    Fields("instruction with input", (("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), ("system",), ("id",)),
    Fields("question", (("question", "user"), ("answer", "assistant")), (), ("id",)),
    Fields("nested answer", (("question.text", "user"), ("answer.text", "assistant")), (), ("id",)),
    Messages("messages", "messages", "role", "content", {}, ("messages[].name", "system"), ("messages[].name", "id"), (("system", "system"),)),
    Messages("shared", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}, ("system",), ("id",), (("system", "system"),)),
    Messages("nested messages", "conversation.turns", "speaker", "text", {"bot": "assistant"}, (), ("id",)),
)


def as_text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def field_paths(value: object, path: str = "") -> Iterator[str]:
    """The nested field paths of a value, an empty list as ``[0]``. Characters that paths are made of are quoted in names."""
    if isinstance(value, dict) and value:
        for name, inner in value.items():
            name = re.sub(r"([\\.\[\]])", r"\\\1", name)
            yield from field_paths(inner, f"{path}.{name}" if path else name)
    elif isinstance(value, list):
        if not value:
            yield f"{path}[0]"
        for inner in value:
            yield from field_paths(inner, f"{path}[]")
    else:
        yield path


def fingerprint(paths: set[str]) -> bytes:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).digest()


def fingerprints(layouts: tuple = LAYOUTS) -> dict[bytes, Fields | Messages]:
    """The mapping for each hash of field paths. Of mappings with the same paths the first is taken; an extra field may always be missing."""
    out: dict[bytes, Fields | Messages] = {}
    for layout in layouts:
        free = tuple(dict.fromkeys((*layout.optional, *layout.extra)))
        fixed = set(layout.paths()) - set(free)
        for n in range(len(free) + 1):
            for some in itertools.combinations(free, n):
                if {p for p, _ in getattr(layout, "turns", ())} & (fixed | set(some)) or isinstance(layout, Messages):
                    out.setdefault(fingerprint(fixed | set(some)), layout)
        if isinstance(layout, Messages):  # an empty list has no fields inside
            out.setdefault(fingerprint({f"{layout.path}[0]"}), layout)
    return out


#: The marks of the template. No mark may begin inside another one.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
NAMED, NAMED_TEXT, NAMED_END = "[ROLE]", "[/ROLE]", "[END]"
ALL_MARKS = (*(m for pair in MARKS.values() for m in pair), NAMED, NAMED_TEXT, NAMED_END)
_PLAIN = re.compile("|".join(rf"(?<={re.escape(m[0])})(?=\\*{re.escape(m[1:])})" for m in ALL_MARKS))
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(m[0])})\\(?=\\*{re.escape(m[1:])})" for m in ALL_MARKS))
_TURN = re.compile(
    "|".join(rf"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items()) + rf"|{re.escape(NAMED)}(?P<role>.*?){re.escape(NAMED_TEXT)}(?P<text>.*?){re.escape(NAMED_END)}", re.S
)


def escaped(text: str) -> str:
    return _PLAIN.sub(r"\\", text) if "[" in text or "<" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub("", text) if "\\" in text else text


def formatted(turns: Iterator[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and start and length of the assistant's texts in it."""
    parts, at, mask = [], 0, []
    for role, text in turns:
        text = escaped(text)
        before, after = MARKS.get(role, (f"{NAMED}{escaped(role)}{NAMED_TEXT}", NAMED_END))
        if role == "assistant":
            mask.append((at + len(before), len(text)))
        parts += [before, text, after]
        at += len(before) + len(text) + len(after)
    return "".join(parts), mask


def turns_of(text: str) -> Iterator[Turn]:
    """The turns of a formatted text; anything between turns is an error."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        role = m.lastgroup
        yield (unescaped(m["role"]), unescaped(m["text"])) if role == "text" else (role, unescaped(m[role]))
    if at != len(text):
        raise ValueError(f"no turn at {at}")


def format_record(record: str | None, known: dict) -> tuple[str | None, str | None, list]:
    try:
        value = json.loads(record)
    except (TypeError, ValueError):
        return None, None, []
    layout = known.get(fingerprint(set(field_paths(value)))) if isinstance(value, dict) else None
    if layout is None:
        return None, None, []
    return layout.name, *formatted(layout.read(value))


SEGMENTS = "conv_id long, turn long, tie string, layout string, formatted string, loss array<struct<start: long, length: long>>"


def format_records(records: DataFrame, layouts: tuple = LAYOUTS) -> DataFrame:
    """``records(conv_id, turn, tie, record)``: the formatted text of each record, the name of its layout and its loss mask. Records of unknown layout have neither."""
    known = fingerprints(layouts)
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_record(r, known) for r in batch.column("record").to_pylist()]
            masks = pa.array([[{"start": s, "length": n} for s, n in d[2]] for d in done], pa.list_(span))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "tie")), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), masks],
                names=["conv_id", "turn", "tie", "layout", "formatted", "loss"],
            )

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("tie").cast("string").alias("tie"), "record").mapInArrow(run, SEGMENTS)


def unmapped(records: DataFrame, layouts: tuple = LAYOUTS) -> DataFrame:
    """Records of a layout that no mapping knows."""
    return format_records(records, layouts).where("layout IS NULL").select("conv_id", "turn", "tie")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Reader:
    """Reads a conversation's formatted records in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.chars, self.loss_chars, self.turns, self.loss = conv_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def record(self, text: str, mask: list[dict]) -> None:
        self.chars += len(text)
        for role, said in turns_of(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for span in mask:
            said = unescaped(text[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def digest(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted records and loss masks alone."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("tie").asc_nulls_first(), "formatted"]
    rows = segments.where("layout IS NOT NULL").select("conv_id", "turn", "tie", "formatted", "loss").repartition("conv_id").sortWithinPartitions(*order)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv_id, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.digest())
                    now = Reader(conv_id)
                now.record(text, mask)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.digest()], schema=schema)

    return rows.mapInArrow(run, DIGESTS)


def with_marked_conversation(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts are made of marks."""
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)


def as_records(conversations: DataFrame) -> DataFrame:
    """Each row as a JSON record. Conversations come in four layouts, by a hash of their id; roles that a layout has no field for come as messages."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    kind, user, assistant = F.pmod(F.xxhash64("conv_id"), F.lit(4)), role == "user", role == "assistant"

    def record(**fields) -> F.Column:
        return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))

    messages = record(messages=F.array(F.struct(role.alias("role"), text.alias("content"))))
    shared = record(conversations=F.array(F.struct(F.when(user, "human").otherwise("gpt").alias("from"), text.alias("value"))))
    made = (
        F.when(user & (kind == 0), record(prompt=text)).when(assistant & (kind == 0), record(completion=text)).when(user & (kind == 1), record(instruction=text))
        .when(assistant & (kind == 1), record(output=text)).when((user | assistant) & (kind == 2), shared).otherwise(messages)
    )
    return conversations.select("conv_id", "turn", role.alias("tie"), made.alias("record"))


def formatted_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Format all conversations and read them back."""
    return read_back(format_records(as_records(with_marked_conversation(spark, conversations))))
