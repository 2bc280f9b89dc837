r"""Chat formatting: the field paths of a record choose a declarative mapping to canonical turns.

A record is JSON of any layout. Its nested field paths, without the paths of metadata, are
hashed to a fingerprint; the fingerprint selects a mapping, and the mapping names where
turns are and what their roles are called. Turns are rendered by a template that marks each
turn and escapes control strings inside roles and texts, so the rendered text can be read
back exactly. Turns are rendered one by one and a conversation is their concatenation, so
a conversation of any length stays spread over tasks; only its digest reads it in order.

Template: ``### role: text</turn>`` and a line feed. A backslash in front of ``\``, ``###``,
``</turn>`` (and ``:`` in roles) makes them text. The loss mask is the span of every
assistant text.

A layout has required and optional paths. A record whose fingerprint is unknown is looked up
once more by its paths that a layout knows, so further fields (a name, tool calls) do not hide it.

Cases: null texts and roles are empty; a value that is no text is its JSON; a turn that is no
object has no role; a record without turns, null, no JSON object or of an unknown layout is
one row with null ``part``, ``role`` and ``text`` (and null ``layout`` if it has none), formatted as
nothing; a ``turn`` that is no 64-bit integer is null; a flat row with null ``turn`` comes first; rows
with equal conversation and turn go by role, then text; repeated rows are all kept; empty
tables give no rows; metadata fields of any name are ignored; half a surrogate pair becomes U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Mapping as Map
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from lingweave.llm.text import map_arrow

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
METADATA = ("id", "conv_id", "turn", "source", "lang", "meta")

# The parts of the template.
OPEN, NAME_END, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


@dataclass(frozen=True)
class Layout:
    """Where the turns of one record layout are.

    ``each`` is a list of turn objects with ``role`` and ``text`` fields. Without it,
    ``fixed`` lists ``(role, fields)``: the texts of the fields that are not empty, joined by
    blank lines, are one turn; a role that begins with ``@`` names the field that holds it.
    """

    name: str
    each: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    optional: tuple[str, ...] = ()
    rename: bool = True

    def paths(self) -> list[str]:
        """All paths that the layout knows."""
        if self.each:
            return sorted([self.each, f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"])
        roles = [r[1:] for r, _ in self.fixed if r.startswith("@")]
        return sorted({*roles, *(f for _, fields in self.fixed for f in fields)})

    def variants(self) -> Iterator[list[str]]:
        """The paths of every record of the layout: a list may be empty and its items without text."""
        leave_out = (f"{self.each}[].{self.text}", f"{self.each}[].{self.role}") if self.each else self.optional
        for n in range(len(leave_out) + 1):
            for left in combinations(leave_out, n):
                if not self.each or left != leave_out[1:]:  # items without a role are no turns
                    yield [p for p in self.paths() if p not in left]

    def fits(self, record: Map) -> bool:
        """Is the list of turns a list, and if it has items, is one of them an object?"""
        items = record.get(self.each) if self.each else None
        return items is None or isinstance(items, list) and (not items or any(isinstance(i, dict) for i in items))

    def turns(self, record: Map) -> Iterator[tuple[str, str]]:
        named = role_name if self.rename else as_text
        if self.each:
            for turn in record[self.each] or ():
                yield (named(turn.get(self.role)), as_text(turn.get(self.text))) if isinstance(turn, dict) else ("", as_text(turn))
            return
        for role, fields in self.fixed:
            texts = [as_text(record[f]) for f in fields if f in record]
            if texts:
                yield named(record.get(role[1:]) if role.startswith("@") else role), "\n\n".join([texts[0], *filter(None, texts[1:])])


SYSTEM = ("system", ("system",))
LAYOUTS = (
    Layout("row", fixed=(("@role", ("text",)),), rename=False),
    Layout("messages", "messages", "role", "content"),
    Layout("conversations", "conversations", "from", "value"),
    Layout("prompt_response", fixed=(SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("prompt_completion", fixed=(SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("instruction", fixed=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
    Layout("system_instruction", fixed=(SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
    Layout("question_answer", fixed=(SYSTEM, ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
)


def as_text(value: object) -> str:
    """Texts as they are, nothing for null, JSON for other values."""
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def as_turn(value: object) -> int | None:
    """A record's own turn number, null if it is none."""
    return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None


def role_name(role: object) -> str:
    name = as_text(role)
    return ROLES.get(name, name)


class Chooser:
    """Layouts by fingerprint."""

    def __init__(self, layouts: Iterable[Layout], metadata: Iterable[str]):
        self.layouts, self.metadata = tuple(layouts), frozenset(metadata)
        self.known = [frozenset(x.paths()) for x in self.layouts]
        self.by_print = {fingerprint(v): x for x in self.layouts for v in x.variants()}

    def choose(self, record: Map) -> Layout | None:
        """The layout of exactly these paths, else that which knows most of them, the first one of equals."""
        paths = content_paths(record, self.metadata)
        exact = self.by_print.get(fingerprint(paths))
        if exact and exact.fits(record):
            return exact
        best, most = None, 0
        for layout, known in zip(self.layouts, self.known):
            shared = paths & known
            if len(shared) > most and self.by_print.get(fingerprint(shared)) is layout and layout.fits(record):
                best, most = layout, len(shared)
        return best


def field_paths(value: object, prefix: str = "") -> set[str]:
    """Paths of all nested fields; the items of a list share one path."""
    if isinstance(value, dict):
        own = {f"{prefix}{k}": v for k, v in value.items()}
        return set(own).union(*(field_paths(v, f"{k}.") for k, v in own.items()))
    if isinstance(value, list):
        base = prefix[:-1]
        return set().union(*(field_paths(v, f"{base}[].") for v in value))
    return set()


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def content_paths(record: Map, metadata: Iterable[str] = METADATA) -> set[str]:
    """Field paths of a record without its metadata."""
    return field_paths({k: v for k, v in record.items() if k not in set(metadata)})


def canonical_turns(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """One row per turn: the other columns, ``turn`` (the record's own, or null), ``part``, ``role``, ``text``, ``layout``; one row with null ``part`` for a record without turns."""
    added = "turn bigint, part bigint, role string, text string, layout string"
    fields = StructType.fromDDL(added)
    kept = [c for c in df.columns if c != record and c not in fields.names]
    rows = df.select(*[f"`{c}`" for c in kept], f"`{record}`")
    schema = StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]], *fields.fields])
    names, chooser = schema.names, Chooser(layouts, metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], ([], [], [], [], [])
            for i, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    value = json.loads(data) if data else None
                except (ValueError, RecursionError):
                    value = None
                value = value if isinstance(value, dict) else {}
                layout = chooser.choose(value)
                turns = list(layout.turns(value)) if layout else []
                for part, (role, text) in list(enumerate(turns)) or [(None, (None, None))]:
                    at.append(i)
                    for column, v in zip(out, (as_turn(value.get("turn")), part, role, text, layout.name if layout else None)):
                        column.append(v)
            taken = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(out, types))], names)

    return map_arrow(rows, run, schema)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of its loss, empty for turns that are not learnt."""
    body = escape(text)
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}{NAME_END}"
    loss = len(head) + len(body) if role == LOSS_ROLE else len(head)
    return f"{head}{body}{CLOSE}", len(head), loss


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns; anything else is an error."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at character {at}")
        yield unescape(turn[1]), unescape(turn[2])
        at = turn.end()


def format_turns(turns: DataFrame) -> DataFrame:
    """Replace ``role`` and ``text`` by ``formatted`` and the loss span ``loss_start, loss_end`` (code points).

    A row whose ``part`` is null holds no turn and is formatted as an empty text.
    """
    kept = [c for c in turns.columns if c not in ("role", "text", "formatted", "loss_start", "loss_end")]
    is_turn = F.col("part").isNotNull() if "part" in turns.columns else F.lit(True)
    rows = turns.select(*[f"`{c}`" for c in kept], F.when(is_turn, F.coalesce("role", F.lit(""))).alias("role"), "text")
    added = StructType.fromDDL("formatted string, loss_start bigint, loss_end bigint").fields
    schema = StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields[:-2]], *added])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [("", 0, 0) if r is None else render(r, t or "") for r, t in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names)

    return map_arrow(rows, run, schema)


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Read formatted turns back: counts and digests of every conversation's turns and loss.

    Turns arrive sorted, and a digest takes them one by one, so memory does not grow with a
    conversation. Rows go to tasks by conversation; a digest cannot be split further.
    """
    order = ["turn", "part", "formatted"]
    rows = formatted.select(conversation, *order, "loss_start", "loss_end")
    ranged = rows.repartition(conversation).sortWithinPartitions(conversation, *order)
    schema = f"{conversation} bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, state = none, None

        def row() -> tuple:
            return current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            done = []
            columns = [batch.column(i).to_pylist() for i in (0, 3, 4, 5)]
            for key, text, start, end in zip(*columns):
                if key != current:
                    if current is not none:
                        done.append(row())
                    current, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(text[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield _rows(done, names)
        if current is not none:
            yield _rows([row()], names)

    return ranged.mapInArrow(run, schema)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def conversations(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Turn rows as JSON records in the flat layout."""
    record = F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"})
    return turns.select(F.col(conversation).cast("long").alias(conversation), record.alias("record"))
