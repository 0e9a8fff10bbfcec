"""Chat formatting with a grammar round trip.

A turn is rendered as `### Role: text`, a line break, `</turn>` and a line break. A deterministic parser reads it back; where
the recovered turn is not the source, the text is escaped (a backslash before each control string, and before the backslashes
in front of it) and rendered again until it is. Escaping is undone by taking one backslash away, so every text survives.

Turns are rendered and proved one by one where they are read. What needs a whole conversation is one pass over its rendered
turns in order, from rows sorted by conversation and turn: a conversation of any length is a stream, never a group in memory.
Only that pass is sequential per conversation, because a running digest is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import cut

ROLES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
NAMES = {name: role for role, name in ROLES.items()}
OPEN, END = "### ", "</turn>"
CONTROL = re.compile(r"(?<!\\)(\\*)(### |</turn>)")  # tried at the first of many backslashes only
ESCAPED = re.compile(r"(?<!\\)\\(\\*)(### |</turn>)")
HEAD = re.compile(r"### (?:(User|Assistant|System|Tool)|@((?:[^:\\]|\\.)*)): ", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the place of its text, escaped as far as the parser needs it."""
    name = ROLES.get(role) or "@" + re.sub(r"([\\:])", r"\\\1", escape(role))
    head = f"{OPEN}{name}: "
    for body in (text, escape(text)):
        done = f"{head}{body}\n{END}\n"
        if parse(done) == [(role, text)]:
            return done, len(head), len(head) + len(body)
    raise ValueError("a turn does not survive its grammar")


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """(role, text) of each turn; null if it does not follow the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        head = HEAD.match(rendered, at)
        if not head:
            return None
        start = at = head.end()
        while True:
            end = rendered.find(END, at)
            if end < 0:
                return None
            if rendered[end - 1] != "\\":
                break
            at = end + 1
        if end - 1 < start or rendered[end - 1] != "\n" or rendered[end + len(END) : end + len(END) + 1] != "\n":
            return None
        body = rendered[start : end - 1]
        if any(not m.group(1) for m in CONTROL.finditer(body)):
            return None
        name = head.group(1)
        role = NAMES[name] if name else unescape(re.sub(r"\\(.)", r"\1", head.group(2), flags=re.DOTALL))
        turns.append((role, unescape(body)))
        at = end + len(END) + 1
    return turns


def formatted_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per row: conv, turn, rendered, text_start and text_end (the place of its text in `rendered`, in code points), learn.

    `learn` marks assistant turns, whose texts are under the loss mask. Joined in order, `rendered` is the formatted
    conversation. Null roles and texts count as empty. Other columns are ignored; an empty table gives an empty result.
    """
    names = ["conv", "turn", "rendered", "text_start", "text_end", "learn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            roles = [x or "" for x in batch.column(2).to_pylist()]
            done = [render(r, t or "") for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
            text, start, end = zip(*done, strict=True) if done else ((), (), ())
            values = [pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([r == "assistant" for r in roles], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values], names)

    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kinds = rows.schema["conv"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kinds[0]}, turn {kinds[1]}, rendered string, text_start int, text_end int, learn boolean")


@dataclass
class _Sums:
    n_turns: int = 0
    loss_chars: int = 0
    chars: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, rendered: str, start: int, end: int, learn: bool) -> None:
        """Everything is read back: the turn by the parser, the loss text by its place."""
        for role, text in parse(rendered) or ():
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(rendered)
        if learn:
            under = unescape(rendered[start:end])
            self.loss_chars += len(under)
            self.loss.update(under.encode("utf-8", "surrogatepass"))


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its formatted turns: id, n_turns, turns_sha256 (role, line break, text, line break of each
    turn), loss_chars, loss_sha256 (the unescaped text under the loss mask), formatted_chars.

    Rows of equal conversation and turn come in the order of their rendered texts; null turns come first; rows with a null
    conversation are one conversation.
    """
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, sums, done = pa.null(), None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*[(c, s.n_turns, s.turns.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars) for c, s in done], strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in cut(batches, 1024):
            kind = batch.schema.field(0).type
            for conv, rendered, start, end, learn in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if sums is None or conv != now:
                    if sums is not None:
                        done.append((now, sums))
                    now, sums = conv, _Sums()
                sums.add(rendered, start, end, learn)
            if len(done) > 1000:
                yield out()
        if sums is not None:
            done.append((now, sums))
        if done:
            yield out()

    rows = turns.repartition("conv").sortWithinPartitions("conv", "turn", "rendered").select("conv", "rendered", "text_start", "text_end", "learn")
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
