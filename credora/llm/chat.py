"""Chat formatting: a finite-state machine over roles and a declarative template.

A template is data: the text before and after each role's turn, which roles carry loss, and the
turns that may follow each state. One pass over a conversation's turns runs the machine (it names
the first turn out of order) and emits segments with loss flags: markers and texts of the other
roles without loss, texts of loss roles with it. Control strings inside texts are escaped by a
backslash before their first character (and a backslash by another), so the formatted text reads
back into the same turns; ``read_back`` is that inverse, driven by the same template.

Defined cases: a null text is empty; a null or unknown role keeps its turn under the template's
``other`` marker and makes the conversation invalid; turns out of order are formatted all the same,
with ``valid`` false; equal turn numbers follow by role and text, null turns come last; rows with a
null conversation id are one conversation; an empty table gives an empty result; other input
columns are ignored. A conversation is one value, so its turns meet in one row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import narrow

# The registered template. Roles other than the listed ones are marked by name through ``other``.
TEMPLATE = {
    "start": "<s>",
    "turns": {
        "system": {"before": "<<SYS>>\n", "after": "\n<</SYS>>", "loss": False},
        "user": {"before": "[INST] ", "after": " [/INST]", "loss": False},
        "assistant": {"before": "<ANS> ", "after": " </s>", "loss": True},
    },
    "other": {"before": "<TURN ", "name_end": "> ", "after": " </TURN>", "loss": False},
    "control": ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<ANS>", "<TURN", "</TURN>"],
    "next": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"],
             "assistant": ["user"]},
    "end": ["assistant"],
}


class Formatter:
    """A template compiled for use inside tasks."""

    def __init__(self, template: dict):
        self.template = template
        longest_first = sorted(template["control"], key=lambda c: (-len(c), c))
        self.control = re.compile("|".join(["\\\\", *map(re.escape, longest_first)]))
        turns, other = template["turns"], template["other"]
        # a turn is its marker, an escaped body up to its end marker, and that marker
        self.turn = {role: re.compile(re.escape(t["before"]) + r"((?:[^\\]|\\[\s\S])*?)"
                                      + re.escape(t["after"])) for role, t in turns.items()}
        self.turn[None] = re.compile(
            re.escape(other["before"]) + r"((?:[^\\]|\\[\s\S])*?)" + re.escape(other["name_end"])
            + r"((?:[^\\]|\\[\s\S])*?)" + re.escape(other["after"]))

    def escape(self, text: str) -> str:
        return self.control.sub(lambda m: "\\" + m.group(), text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\([\s\S])", r"\1", text)

    def segments(self, turns: list[tuple[str | None, str]]) -> list[tuple[str, bool]]:
        out = [(self.template["start"], False)]
        for role, text in turns:
            t = self.template["turns"].get(role)
            if t is None:
                t = self.template["other"]
                name = "null" if role is None else "=" + self.escape(role).replace(">", "\\>")
                out.append((t["before"] + name + t["name_end"], False))
            else:
                out.append((t["before"], False))
            out.append((self.escape(text), t["loss"]))
            out.append((t["after"], False))
        return out

    def first_out_of_order(self, roles: list[str | None]) -> int | None:
        """Index of the first turn the machine refuses; len(roles) if it ends in a wrong state."""
        state = "start"
        for i, role in enumerate(roles):
            if role not in self.template["next"].get(state, ()):
                return i
            state = role
        return None if state in self.template["end"] else len(roles)

    def read_back(self, formatted: str) -> list[tuple[str | None, str]]:
        """The turns of a formatted conversation."""
        at = len(self.template["start"])
        if not formatted.startswith(self.template["start"]):
            raise ValueError("no start marker")
        turns = []
        while at < len(formatted):
            for role, pattern in self.turn.items():
                m = pattern.match(formatted, at)
                if m:
                    break
            else:
                raise ValueError(f"no turn at {at}")
            if role is None:
                name = m.group(1)
                role = None if name == "null" else self.unescape(name[1:])
            turns.append((role, self.unescape(m.group(m.re.groups))))
            at = m.end()
        return turns


FORMATTED = ("conv_id {kind}, formatted string, segments array<struct<begin:int,end:int,loss:boolean>>,"
             " n_turns long, valid boolean, first_bad_turn int")


def _format(batches: Iterator[pa.RecordBatch], template: str) -> Iterator[pa.RecordBatch]:
    f = Formatter(json.loads(template))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("loss", pa.bool_())]))
    for batch in batches:
        texts, spans, counts, bad = [], [], [], []
        for row in batch.column("turns").to_pylist():
            turns = [(t["role"], t["text"] or "") for t in row]
            at, own = 0, []
            parts = f.segments(turns)
            for text, loss in parts:
                own.append({"begin": at, "end": at + len(text), "loss": loss})
                at += len(text)
            texts.append("".join(text for text, _ in parts))
            spans.append(own)
            counts.append(len(turns))
            bad.append(f.first_out_of_order([role for role, _ in turns]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(spans, kind),
             pa.array(counts, pa.int64()), pa.array([b is None for b in bad], pa.bool_()),
             pa.array(bad, pa.int32())],
            names=["conv_id", "formatted", "segments", "n_turns", "valid", "first_bad_turn"])


def format_chats(turns: DataFrame, template: dict = TEMPLATE, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
                 ) -> DataFrame:
    """conv_id, formatted, segments (code points: begin, end, loss), n_turns, valid, first_bad_turn
    for every conversation."""
    rows = narrow(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    kind = rows.schema["conv_id"].dataType.simpleString()
    # array_sort by (null turn last, turn, role, text): the struct's own order
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn"), F.col("role"), F.col("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spec = json.dumps(template)
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"]))
                          .cast("array<struct<role:string,text:string>>").alias("turns")) \
        .mapInArrow(lambda it: _format(it, spec), FORMATTED.format(kind=kind))


def _read(batches: Iterator[pa.RecordBatch], template: str) -> Iterator[pa.RecordBatch]:
    f = Formatter(json.loads(template))
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        turns, losses = [], []
        for text, spans in zip(batch.column("formatted").to_pylist(),
                               batch.column("segments").to_pylist()):
            turns.append([{"role": r, "text": t} for r, t in f.read_back(text)])
            losses.append("".join(f.unescape(text[s["begin"]:s["end"]]) for s in spans if s["loss"]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(turns, kind), pa.array(losses, pa.string())],
            names=["conv_id", "turns", "loss_text"])


def read_chats(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, turns, loss_text (unescaped text under the loss flags) and all other columns of
    ``format_chats``, read back from its formatted text."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    spec = json.dumps(template)

    def both(batches):
        for batch in batches:
            for read in _read([batch], spec):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *read.columns[1:]],
                    names=[*batch.schema.names, *read.schema.names[1:]])

    return formatted.mapInArrow(both, f"{FORMATTED.format(kind=kind)}, turns "
                                      "array<struct<role:string,text:string>>, loss_text string")
