"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine reads the roles of a conversation in turn order and marks every turn as expected or not; the
template says for each role what stands before and after its text and whether the text bears loss.
Control strings inside texts are escaped by one backslash after their first character (more where some
stand there already), which is undone exactly on reading back.

Defined cases: turns are ordered by turn (nulls first), then role, then text, so ties and repeated rows
have one order and each repeated row is a turn of its own; a null text or role counts as empty; a role
that the template doesn't name is spelled out in the marks and never expected; rows with a null
conversation id form one conversation of that id; an empty table gives an empty one; further columns
are ignored. Conversations are streamed turn by turn: nothing holds a whole conversation, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, prepare


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    #: For roles without an entry: before the role's name, between name and text, after the text.
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    #: state -> role -> next state; a role that isn't listed leaves the state as it is.
    moves: dict[str, dict[str, str]] = field(default_factory=dict)
    start: str = "start"
    ends: frozenset[str] = frozenset()

    def rest(self) -> str:
        return "|".join(re.escape(c[1:]) for c in self.controls)

    def first(self) -> str:
        return "[" + "".join(sorted({re.escape(c[0]) for c in self.controls})) + "]"

    def escape(self, text: str) -> str:
        return re.sub(rf"({self.first()})(?=\\*(?:{self.rest()}))", r"\1\\", text)

    def unescape(self, text: str) -> str:
        return re.sub(rf"({self.first()})\\(?=\\*(?:{self.rest()}))", r"\1", text)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        to = self.moves.get(state, {}).get(role)
        return (state, False) if to is None else (to, True)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, bears loss) of one turn; the second one is the turn's own text."""
        turn = self.turns.get(role)
        if turn is None:
            a, b, c = self.other
            turn = Turn(a + self.escape(role) + b, c)
        return [(turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]

    def turn_pattern(self) -> re.Pattern:
        a, b, c = map(re.escape, self.other)
        forms = [f"{re.escape(t.before)}(.*?){re.escape(t.after)}" for t in self.turns.values()]
        return re.compile("|".join([*forms, f"{a}(.*?){b}(.*?){c}"]), re.S)

    def whole_turns(self, formatted: str, pattern: re.Pattern) -> tuple[list[tuple[str, str]], int]:
        """(role, text) of the turns that a formatted text starts with, and where the last whole one ends."""
        out, roles, at = [], list(self.turns), 0
        while found := pattern.match(formatted, at):
            groups, at = found.groups(), found.end()
            for role, text in zip(roles, groups):
                if text is not None:
                    out.append((role, self.unescape(text)))
                    break
            else:
                out.append((self.unescape(groups[-2]), self.unescape(groups[-1])))
        return out, at

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn in a formatted text."""
        turns, end = self.whole_turns(formatted, self.turn_pattern())
        if end < len(formatted):
            raise ValueError(f"no turn at {end}")
        yield from turns


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    other=("[ROLE]", "[/ROLE]", "[END]"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]"),
    moves={
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    ends=frozenset({"assistant"}),
)

SEGMENTS = (
    "conv_id long, place long, turn_no long, role string, segment string, loss boolean, expected boolean, state string"
)


def format_conversations(df: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Rows (conv_id, place, turn_no, role, segment, loss, expected, state) of columns conv_id, turn, role, text.

    One shuffle by conversation, sorted; segments of a conversation stay in one partition in order.
    """
    prepare(df.sparkSession)
    rows = (
        df.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = dict(zip(("c", "p", "n", "r", "s", "l", "e", "z"), (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.bool_(),) * 2 + (pa.string(),)))
        now, place, number, state = object(), 0, 0, template.start
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != now:
                    now, place, number, state = conv, 0, 0, template.start
                state, expected = template.step(state, role)
                for segment, loss in template.segments(role, text):
                    out.append((conv, place, number, role, segment, loss, expected, state))
                    place += 1
                number += 1
            if out:
                yield batch_of(dict(zip(types, map(list, zip(*out)))), types)

    return rows.mapInArrow(run, SEGMENTS)


def digest_segments(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation what can be read back from its segments, given in the order that they were made in.

    Turns are found in the formatted text alone, which is read on as its segments come; what is left over at the end of a
    conversation is an error.
    Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, complete).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"c": pa.int64(), "n": pa.int64(), "t": pa.string(), "lc": pa.int64(), "l": pa.string(), "f": pa.int64(), "v": pa.bool_(), "d": pa.bool_()}
        now: list | None = None
        pattern = template.turn_pattern()

        def ended(x: list) -> tuple:
            if x[8]:
                raise ValueError(f"conversation {x[0]} doesn't end with a turn")
            return (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6], x[7] in template.ends)

        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for conv, segment, loss, expected, state in zip(*cols):
                if now is None or conv != now[0]:
                    if now is not None:
                        out.append(ended(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, template.start, ""]
                now[5] += len(segment)
                now[8] += segment
                if loss:
                    bare = template.unescape(segment)
                    now[3] += len(bare)
                    now[4].update(bare.encode())
                now[6], now[7] = now[6] and expected, state
                turns, end = template.whole_turns(now[8], pattern)
                for role, text in turns:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                now[8] = now[8][end:]
            if out:
                yield batch_of(dict(zip(types, map(list, zip(*out)))), types)
        if now is not None:
            yield batch_of(dict(zip(types, ([x] for x in ended(now)))), types)

    return segments.select("conv_id", "segment", "loss", "expected", "state").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, complete boolean",
    )
