"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says, for each role, what stands before and after a turn's text and
whether the text counts for the loss.  Control strings inside texts are escaped
reversibly, so the formatted text can be read back.  Everything is built from
SQL functions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of the known roles, and of any other role, whose name is then part of the marks.

    ``controls`` are the strings that may only occur in marks.  ``steps`` and
    ``final`` are the machine: (state, role) -> state, from "start"; what is not
    listed is an error.
    """

    roles: Mapping[str, Role]
    controls: tuple[str, ...]
    steps: Mapping[tuple[str, str], str]
    final: tuple[str, ...]
    other: tuple[str, str, str] = ("[ROLE] ", "[:] ", " [/ROLE]")
    escape: str = field(default="\\")

    def __post_init__(self):
        marks = [m for r in self.roles.values() for m in (r.before, r.after)] + list(self.other)
        for control in self.controls:
            for i in range(1, len(control)):
                if re.match(self._openers() + "(?=" + self._tails() + ")", control[i:]):
                    raise ValueError(f"control {control!r} holds the start of another one")
                if any(m.startswith(control[i:]) or m.endswith(control[:i]) for m in marks):
                    raise ValueError(f"control {control!r} could arise where a text meets a mark")
        for mark in marks:
            if not any(c in mark for c in self.controls):
                raise ValueError(f"mark {mark!r} holds no control string")

    def _openers(self) -> str:
        return "([" + "".join(re.escape(c) for c in sorted({c[0] for c in self.controls})) + "])"

    def _tails(self) -> str:
        return re.escape(self.escape) + "*(?:" + "|".join(re.escape(c[1:]) for c in self.controls) + ")"

    def escaped(self, text: Column) -> Column:
        """One more escape sign after the first character of every control string."""
        sign = self.escape.replace("\\", "\\\\")
        return F.regexp_replace(text, self._openers() + "(?=" + self._tails() + ")", "$1" + sign)

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._openers() + re.escape(self.escape) + "(?=" + self._tails() + ")", "$1")


TEMPLATE = Template(
    roles={
        "system": Role("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    },
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[:]", "[/ROLE]"),
    steps={
        ("start", "system"): "told",
        ("start", "user"): "asked",
        ("told", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    final=("answered",),
)


def _by_role(template: Template, role: Column, pick, other: Column) -> Column:
    chosen = None
    for name, marks in template.roles.items():
        value = pick(marks)
        value = value if isinstance(value, Column) else F.lit(value)
        chosen = F.when(role == name, value) if chosen is None else chosen.when(role == name, value)
    return chosen.otherwise(other)


def format_chats(
    turns: DataFrame, template: Template = TEMPLATE, chat: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """chat, n_turns, valid, first_bad, segments, formatted: one row per conversation.

    ``segments`` are (text, loss) in order; ``formatted`` is their texts joined.
    The loss covers the texts of roles that the template marks so, never marks.
    ``valid``: the machine ends in a final state; ``first_bad`` is the position,
    from 1, of the first turn out of order, null if there is none.  Invalid
    conversations are formatted all the same.  Turns are ordered by number, then
    role and text; null numbers come first; null texts and roles are empty; null
    conversation ids form one conversation.  Repeated rows are repeated turns.  A
    conversation is one training sample and one row, so it is gathered in one
    task; conversations, not rows, are what the work is split by.
    """
    name = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = turns.select(
        F.col(f"`{chat}`"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            name.alias("role"),
            body.alias("text"),
            _by_role(
                template, name, lambda r: r.before, F.concat(F.lit(template.other[0]), template.escaped(name), F.lit(template.other[1]))
            ).alias("before"),
            template.escaped(body).alias("body"),
            _by_role(template, name, lambda r: r.after, F.lit(template.other[2])).alias("after"),
            _by_role(template, name, lambda r: r.loss, F.lit(False)).alias("loss"),
        ).alias("_turn"),
    )
    chats = rows.groupBy(F.col(f"`{chat}`")).agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))

    def segments(t: Column) -> Column:
        plain = F.lit(False)
        return F.array(
            F.struct(t["before"].alias("text"), plain.alias("loss")),
            F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
            F.struct(t["after"].alias("text"), plain.alias("loss")),
        )

    table = F.create_map(*[F.lit(x) for (state, by), to in template.steps.items() for x in (f"{state}>{by}", to)])

    def step(at: Column, t: Column) -> Column:
        to = F.when(at["state"] == "error", "error").otherwise(
            F.coalesce(F.try_element_at(table, F.concat(at["state"], F.lit(">"), t["role"])), F.lit("error"))
        )
        return F.struct(to.alias("state"), (at["good"] + F.when(to == "error", 0).otherwise(1)).alias("good"))

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("good"))
    chats = chats.withColumn("_end", F.aggregate("_turns", start, step))
    chats = chats.withColumn("segments", F.flatten(F.transform("_turns", segments)))
    return chats.select(
        F.col(f"`{chat}`"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.col("_end.state").isin(*template.final).alias("valid"),
        F.when(F.col("_end.state") == "error", F.col("_end.good") + 1).alias("first_bad"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, as they were."""
    first, middle, last = template.other
    kinds = [(r.before, r.after) for r in template.roles.values()]
    inside = ".*?"
    patterns = [re.escape(b) + inside + re.escape(a) for b, a in kinds]
    patterns.append(re.escape(first) + inside + re.escape(middle) + inside + re.escape(last))
    pieces = F.regexp_extract_all(formatted, F.lit("(?s)(?:" + "|".join(patterns) + ")"), F.lit(0))

    def turn(piece: Column) -> Column:
        role, body = None, None
        for name, marks in template.roles.items():
            hit = F.startswith(piece, F.lit(marks.before))
            inner = F.substr(piece, F.lit(len(marks.before) + 1), F.length(piece) - len(marks.before) - len(marks.after))
            role = F.when(hit, F.lit(name)) if role is None else role.when(hit, F.lit(name))
            body = F.when(hit, inner) if body is None else body.when(hit, inner)
        at = F.instr(piece, middle)
        other_role = F.substr(piece, F.lit(len(first) + 1), at - len(first) - 1)
        other_body = F.substr(piece, at + len(middle), F.length(piece) - at - len(middle) + 1 - len(last))
        return F.struct(
            role.otherwise(template.unescaped(other_role)).alias("role"), template.unescaped(body.otherwise(other_body)).alias("text")
        )

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, as it was before escaping."""
    marked = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))
    return F.array_join(marked, "")
