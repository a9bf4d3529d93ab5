"""Chat formatting: a declarative template, a finite-state machine over roles, escaped segments.

DataFrame functions only. One row per conversation; a conversation's turns meet in one row because
its formatted text is one value.

Defined results: null text or role reads as empty; an unknown role is formatted under its own
(escaped) name, carries no loss and makes the conversation invalid; turns that share a number are
ordered by role, then text; rows with a null ``conv_id`` form one conversation; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Roles with their labels and loss flags, the machine's transitions, and the control strings.

    ``transitions`` maps (state, role) to the next state; a conversation is valid if every turn has
    a transition and the last state is in ``accepting``.
    """

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: int = 0
    transitions: dict[tuple[int, str], int] = field(
        default_factory=lambda: {(0, "system"): 1, (0, "user"): 2, (1, "user"): 2, (2, "assistant"): 3, (3, "user"): 2}
    )
    accepting: frozenset[int] = frozenset({3})
    header: str = "### "
    header_end: str = ": "
    turn_end: str = "</turn>"

    # A backslash and one letter stand for the backslash itself and for each control string. In an
    # escaped text a backslash is always followed by one of these letters, so undoing is exact.
    def codes(self) -> list[tuple[str, str]]:
        return [("\\", "\\e"), (self.turn_end, "\\t"), (self.header, "\\h"), (self.header_end, "\\c")]


def escape(text: Column, template: ChatTemplate) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), template.codes(), text)


def unescape(text: Column, template: ChatTemplate) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), template.codes()[::-1], text)


def _cases(pairs: list[tuple[Column, Column]], other: Column) -> Column:
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), pairs[::-1], other)


def _label(role: Column, template: ChatTemplate) -> Column:
    known = [(role == r, F.lit(label)) for r, label in template.labels.items()]
    return _cases(known, F.concat(F.lit("\\e"), escape(role, template)))


def _role(label: Column, template: ChatTemplate) -> Column:
    known = [(label == name, F.lit(r)) for r, name in template.labels.items()]
    return _cases(known, unescape(F.substr(label, F.lit(3)), template))


def _machine(turns: Column, template: ChatTemplate) -> Column:
    """Last state and the index of the first turn without a transition (-1 if there is none)."""

    def step(at: Column, turn: Column) -> Column:
        moves = [((at["state"] == s) & (turn["role"] == r), F.lit(to)) for (s, r), to in template.transitions.items()]
        state = _cases(moves, F.lit(-1))
        bad = F.when(at["bad"] >= 0, at["bad"]).when(state < 0, at["i"]).otherwise(F.lit(-1))
        return F.struct(state.alias("state"), bad.alias("bad"), (at["i"] + 1).alias("i"))

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("i"))
    return F.aggregate(turns, begin, step)


def format_chat(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """conv_id, segments (text, loss), formatted, valid, first_bad_turn: one row per conversation."""
    template = template or ChatTemplate()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")).alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def pieces(row: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.header), _label(row["role"], template), F.lit(template.header_end))
        return F.array(
            piece(head, F.lit(False)),
            piece(escape(row["text"], template), row["role"].isin(*sorted(template.loss_roles))),
            piece(F.lit(template.turn_end + "\n"), F.lit(False)),
        )

    made = grouped.select("conv_id", _machine(F.col("rows"), template).alias("end"), F.flatten(F.transform("rows", pieces)).alias("segments"))
    return made.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ((F.col("end.bad") < 0) & F.col("end.state").isin(*sorted(template.accepting))).alias("valid"),
        F.when(F.col("end.bad") >= 0, F.col("end.bad")).alias("first_bad_turn"),
    )


def parse_chat(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    template = template or ChatTemplate()
    blocks = F.split(formatted, "\\Q" + template.turn_end + "\n\\E")
    skip = len(template.header) + 1

    def turn(block: Column) -> Column:
        at = F.instr(block, template.header_end)
        label = F.substr(block, F.lit(skip), at - skip)
        return F.struct(
            _role(label, template).alias("role"),
            unescape(F.substr(block, at + len(template.header_end)), template).alias("text"),
        )

    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turn)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    template = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def chat_digest(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted output."""
    template = template or ChatTemplate()
    back = format_chat(turns, template).select(
        "conv_id", "valid", "formatted", parse_chat(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("lost")
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
