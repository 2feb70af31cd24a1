"""Chat formatting: a declarative template, a finite-state machine over roles, and segments with loss flags.

DataFrame functions only. A conversation is worked off in blocks of consecutive turn numbers, so that a long
one spreads over tasks; each block is rendered on its own and composed into a map from the machine's state before it
to the state after it. Maps compose, so the verdict on a conversation needs one small row for each block.

Markers are escaped inside texts: the escape character is doubled, and stands after the first character of whatever
would read as a marker. Dropping each escape character and keeping what follows gives the text back.

Defined cases: a null text or role is empty; an unknown role is formatted, trains nothing and breaks the order of turns;
rows with equal turn numbers are ordered by role and text, null turns come first; a null conv_id is a conversation;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers of a block.
BLOCK_TURNS = 256


@dataclass(frozen=True)
class Template:
    """before + role + middle + text + after is a turn. Markers share their first two characters, the first of which occurs nowhere else in them."""

    before: str = "<|turn|>"
    middle: str = "<|text|>"
    after: str = "<|end|>\n"
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)
    #: state → role → next state; the first state is the start, and those in `accepting` may end a conversation.
    states: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accepting: tuple[str, ...] = ("asked", "answered")

    def __post_init__(self) -> None:
        marks = (self.before, self.middle, self.after)
        if len({m[:2] for m in marks}) != 1 or any(len(m) < 3 or m[0] in m[1:] or self.escape in m for m in marks) or len(self.escape) != 1:
            raise ValueError("markers must share two first characters, the first of which occurs once in each, and hold no escape character")
        if bad := {t for s in self.states.values() for t in s.values()} - set(self.states):
            raise ValueError(f"no such states: {sorted(bad)}")

    def escaped(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        a, b = self.before[:2]
        return F.replace(doubled, F.lit(a + b), F.lit(a + self.escape + b))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, "(?s)" + re.escape(self.escape) + "(.)", "$1")

    def step(self, state: Column, role: Column) -> Column:
        """Index of the next state; -1 once the order is broken."""
        names = list(self.states)
        out = F.lit(-1)
        for i, s in enumerate(names):
            for r, to in self.states[s].items():
                out = F.when((state == i) & (role == r), F.lit(names.index(to))).otherwise(out)
        return out


def format_blocks(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008  frozen
    """(conv_id, block, segments array<struct<text, loss>>, moves array<int>, n_turns): each block of a conversation.

    moves[i] is the state after the block if it began in state i.
    """
    t = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    blocks = t.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def segments(x: Column) -> Column:
        # order matters: header, text, end; only the text of a trained role counts for the loss
        return F.array(
            F.struct(F.concat(F.lit(template.before), template.escaped(x["role"]), F.lit(template.middle)).alias("text"), F.lit(False).alias("loss")),
            F.struct(template.escaped(x["text"]).alias("text"), x["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(template.after).alias("text"), F.lit(False).alias("loss")),
        )

    moves = F.array(*[F.aggregate("t", F.lit(i), lambda s, x: template.step(s, x["role"])) for i in range(len(template.states))])
    return blocks.select("conv_id", "block", F.flatten(F.transform("t", segments)).alias("segments"), moves.alias("moves"), F.size("t").cast("bigint").alias("n_turns"))


def verdicts(blocks: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv_id, valid, n_turns) from format_blocks(): the blocks' maps composed, whether the machine accepts the order of turns. Texts are not gathered."""
    names = list(template.states)
    b = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "moves"))).alias("b"), F.sum("n_turns").alias("n_turns"))  # a few integers for 256 turns
    return b.select("conv_id", _accepted(F.col("b"), template, names).alias("valid"), "n_turns")


def _accepted(blocks: Column, template: Template, names: list[str]) -> Column:
    end = F.aggregate(blocks, F.lit(0), lambda s, b: F.when(s < 0, F.lit(-1)).otherwise(F.get(b["moves"], s)))
    return end.isin(*[names.index(s) for s in template.accepting])


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv_id, segments, valid): a conversation in one row. For very long ones use format_blocks() and verdicts(), which never gather one."""
    whole = format_blocks(turns, template).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "segments", "moves"))).alias("b"))
    return whole.select("conv_id", F.flatten(F.col("b.segments")).alias("segments"), _accepted(F.col("b"), template, list(template.states)).alias("valid"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv_id, valid, formatted, turns array<struct<role, text>>, loss_text): parsed from the segments' text alone, loss from their flags."""
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")
    rows = formatted.select("conv_id", "valid", text.alias("formatted"), loss.alias("loss_text"))
    # markers never occur inside escaped texts, so plain splits part the turns
    parts = F.split("formatted", re.escape(template.after).replace("\\\n", "\n"), -1)
    bodies = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x: Column) -> Column:
        at = F.locate(template.middle, x)
        return F.struct(template.unescaped(F.substring(x, F.lit(len(template.before) + 1), at - len(template.before) - 1)).alias("role"), template.unescaped(F.substring(x, at + len(template.middle), F.length(x))).alias("text"))

    return rows.withColumn("turns", F.transform(bodies, turn))
