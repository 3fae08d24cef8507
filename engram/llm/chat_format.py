"""Chat formatting with DataFrame functions only.

A declarative template says how turns are marked, which roles carry loss and which role may
follow which.  A finite-state machine over the roles of a conversation checks the turn order;
the turns come out as text segments with a loss flag each.  Control strings inside texts are
escaped by a backslash, so that the formatted text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, loss roles, and the machine: (state, role) -> state, from start; accepting says where it may end."""

    before: str = "### "
    after: str = ": "
    close: str = "\n</turn>\n"
    control: tuple[str, ...] = ("###", "</turn>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("begin", "system"): "ready", ("begin", "user"): "asked", ("ready", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    accepting: tuple[str, ...] = ("answered",)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, "(" + "|".join(re.escape(x) for x in ("\\", *self.control)) + ")", "\\\\$1")

    def escape_role(self, role: Column) -> Column:
        return F.regexp_replace(role, "(" + "|".join(re.escape(x) for x in ("\\", self.after[0], "\n", *self.control)) + ")", "\\\\$1")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def valid(self, roles: Column) -> Column:
        """Whether the machine reads all roles and ends where it may."""
        table = F.create_map(*[x for (state, role), to in self.moves.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))])
        end = F.aggregate(roles, F.lit(self.start), lambda state, role: F.coalesce(F.try_element_at(table, F.concat_ws("\n", state, role)), F.lit("error")))
        return end.isin(*self.accepting)


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, n_turns, valid, segments (array of text, loss), formatted: one row for each conversation.

    A conversation is one training sample and so one row.  Turns are taken by number; repeated
    numbers by role, then text, and repeated rows stay.  A null number comes first, a null role or
    text is an empty one, and rows without conversation id form one conversation.  Other columns
    are left out.  Order that the machine does not accept makes valid false; the turns are formatted all the same.
    """
    rows = turns.select(turns[conv_col].alias("conv"), F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    t = template
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    parts = F.flatten(F.transform("turns", lambda x: F.array(segment(F.concat(F.lit(t.before), t.escape_role(x["role"]), F.lit(t.after)), no), segment(t.escape(x["text"]), x["role"].isin(*t.loss_roles)), segment(F.lit(t.close), no))))
    convs = convs.select("conv", F.size("turns").cast("long").alias("n_turns"), t.valid(F.transform("turns", lambda x: x["role"])).alias("valid"), parts.alias("segments"))
    return convs.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumnRenamed("conv", conv_col)


def read_chats(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (array of role, text) that a formatted text holds."""
    t, mark = template, template.after[0]
    parts = F.split(formatted, re.escape(t.close), -1)
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(t.before) + 1))
        pieces = F.split(rest, re.escape(mark), -1)
        # a role ends at the first mark that an even number of backslashes precedes
        ends = F.transform(pieces, lambda x: (F.length(x) - F.length(F.rtrim(x, F.lit("\\")))) % 2 == 0)
        role = F.array_join(F.slice(pieces, F.lit(1), F.array_position(ends, True).cast("int")), mark)
        return F.struct(t.unescape(role).alias("role"), t.unescape(F.substr(rest, F.length(role) + len(t.after) + 1)).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def chat_digests(formatted: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id") -> DataFrame:
    """What a reader of format_chats' output finds: digests of the turns and of the text under the loss mask."""
    df = formatted.withColumns({"_turns": read_chats(F.col("formatted"), template), "_loss": loss_text(F.col("segments"), template)})
    listed = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return df.select(conv_col, F.size("_turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
