"""Chat formatting by a finite-state machine and a declarative template.

A template names the strings that open and close a turn, the roles whose text
is learned, and the machine: which role may follow which state.  Each
conversation becomes one row: its formatted string, the segments it is made of
(each with its loss flag), and whether the machine accepts its roles.

Control strings inside roles and texts are escaped reversibly: ``<``, any number
of backslashes and ``|`` gets one backslash more, so no text can open or close
a turn; a line feed or backslash in a role is escaped likewise.

Only DataFrame functions are used.  A conversation is one training example and
one row, so its turns meet in one task; nothing else does.  Turns are ordered by
turn number (null first), then role and text; repeated rows are turns of their
own.  Null roles and texts count as empty; a null conversation id is one
conversation.  A conversation that the machine refuses is formatted all the
same and marked.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open_turn: str = "<|im_start|>"
    after_role: str = "\n"
    close_turn: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; a role is the state it leads to.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user", "tool"),
        "tool": ("tool", "assistant"),
    })


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _accepts(roles: Column, t: Template) -> Column:
    table = F.create_map(*[F.lit(x) for state, nexts in t.moves.items() for r in nexts for x in ((f"{state}>{r}"), r)])
    end = F.aggregate(roles, F.lit(t.start), lambda s, r: F.coalesce(F.element_at(table, F.concat(s, F.lit(">"), r)), F.lit("refused")))
    return end.isin(*t.accept)


def format_chat(turns: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted, valid), one row per conversation."""
    t = template
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        plain(F.concat(F.lit(t.open_turn), _escape_role(x["role"]), F.lit(t.after_role))),
        F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
        plain(F.lit(t.close_turn + t.after_turn)))))
    convs = convs.select("conv_id", segments.alias("segments"), _accepts(F.col("turns.role"), t).alias("valid"))
    return convs.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "valid")


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) read back from a formatted string."""
    t = template
    quoted = "".join("\\" + c if not c.isalnum() else c for c in t.open_turn)
    parts = F.split(formatted, quoted)
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)
    end = len(t.close_turn + t.after_turn)
    return F.transform(parts, lambda p: F.struct(
        _unescape_role(F.substring_index(p, t.after_role, 1)).alias("role"),
        unescape(F.substr(p, F.char_length(F.substring_index(p, t.after_role, 1)) + 1 + len(t.after_role),
                          F.char_length(p) - F.char_length(F.substring_index(p, t.after_role, 1)) - len(t.after_role) - end)).alias("text")))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
