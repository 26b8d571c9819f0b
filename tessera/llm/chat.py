"""Chat formatting by a finite-state machine over roles, as native expressions.

A template declares the marks around a turn, the roles whose text bears loss,
and the machine: (state, role) -> state. A conversation becomes one string and
its segments (text, loss flag), which joined give that string.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``open_`` + role + ``after_role`` + escaped text + ``close`` per turn.

    Escaping doubles every backslash and puts one into every "<|", so no
    control string can occur in a text and unescaping restores it exactly.
    """

    open_: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: A user speaks first, perhaps after one system turn; then turns alternate.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "ready"), ("start", "user", "asked"), ("ready", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = field(default=("answered",))


CHATML = Template()
TURN = "struct<turn:bigint,role:string,text:string>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def final_state(roles: Column, template: Template) -> Column:
    """The machine's state after all roles; "invalid" once no move fits."""
    moves = F.create_map(*(F.lit(x) for a, role, b in template.moves for x in (f"{a}\x00{role}", b)))
    return F.aggregate(roles, F.lit(template.start), lambda s, r: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\x00"), r)), F.lit("invalid")))


def segments(turns: Column, template: Template) -> Column:
    """array<struct<text, loss>>: marks and context without loss, texts of loss roles with it."""

    def of(t: Column) -> Column:
        mark = F.concat(F.lit(template.open_), escape(t["role"]), F.lit(template.after_role))
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, of))


def format_chat(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """Per conversation: conv_id, formatted, segments, state, valid.

    Turns are ordered by turn, then role, then text, so ties have a fixed
    order; repeated rows are repeated turns. A null text or role is empty; an
    empty role is invalid to the machine but is formatted all the same, as are
    conversations with any other fault: ``valid`` only reports. Rows with a
    null conv_id form one conversation. Other columns are ignored; an empty
    table gives an empty table.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = grouped.select(
        "conv_id",
        segments(F.col("turns"), template).alias("segments"),
        final_state(F.transform("turns", lambda t: t["role"]), template).alias("state"),
    )
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "state", F.col("state").isin(*template.final).alias("valid"))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> of a formatted string: the inverse of the template."""
    turns = F.filter(F.split(formatted, F.lit(_literal(template.open_)), -1), lambda p: F.length(p) > 0)

    def of(p: Column) -> Column:
        body = F.left(p, F.length(p) - F.lit(len(template.close)))
        role = F.substring_index(body, template.after_role, 1)
        text = F.substring(body, F.length(role) + len(template.after_role) + 1, F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, of)


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in text)


def chat_report(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """What the formatted output says when it is read back: digests of its turns and of all text under the loss mask."""
    made = format_chat(conversations, template)
    said = F.array_join(F.transform(read_back(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = made.select("conv_id", "valid", "formatted", F.size(read_back(F.col("formatted"), template)).cast("long").alias("n_turns"), said.alias("said"), loss.alias("learned"))
    return read.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
