"""Chat formatting with SQL functions alone.

A declarative template says how a turn is marked and which roles are learnt
from.  A finite-state machine over roles, folded over each conversation's
turns, says whether the turn order is valid.  The output of a conversation is
a list of text segments with a loss flag each; their concatenation is the
formatted text.  Inside texts `&` and `<|` are escaped, so a text can't forge a
marker, and `unescape` gives the text back.

Defined results: a null text is empty; a null role is the empty role, which no
transition accepts; turns that tie are ordered by role, then text; rows that
repeat stay as turns of their own; a null conv_id is a conversation like any
other; an invalid conversation is formatted too, with valid = false; extra
columns are ignored.  One conversation is one output row, so its turns meet in
one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Template:
    """opening + role + header_end + text + closing for each turn; loss falls on texts of loss_roles."""

    opening: str = OPEN
    header_end: str = "\n"
    closing: str = CLOSE + "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )


def escape(text: Column) -> Column:
    """No marker remains: `&` becomes `&amp;` and `<|` becomes `&lt;|`."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """As escape; a line feed would end the header, so it's escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def final_state(turns: Column, template: Template) -> Column:
    """The machine's state after all turns; `reject` once a role isn't allowed."""
    step = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}>{role}", to)])
    return F.aggregate(
        turns,
        F.lit(template.start),
        lambda state, turn: F.coalesce(F.try_element_at(step, F.concat(state, F.lit(">"), turn["role"])), F.lit("reject")),
    )


def segments_of(turn: Column, template: Template) -> Column:
    """Three segments of a turn: header, text, closing."""

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return F.array(
        segment(F.concat(F.lit(template.opening), escape_role(turn["role"]), F.lit(template.header_end)), F.lit(False)),
        segment(escape(turn["text"]), turn["role"].isin(*template.loss_roles)),
        segment(F.lit(template.closing), F.lit(False)),
    )


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, valid, segments (text, loss) and formatted text of each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        conversations.select("conv_id", turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            final_state(F.col("turns"), template).isin(*template.accepting).alias("valid"),
            F.flatten(F.transform("turns", lambda t: segments_of(t, template))).alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text holds."""
    parts = F.filter(F.split(formatted, _quoted(template.closing)), lambda x: F.startswith(x, F.lit(template.opening)))

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(template.opening) + 1))
        end = F.instr(body, F.lit(template.header_end))
        return F.struct(
            unescape_role(F.substr(body, F.lit(1), end - 1)).alias("role"),
            unescape(F.substr(body, end + len(template.header_end))).alias("text"),
        )

    return F.transform(parts, turn)


def _quoted(marker: str) -> str:
    return "".join("\\" + c if c in "<|>[](){}.*+?^$\\" else c for c in marker)


def chat_digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and digests of what the formatted output holds."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return (
        formatted.withColumn("back", read_back(F.col("formatted"), template))
        .withColumn("loss_text", loss)
        .select(
            "conv_id",
            F.size("back").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )
