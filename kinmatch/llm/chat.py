"""Chat formatting: a finite-state machine over roles and a declarative template, in Catalyst only.

A conversation's turns are ordered by (turn, role, text), a null turn first, so ties and repeated
rows have one order and none is lost. The machine walks the roles and reports the first turn
without a transition; such a conversation is still formatted, with valid = false. The template
gives each turn three segments: head and tail without loss, and the text, whose loss flag is that
of its role. Control strings cannot occur in an escaped text or role, and escaping is undone by
`unescaped` exactly.

Defined results: a null text or role is an empty one (an empty role is invalid); rows with a null
conversation form one conversation; an empty table gives an empty one; other columns are not read.
A conversation's row holds its whole text, which the output asks for; it grows linearly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )
    accept: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escaped(text: Column, role: bool = False) -> Column:
    """Without "<|" (and line feeds, in a role). Every & of the result begins &amp;, &lt; or &nl;."""
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(out, F.lit("\n"), F.lit("&nl;")) if role else out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = CHATML) -> DataFrame:
    """conv, segments array<struct<text, loss>>, formatted, valid, bad_turn (from 0, null if none)."""
    t, lit = template, F.lit
    rows = df.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, lit("")).alias("role"), F.coalesce(text, lit("")).alias("text")).alias("row"))
    turns = rows.groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    moves = F.create_map(*(x for (state, on), to in t.moves.items() for x in (F.concat_ws("\x00", lit(state), lit(on)), lit(to))))
    first = F.struct(lit(t.start).alias("state"), lit(0).alias("at"), lit(None).cast("int").alias("bad"))

    def move(acc: Column, row: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws("\x00", acc["state"], row["role"]))
        bad = F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"])
        return F.struct(F.coalesce(to, lit("")).alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    def parts(row: Column) -> Column:
        head = F.concat(lit(t.begin), escaped(row["role"], True), lit(t.after_role))
        segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(segment(head, lit(False)), segment(escaped(row["text"]), row["role"].isin(*t.loss_roles)), segment(lit(t.end), lit(False)))

    out = turns.select("conv", F.flatten(F.transform("turns", parts)).alias("segments"), F.aggregate("turns", first, move).alias("end"))
    return out.select(
        F.col("conv").alias(conv), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("end.bad").isNull() & F.col("end.state").isin(*t.accept)).alias("valid"), F.col("end.bad").alias("bad_turn"),
    )


def read_back(chats: DataFrame, conv: str = "conv_id", template: Template = CHATML) -> DataFrame:
    """conv, turns array<struct<role, text>> parsed from the formatted text, loss_text and what stood there."""
    t = template
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in t.begin)
    pieces = F.slice(F.split("formatted", quoted), 2, F.length("formatted") + 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, t.after_role, 1)
        text = F.substr(piece, F.length(role) + len(t.after_role) + 1, F.length(piece) - F.length(role) - len(t.after_role) - len(t.end))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return chats.select(conv, F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"), "formatted", "valid")
