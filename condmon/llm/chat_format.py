"""Chat formatting with a finite-state machine over roles, in DataFrame functions only.

A declarative template gives the control strings, the roles under the loss and the allowed
steps from role to role. Each conversation becomes an array of text segments with loss flags and
one formatted text. Control strings inside texts are escaped, and ``read_back`` recovers roles
and texts from the formatted text alone.

Escape: ``<``, any number of ``~``, ``|`` gets one more ``~``; so no escaped text holds ``<|``,
and taking one ``~`` away restores it. In roles a line feed is written ``<|nl|>``.

A conversation is the unit of the output and is formatted in one row; its rows meet in one
group, as a conversation's length is bounded by what a model reads.

Defined cases: null texts and roles count as empty; turns are ordered by turn, then role and
text, null turns first; repeated rows are repeated turns; a null conv_id is a conversation of its
own; a conversation that breaks the turn order is formatted, and ``violation`` says where; texts of any
length are kept whole; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, require


@dataclass(frozen=True)
class Template:
    """Turns read ``start role separator text end``."""

    start: str = "<|im_start|>"
    separator: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    begin: str = "begin"
    steps: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"begin": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", "<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", "<$1|")


def machine(turns: Column, template: Template) -> Column:
    """Run the machine over (turn, role, text) structs: segments (text, loss), and ``violation``.

    The state is the role last seen. Each step checks that the turn may follow; ``violation:N`` names the first turn that
    may not, ``violation:end`` a state that may not be the last. The three segments that entering a state emits are laid out turn
    by turn beside the walk, so no step copies what came before.
    """
    steps = F.array(*[F.lit(f"{a}\n{b}") for a, after in template.steps.items() for b in after])
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def emitted(turn: Column) -> Column:
        head = F.concat(F.lit(template.start), F.replace(escape(turn["role"]), F.lit("\n"), F.lit("<|nl|>")), F.lit(template.separator))
        return F.array(segment(head, F.lit(False)), segment(escape(turn["text"]), turn["role"].isin(*template.loss_roles)), segment(F.lit(template.end), F.lit(False)))

    def step(state: Column, turn: Column) -> Column:
        ok = F.array_contains(steps, F.concat(state["at"], F.lit("\n"), turn["role"]))
        bad = F.when(state["bad"] >= 0, state["bad"]).when(ok, F.lit(-1)).otherwise(state["n"])
        return F.struct((state["n"] + 1).alias("n"), turn["role"].alias("at"), bad.alias("bad"))

    def finish(state: Column) -> Column:
        wrong = F.when(state["bad"] >= 0, F.concat(F.lit("violation:"), state["bad"].cast("string")))
        wrong = wrong.when(~state["at"].isin(*template.final), F.lit("violation:end")) if template.final else wrong
        return wrong

    zero = F.struct(F.lit(0).alias("n"), F.lit(template.begin).alias("at"), F.lit(-1).alias("bad"))
    return F.struct(F.flatten(F.transform(turns, emitted)).alias("segments"), F.aggregate(turns, zero, step, finish).alias("violation"))


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, segments (text, loss), formatted, loss_spans (start from 1 and length, in characters and in UTF-8 bytes), violation."""
    require(rows, "conv_id", "turn", "role", "text")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # One struct in an array of its own, so that the machine runs once for both of its results.
    chats = chats.select("conv_id", F.inline(F.array(machine(F.col("turns"), template))))
    span = "struct<start:bigint,length:bigint,byte_start:bigint,byte_length:bigint>"

    def place(state: Column, s: Column) -> Column:
        n, b = F.length(s["text"]).cast("long"), F.octet_length(s["text"]).cast("long")
        mine = F.array(F.struct((state["at"] + 1).alias("start"), n.alias("length"), (state["byte"] + 1).alias("byte_start"), b.alias("byte_length")))
        return F.struct((state["at"] + n).alias("at"), (state["byte"] + b).alias("byte"), F.when(s["loss"], F.concat(state["spans"], mine)).otherwise(state["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("byte"), F.expr(f"cast(array() as array<{span}>)").alias("spans"))
    return chats.select(
        "conv_id",
        "segments",
        F.array_join("segments.text", "").alias("formatted"),
        F.aggregate("segments", zero, place, lambda s: s["spans"]).alias("loss_spans"),
        "violation",
    )


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, turns (role, text) parsed from the formatted text, loss_texts cut at the spans, formatted, violation."""
    pieces = F.slice(F.split("formatted", _literal(template.start)), 2, 2**30)

    def parse(p: Column) -> Column:
        at = F.locate(template.separator, p)
        role = F.replace(F.substring(p, F.lit(1), at - 1), F.lit("<|nl|>"), F.lit("\n"))
        text = F.substring(p, at + len(template.separator), F.length(p) - at - len(template.separator) + 1 - len(template.end))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    # By bytes, as finding a character counts from the text's start.
    part = lambda f, s: F.substring(f, s["byte_start"].cast("int"), s["byte_length"].cast("int")).cast("string")
    cut = let(F.col("formatted").cast("binary"), lambda f: F.transform("loss_spans", lambda s: unescape(part(f, s))))
    return formatted.select("conv_id", F.transform(pieces, parse).alias("turns"), cut.alias("loss_texts"), "formatted", "violation")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
