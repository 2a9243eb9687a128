"""Chat formatting [native]: conversations become segments of text with a loss flag each.

A declarative ``Template`` names the marks around a turn, the roles whose text is trained on, and the turns that may follow one
another: a finite-state machine whose table is plain data. All steps are built-in DataFrame functions.

A turn is ``open role \\n text close``. Inside roles and texts, control strings are escaped so that no mark can arise there:
a backslash doubles, then the marks' first two characters ``<|`` become ``<\\|``; in roles a line end also becomes
``<\\+``. Undone in the reverse order, this gives every text back.

Turns are ordered by turn, then role, then text, nulls first. A null text or role counts as empty. Rows with equal columns stay
separate turns. A conversation whose turns the machine refuses is formatted all the same, with ``valid`` false. Rows with a null
conv_id form one conversation. No rows give no conversations. Extra columns are ignored.

One conversation is one row, as it is one training example: its turns are gathered by one task, and its text must fit a row (2 GB in Spark). A table
whose rows share one conv_id, null among them, is one conversation and isn't spread. What is trained on is read from the segments, whose flags
are part of the output; turns are read back from the formatted text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    after_close: str = "\n"
    trained: tuple[str, ...] = ("assistant",)
    #: role after role (or START) that the machine accepts
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    #: roles that may end a conversation
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not (self.open.startswith("<|") and self.close.startswith("<|")):
            raise ValueError("marks begin with <|, which texts have escaped")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\+"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\+"), F.lit("\n")))


def _valid(roles: Column, t: Template) -> Column:
    """Run the machine over the roles; state null is refusal."""
    table = F.create_map(*(F.lit(x) for a, bs in t.follows.items() for b in bs for x in (f"{a}\n{b}", b)))
    last = F.aggregate(roles, F.lit(START), lambda state, role: F.when(state.isNotNull(), F.try_element_at(table, F.concat(state, F.lit("\n"), role))))
    return F.coalesce(last.isin(*t.ends), F.lit(False))


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, valid, segments array<struct<text, loss>>) of ``conversations(conv_id, turn, role, text)``."""
    t = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def emitted(x: Column) -> Column:
        head = F.struct(F.concat(F.lit(t.open), escape_role(x["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss"))
        body = F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.trained).alias("loss"))
        tail = F.struct(F.lit(t.close + t.after_close).alias("text"), F.lit(False).alias("loss"))
        return F.array(head, body, tail)

    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _valid(F.transform("turns", lambda x: x["role"]), t).alias("valid"),
        F.flatten(F.transform("turns", emitted)).alias("segments"),
    )


def formatted(segmented: DataFrame) -> DataFrame:
    """Adds ``formatted``, all segments joined."""
    return segmented.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(text: Column, template: Template | None = None) -> Column:
    """Turns array<struct<role, text>> that a formatted conversation holds."""
    t = template or Template()
    pieces = F.split(text, "\\Q" + t.open + "\\E")
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    end = len(t.close + t.after_close)

    def turn(piece: Column) -> Column:
        at = F.locate("\n", piece)
        return F.struct(
            unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(piece, at + 1, F.char_length(piece) - at - F.lit(end))).alias("text"),
        )

    return F.transform(pieces, turn)


def digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted conversations hold, read back from them, and whether the machine accepts them."""
    out = formatted(segments(conversations, template)).withColumn("turns", read_back(F.col("formatted"), template))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    trained = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    out = out.withColumn("trained", trained)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
