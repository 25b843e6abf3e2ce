r"""Chat formatting from a declarative template (DataFrame functions only).

A finite-state machine over roles validates the turn order.  Each turn gives
segments with a loss flag; a conversation's formatted text is its segments
one after another.  Control strings inside a text are escaped reversibly: a
backslash is doubled and ``<|`` becomes ``<\|``, so an escaped text never
holds a control string.  Roles are percent-encoded.  :func:`read_back` parses
turns and loss text from the output again.

A conversation is one training example and is put together in one row; its
rows meet by ``conv_id`` only.

Defined results: turns are ordered by turn (null first), then role, then
text; repeated rows are turns of their own; null roles and texts are empty;
a null ``conv_id`` is a conversation of its own; empty tables give no rows;
an invalid turn order is reported (``valid``, ``bad_turn``), and the
conversation is formatted all the same; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, the roles under the loss, and the machine: (state, role) -> next state."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
            ("answered", "tool"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        if not (self.begin.startswith("<|") and self.end.startswith("<|") and self.after_role):
            raise ValueError("control strings begin with '<|', and something must follow a role")


CHATML = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _walk(turns: Column, t: Template) -> Column:
    """Runs the machine: final state (empty after a wrong turn) and the first wrong turn's position (or -1)."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state} {role}", to)])
    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(acc["state"], F.lit(" "), turn["role"])), F.lit(""))
        bad = F.when((to == "") & (acc["bad"] < 0), acc["at"]).otherwise(acc["bad"])
        return F.struct(to.alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(turns, begin, step)


def format_conversations(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """``conv_id, valid, bad_turn, segments (array of text, loss), formatted``: one row per conversation."""
    t = template
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")))).alias("turns")
    )
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.begin), F.url_encode(x["role"]), F.lit(t.after_role)), F.lit(False)),
                segment(escape(x["text"]), x["role"].isin(*t.loss_roles)),
                segment(F.lit(t.end + t.after_turn), F.lit(False)),
            ),
        )
    )
    walk = _walk(F.col("turns"), t)
    return (
        turns.withColumn("_walk", walk)
        .withColumn("segments", parts)
        .select(
            "conv_id",
            ((F.col("_walk.bad") < 0) & F.col("_walk.state").isin(*t.final)).alias("valid"),
            F.nullif(F.col("_walk.bad"), F.lit(-1)).alias("bad_turn"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        )
    )


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Adds ``turns`` (role, text), parsed from the formatted text, and ``loss_text``, from the flagged segments."""
    t = template
    rule = f"(?s){_quoted(t.begin)}(.*?){_quoted(t.after_role)}(.*?){_quoted(t.end + t.after_turn)}"
    got = lambda group: F.regexp_extract_all("formatted", F.lit(rule), F.lit(group))
    pair = F.zip_with(got(1), got(2), lambda role, text: F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text")))
    flagged = F.filter("segments", lambda s: s["loss"])
    return formatted.withColumn("turns", pair).withColumn(
        "loss_text", F.array_join(F.transform(flagged, lambda s: unescape(s["text"])), "")
    )


def digest(read: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`read_back` found."""
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
