"""Chat formatting with a grammar round trip.

A conversation is rendered with control strings around each turn, parsed again
by a deterministic parser and compared with its source. Where they differ,
some content imitates the template; that conversation is escaped and goes
through the same check. All of it is built-in functions.

    conversation := turn*
    turn         := START role NEWLINE text END NEWLINE
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import pick

START = "<|im_start|>"
END = "<|im_end|>"
CLOSE = END + "\n"


def escape_text(text: Column) -> Column:
    """One backslash more between any ``<`` and ``|`` that are apart by backslashes only."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def render(turns: Column, escaped: bool) -> Column:
    def one(turn: Column) -> Column:
        role, text = turn["role"], turn["text"]
        if escaped:
            role, text = escape_role(role), escape_text(text)
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(CLOSE))

    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """Turns (role, text) by the grammar; null in place of a turn that breaks it."""

    def one(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        end = F.instr(piece, END)
        closed = end == F.length(piece) - len(CLOSE) + 1
        opened = (F.instr(piece, "\n") > 0) & (F.instr(piece, "\n") < end)
        ends = F.substring(piece, -1, 1) == "\n"
        text = F.substring(piece, F.length(role) + F.lit(2), F.length(piece) - F.length(role) - F.lit(1 + len(CLOSE)))
        return F.when(
            closed & opened & ends,
            F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text")),
        )

    pieces = F.split(rendered, r"<\|im_start\|>", -1)
    # What stands before the first turn must be nothing; otherwise it counts as a broken turn.
    turns = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), one)
    return F.when(F.element_at(pieces, 1) == "", turns)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, formatted, escaped, turns, loss.

    Rows are ordered by turn (null first), then role, then text; null role and
    null text are empty; a null conv_id is a conversation of its own. ``turns``
    is what the parser reads back from ``formatted``, ``loss`` the mask of
    ``loss_spans`` for the assistant's texts. ``escaped`` tells whether
    the plain rendering failed the round trip. A rendering that fails it even
    then raises. A conversation is one string, so it must fit in a task. Extra
    columns are not read; without rows the result is empty.
    """
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("source"))
    source = gathered.select(
        "conv_id",
        F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    plain = source.withColumn("plain", render(F.col("source"), escaped=False))
    checked = plain.withColumn("escaped", ~parse(F.col("plain")).eqNullSafe(F.col("source")))
    formatted = checked.withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("source"), escaped=True)).otherwise(F.col("plain"))
    )
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns").eqNullSafe(F.col("source"))
    sound = F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("no round trip: "), F.col("conv_id").cast("string")))
    )
    read = parsed.select("conv_id", sound.alias("formatted"), "escaped", "turns")
    return read.withColumn("loss", loss_spans(F.col("formatted")))


def loss_spans(formatted: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Code point spans (start, end) of the trained texts inside ``formatted``, escapes included."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<role:string,start:int,end:int>>").alias("spans")
    )

    def step(state: Column, piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        start = state["at"] + F.lit(len(START)) + F.length(role) + F.lit(1)
        after = state["at"] + F.lit(len(START)) + F.length(piece)
        span = F.struct(
            unescape_role(role).alias("role"), start.alias("start"), (after - F.lit(len(CLOSE))).alias("end")
        )
        return F.struct(after.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    spans = F.aggregate(inner, zero, step, lambda state: state["spans"])
    trained = F.filter(spans, lambda s: s["role"].isin(*roles))
    return F.transform(trained, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def text_under(formatted: Column, spans: Column) -> Column:
    """The texts that the spans cut from ``formatted``, unescaped and joined."""
    cut = F.transform(
        spans, lambda s: unescape_text(F.substring(formatted, s["start"] + F.lit(1), s["end"] - s["start"]))
    )
    return F.array_join(cut, "")
