r"""Chat formatting with a grammar round trip.

A conversation is rendered as its turns one after the other, each between two marks:

    user        [INST] text [/INST]          (marks ``[INST]`` and ``[/INST]``, one space inside each)
    assistant   <s>text</s>
    system      <<SYS>>text<</SYS>>
    any other   <<TURN role>>text<</TURN>>    (the role percent-encoded)

The parser is one regular expression over the rendered text: a mark that opens, the shortest text,
the mark that closes. It removes one backslash from every control string that has one after its
first character. Each conversation is rendered plain, parsed again and compared with its source;
if the turns differ, every control string in its texts gets a backslash after its first character
(one more, if it has some already) and the round trip is made again. It must then be
identical, or the row stops the job. Plain content, backslashes and brackets included, stays as it is.

Only column expressions: one shuffle by conversation. A conversation's turns meet in one row, as
its text does. Nulls: a null text is empty, a null role is the empty role, rows without a
conversation id are one conversation, rows without a turn number come first. Equal turn numbers
are ordered by role and text; repeated rows are repeated turns. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What follows the first character of each control string.
_REST = r"INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>|<TURN |</TURN>>"
_CONTROL = rf"([\[<])(\\*(?:{_REST}))"
_ESCAPED = rf"([\[<])\\(\\*(?:{_REST}))"
# One turn: the mark that opens it, then text up to the mark that closes it.
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|<<TURN .*?<</TURN>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _marks(role: Column) -> tuple[Column, Column]:
    opening = (
        F.when(role == "user", "[INST] ")
        .when(role == "assistant", "<s>")
        .when(role == "system", "<<SYS>>")
        .otherwise(F.concat(F.lit("<<TURN "), F.url_encode(role), F.lit(">>")))
    )
    closing = (
        F.when(role == "user", " [/INST]")
        .when(role == "assistant", "</s>")
        .when(role == "system", "<</SYS>>")
        .otherwise("<</TURN>>")
    )
    return opening, closing


def _render(turns: Column, escaped: bool) -> Column:
    """Pieces of the rendered text: mark, content, mark, and whether the content is learned."""

    def piece(t: Column) -> Column:
        text = escape(t["text"]) if escaped else t["text"]
        opening, closing = _marks(t["role"])
        return F.struct(
            opening.alias("opening"),
            text.alias("text"),
            closing.alias("closing"),
            (t["role"] == "assistant").alias("learned"),
        )

    return F.transform(turns, piece)


def _joined(pieces: Column) -> Column:
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(p["opening"], p["text"], p["closing"])), ""
    )


def parse(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` of a rendered text."""

    def turn(piece: Column) -> Column:
        def inside(opening: str, closing: str) -> Column:
            size = len(opening) + len(closing)
            return F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - size)

        named = F.regexp_extract(piece, r"(?s)^<<TURN (.*?)>>(.*)<</TURN>>$", 1)
        other = F.regexp_extract(piece, r"(?s)^<<TURN (.*?)>>(.*)<</TURN>>$", 2)
        role = (
            F.when(piece.startswith("[INST]"), "user")
            .when(piece.startswith("<s>"), "assistant")
            .when(piece.startswith("<<SYS>>"), "system")
            .otherwise(F.url_decode(named))
        )
        text = (
            F.when(piece.startswith("[INST]"), inside("[INST] ", " [/INST]"))
            .when(piece.startswith("<s>"), inside("<s>", "</s>"))
            .when(piece.startswith("<<SYS>>"), inside("<<SYS>>", "<</SYS>>"))
            .otherwise(other)
        )
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def _spans(pieces: Column) -> Column:
    """``array<struct<start, length>>`` of the learned contents, in code points from 0."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["opening"])
        size = F.length(p["text"])
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct(
            (begin + size + F.length(p["closing"])).alias("at"),
            F.when(p["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(pieces, start, step, lambda s: s["spans"])


def format_conversations(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conversation``, ``formatted``, ``loss_spans`` and ``escaped`` of each conversation."""
    turns = F.transform(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(turn).alias("turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"),
                )
            )
        ),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
    )
    grouped = rows.groupBy(F.col(conversation)).agg(turns.alias("_turns"))
    plain = grouped.withColumn("_plain", _render(F.col("_turns"), False))
    plain = plain.withColumn("_formatted", _joined(F.col("_plain")))
    plain = plain.withColumn("escaped", ~parse(F.col("_formatted")).eqNullSafe(F.col("_turns")))
    done = plain.withColumn(
        "_pieces", F.when(F.col("escaped"), _render(F.col("_turns"), True)).otherwise(F.col("_plain"))
    ).withColumn("formatted", F.when(F.col("escaped"), _joined(F.col("_pieces"))).otherwise(F.col("_formatted")))
    same = ~F.col("escaped") | parse(F.col("formatted")).eqNullSafe(F.col("_turns"))
    return done.select(
        conversation,
        F.when(same, F.col("formatted"))
        .otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string"))
        .alias("formatted"),
        _spans(F.col("_pieces")).alias("loss_spans"),
        "escaped",
    )


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), ""
    )
