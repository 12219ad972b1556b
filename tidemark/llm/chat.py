"""Chat formatting with a grammar round trip, in DataFrame functions only.

    formatted := turn*        turn := <|im_start|> role \\n text <|im_end|> \\n

Every turn is rendered plainly, parsed back and compared with its source. A turn that does not come back is rendered
with the next stricter escape until it does: first the openers of control strings, then the escape sign too. The last one
always round-trips, as no control string and no bare escape sign is left in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

START, END = "<|im_start|>", "<|im_end|>"
#: What each escape level replaces, strictest last. Undone in reverse order.
SIGN = ("%", "%25")
OPENER = ("<|", "%3C|")
BREAK = ("\n", "%0A")


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def unescape(text: Column) -> Column:
    return _replaced(text, ("%3C|", "<|"), SIGN[::-1])


def _role(text: Column) -> Column:
    return _replaced(text, SIGN, OPENER, BREAK)


def _unescaped_role(text: Column) -> Column:
    return _replaced(text, ("%0A", "\n"), ("%3C|", "<|"), SIGN[::-1])


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string as array<struct<role, text, lead, size>>: code points of a turn
    before its escaped text, and with it, without the end mark. Null where the grammar does not hold."""
    # The pieces between turns: after the last end mark only the line feed is left.
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    body = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, len(START) + 1, 2147483647)
        at = F.instr(rest, "\n")
        raw = F.substr(rest, at + 1)
        return F.struct(
            _unescaped_role(F.substr(rest, F.lit(1), at - 1)).alias("role"),
            unescape(raw).alias("text"),
            (F.length(piece) - F.length(raw)).alias("lead"),
            F.length(piece).alias("size"),
        )

    def fits(piece: Column) -> Column:
        rest = F.substring(piece, len(START) + 1, 2147483647)
        return F.startswith(piece, F.lit(START)) & (F.instr(rest, "\n") > 0) & ~F.contains(rest, F.lit("<|"))

    whole = (F.element_at(pieces, -1) == "") & F.forall(body, fits)
    return F.when(whole, F.transform(body, turn))


def format_turn(role: Column, text: Column) -> Column:
    """A turn's rendering at the first escape level that parses back to the source."""
    levels = [text, _replaced(text, OPENER), _replaced(text, SIGN, OPENER)]
    turns = [_turn(_role(role), x) for x in levels]

    def back(turn: Column) -> Column:
        got = parse(turn)
        return F.coalesce((F.size(got) == 1) & (got[0]["role"] == role) & (got[0]["text"] == text), F.lit(False))

    rendered = F.when(back(turns[0]), turns[0]).when(back(turns[1]), turns[1]).otherwise(turns[2])
    return rendered


def format_chats(
    conversations: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned: str = "assistant",
) -> DataFrame:
    """(conv_id, formatted, loss_spans, round_trip), a row per conversation.

    Turns are in order of ``turn``, ties by role, then text; null turns come first, null roles and texts are empty, rows
    that repeat are turns of their own, a null conv_id is a conversation. ``loss_spans`` are (start from 1, size) in code
    points of the escaped texts of role ``learned`` in ``formatted``. ``round_trip`` says that the whole string parses
    back to exactly the source turns. An empty table gives no rows. Other columns are ignored.

    A conversation becomes one string, so its turns meet in one row; turns are rendered before that, where they are.
    """
    rows = conversations.select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rendered = format_turn(F.col("role"), F.col("text"))
    turns = rows.select("conv_id", F.struct("turn", "role", "text", rendered.alias("rendered")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    formatted = whole.select("conv_id", "turns", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"))
    parsed = formatted.withColumn("parsed", parse(F.col("formatted")))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    back = F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return parsed.select(
        "conv_id",
        "formatted",
        loss_spans(F.col("parsed"), learned).alias("loss_spans"),
        F.coalesce(source == back, F.lit(False)).alias("round_trip"),
    )


def loss_spans(parsed: Column, learned: str) -> Column:
    """array<struct<start, size>> of the texts under the loss mask, in order."""
    gap = len(END) + 1
    empty = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start:int,size:int>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        span = F.struct((state["at"] + t["lead"]).alias("start"), (t["size"] - t["lead"]).alias("size"))
        spans = F.when(t["role"] == learned, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + t["size"] + gap).alias("at"), spans.alias("spans"))

    return F.aggregate(parsed, empty, step, lambda state: state["spans"])


def store_chats(formatted: DataFrame) -> DataFrame:
    """The formatted conversations, written to the shared folder and read back."""
    return stage(formatted, "chats")
