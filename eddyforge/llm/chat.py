"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. The parser is deterministic: a turn
starts at each ``<|im_start|>``, its role ends at the first newline, its text at the first
``<|im_end|>``. A turn that doesn't come back from the parser as it was is escaped: each ``<``,
run of backslashes, ``|`` gets one backslash more, which the parser takes away again. Then the whole
conversation is parsed again. If it isn't identical to its source, all its texts are escaped and it is
parsed once more; a conversation that still differs is an error and not a row. That can't happen: an
escaped text holds no control string and unescaping is its exact inverse.

All work on a conversation is linear in its length: offsets are running sums over its turns, and the
text under the loss mask is cut by byte offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
TURN = "array<struct<role:string,text:string>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", "<$1|")


def _role_out(c: Column) -> Column:
    """Roles are one line: percent signs and newlines are coded, control strings escaped."""
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, unescaped."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x, i: i > 0)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        rest = F.substring(x, F.char_length(role) + 2, F.char_length(x))
        return F.struct(_role_in(role).alias("role"), unescape(F.substring_index(rest, END, 1)).alias("text"))

    return F.transform(turns, turn)


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _role_out(role), F.lit("\n"), text, F.lit(END + "\n"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans (start, end in code points; first_byte, n_bytes of
    the same in UTF-8), identical, which is true.

    ``rows``: conv_id, turn, role, text. Turns are in the order of turn, then role, then text, nulls
    first; a null role or text is empty. The loss mask covers each assistant text and nothing else.
    A null conv_id is a conversation of its own; an empty table gives no rows. Repeated rows are repeated
    turns. Texts may be of any length, but a conversation is one value, so it must fit in one row. Further
    columns are not read.
    """
    empty = F.lit("")
    t = pick(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    own = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    same = parse(render_turn(F.col("role"), F.col("text"))) == own
    t = t.withColumn("same", same)
    t = t.withColumn("out", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))))
    done = materialize(rows.sparkSession, _joined(t), "chat")
    left = done.where("not identical").select(F.struct("conv_id").alias("left"))
    if left.isEmpty():
        return done
    again = t.join(left, F.col("conv_id").eqNullSafe(F.col("left.conv_id")), "left_semi").withColumn("out", escape(F.col("text")))
    again = _joined(again).withColumn("identical", F.when(F.col("identical"), F.lit(True)).otherwise(F.raise_error(F.lit("a conversation does not come back from its formatted text"))))
    return done.where("identical").unionByName(again)


def _joined(t: DataFrame) -> DataFrame:
    """Conversations from turns (conv_id, turn, role, text, out)."""
    t = t.withColumn("piece", render_turn(F.col("role"), F.col("out")))
    t = t.withColumn("head", F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n")))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)

    def begin(size) -> Column:
        return F.coalesce(F.sum(size("piece").cast("long")).over(earlier), F.lit(0).cast("long")) + size("head")

    t = t.withColumn("k", F.row_number().over(by)).withColumn("start", begin(F.char_length)).withColumn("first_byte", begin(F.octet_length))
    t = t.withColumn("end", F.col("start") + F.char_length("out")).withColumn("n_bytes", F.octet_length("out"))
    span = F.when(F.col("role") == LEARNED, F.struct("start", "end", "first_byte", "n_bytes"))
    g = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "role", "text", "piece"))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )
    g = g.withColumn("formatted", F.concat_ws("", F.transform("turns", lambda x: x["piece"])))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return g.select("conv_id", "formatted", "loss_spans", (parse(F.col("formatted")) == source).alias("identical"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From the formatted text alone: conv_id, turns, and the unescaped text under the loss mask."""
    # The bytes are bound once; cutting from them costs what is cut, not what lies before it.
    bound = F.array(F.struct(F.col("formatted").cast("binary").alias("bytes"), F.col("loss_spans").alias("spans")))
    cut = lambda b, s: unescape(F.substring(b["bytes"], (s["first_byte"] + 1).cast("int"), s["n_bytes"]).cast("string"))
    loss = F.get(F.transform(bound, lambda b: F.concat_ws("", F.transform(b["spans"], lambda s: cut(b, s)))), F.lit(0))
    return formatted.select("conv_id", "formatted", "identical", parse(F.col("formatted")).alias("turns"), loss.alias("loss_text"))
