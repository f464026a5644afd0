r"""Chat training texts from event logs, in DataFrame operations only.

A log tells how a conversation came about: messages are opened, their texts
arrive in pieces, are edited or generated again. The fold into final messages
is stated as what later events leave of earlier ones, so that it needs no loop:
of a turn's texts those count that no later opening, edit or regeneration of
the turn replaces, and nothing counts that a later regeneration of an earlier
turn has cut off. Logs are partitioned by conversation once; the fold, the
offsets and the rendered text all use that partitioning.

The template puts each turn between ``### role`` and ``</turn>``. Both strings
and the backslash are written with a backslash and a letter inside texts, which
plain replacement undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.llm.common import table

#: Kinds of events. MESSAGE opens a turn (role, first text), DELTA appends, EDIT replaces, REGENERATE empties the turn and cuts off all later ones.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"

START, END = "### ", "\n</turn>\n"
#: What is escaped inside texts, the backslash first; in roles the line feed too.
ESCAPES = (("\\", "\\s"), (START, "\\h## "), ("</turn>", "\\l/turn>"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))
LEARNED = "assistant"
PIECE = 4096


def escaped(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """The text with control strings escaped; unescaped() gives it back."""
    for plain, written in escapes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Every backslash of an escaped text begins an escape, so the order only matters for the backslash, which comes last."""
    for plain, written in reversed(escapes):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def events_of(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The log (conv_id, seq, kind, turn, role, text) of a table of finished turns: each is opened, then streamed in pieces.

    Rows are in the order of turn (null first), then role and text; rows of the
    same turn are turns of their own. Null texts and roles are empty.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))  # in one pass, whatever the length
    opened = F.struct(F.lit(MESSAGE).alias("kind"), F.lit("").alias("text"))
    streamed = F.transform(pieces, lambda p: F.struct(F.lit(DELTA).alias("kind"), p.alias("text")))
    numbered = rows.withColumn("turn", at).select("conv_id", "turn", "role", F.posexplode(F.concat(F.array(opened), streamed)).alias("i", "event"))
    return numbered.select("conv_id", (F.shiftleft("turn", 32) + F.col("i")).alias("seq"), "event.kind", "turn", "role", "event.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, kind, turn, role, text).

    Events of a conversation count in the order of seq; at equal seq openings,
    edits and regenerations come before pieces, then by text, and a repeated
    event counts again. A null kind is a piece, a null text or role is empty; a
    null conversation is one of its own, events without turn or seq are left
    out. A turn that has only pieces exists, its role is empty. A turn that was
    cut off exists again if later events name it. Other columns are ignored; an
    empty log gives no messages.
    """
    kind = F.coalesce("kind", F.lit(DELTA))
    log = events.where(F.col("turn").isNotNull() & F.col("seq").isNotNull()).select("conv_id", "seq", "turn", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    cut = F.max(F.when(F.col("kind") == REGENERATE, F.col("seq"))).over(by_turn.rangeBetween(Window.unboundedPreceding, -1))  # regenerations of earlier turns
    alive = log.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    resets = F.col("kind").isin(MESSAGE, EDIT, REGENERATE)
    last = F.max(F.when(resets, F.col("seq"))).over(Window.partitionBy("conv_id", "turn"))
    kept = alive.withColumn("last", last)
    counts = (F.col("kind") != REGENERATE) & (F.col("last").isNull() | (F.col("seq") >= F.col("last")))
    parts = F.sort_array(F.collect_list(F.when(counts, F.struct("seq", (~resets).alias("later"), "text"))))
    role = F.max_by(F.when(F.col("kind") == MESSAGE, F.col("role")), F.when(F.col("kind") == MESSAGE, F.struct("seq", "role")))
    return kept.groupBy("conv_id", "turn").agg(F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, loss) of messages (conv_id, turn, role, text): the text to train on and the spans under the loss mask.

    Spans are (start, end) in code points of ``formatted``, one for each turn of
    the learned role, around its escaped text alone. Null texts and roles are
    empty; a repeated turn stands twice, by role and text.
    """
    head = F.concat(F.lit(START), escaped(F.coalesce("role", F.lit("")), ROLE_ESCAPES), F.lit("\n"))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(size.cast("long")).over(order), F.lit(0)) + F.char_length("head"))
    span = F.struct("start", (F.col("start") + F.char_length("body")).alias("end"))
    turns = F.sort_array(F.collect_list(F.struct("start", F.concat("head", "body", F.lit(END)).alias("whole"))))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(turns, lambda t: t["whole"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == learned, span))).alias("loss"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, learned) of rendered conversations: roles and texts, and the texts under the mask, unescaped."""
    parts = F.split("formatted", END)  # END has no character that a pattern reads otherwise
    turn = lambda t: F.struct(
        unescaped(F.substring(F.substring_index(t, "\n", 1), len(START) + 1, 1 << 30), ROLE_ESCAPES).alias("role"),
        unescaped(F.substr(t, F.char_length(F.substring_index(t, "\n", 1)) + F.lit(2))).alias("text"),
    )
    return rendered.select(
        "conv_id",
        "formatted",
        F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("learned"),
    )


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings: logged, folded, rendered and read back."""
    text = r"\### Assistant: </turn> ok"
    odd = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit(LEARNED))).alias("turn", "role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd.withColumn("turn", F.col("turn").cast("long")))
    read = read_back(render(reconstruct(events_of(rows))))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length('### ') + length(role) + length(text) + length(chr(10)) * 3 + length('</turn>')
            + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
            + length(role) - length(replace(role, chr(10), ''))
            + (length(role) - length(replace(role, '### ', '')) + length(text) - length(replace(text, '### ', ''))) // 4
            + (length(role) - length(replace(role, '</turn>', '')) + length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
