"""Chat formatting from event logs, in DataFrame operations only.

A log is partitioned by conversation and sorted by sequence.  Streamed deltas, edits and
regenerations are folded into final messages, which are rendered by a template with a loss mask
over assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import scratch_path

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Escapes of characters that begin control strings of chat templates; the first is undone last.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))
#: Kinds of events that set a message's text; a delta adds to it.
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Afterwards no control string is left: none of ``<``, ``[``, ``|``, and every backslash
    starts one of the escapes, so :func:`unescape` gives back the text."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, message, kind, role, text) to (conv_id, place, role, text).

    ``message`` and ``edit`` set a message's text, ``regenerate`` empties it to its own text and
    drops messages begun between the message and that event, ``delta`` adds its text.  A message
    stands where its first event does; its role is that of its last event that has one, or empty.
    Null texts are empty.  Events of equal ``seq`` are ordered by kind, then text; events of a
    null or unknown kind count as deltas, and a repeated delta adds its text again.
    """
    reset = F.when(F.col("kind").isin(*RESETS), F.col("seq"))
    again = F.when(F.col("kind") == "regenerate", F.col("seq"))
    per = Window.partitionBy("conv_id", "message")
    live = events.withColumns({"_reset": F.max(reset).over(per), "_first": F.min("seq").over(per), "_again": F.max(again).over(per), "_role": F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(per)})
    entry = F.struct("seq", (~F.coalesce(F.col("kind").isin(*RESETS), F.lit(False))).alias("delta"), "kind", F.coalesce("text", F.lit("")).alias("text"))
    grouped = live.where("_reset is null or seq >= _reset").groupBy("conv_id", "message", "_first", "_again", "_role").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    whole = grouped.select("conv_id", "message", "_first", "_again", F.coalesce("_role", F.lit("")).alias("role"), F.array_join(F.transform("e", lambda x: x.text), "").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("_first", "message")
    cover = F.max("_again").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = whole.withColumn("_cover", cover).where("_cover is null or _first > _cover")
    return kept.select("conv_id", F.struct("_first", "message").alias("place"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """messages (conv_id, place, role, text) to (conv_id, formatted, loss_spans).

    ``loss_spans`` are ascending [start, end) byte ranges of the UTF-8 output: the escaped texts
    of assistant messages.  A null conversation id is a conversation; an empty table has none.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(CLOSE))
    body = escape(F.coalesce("text", F.lit("")))
    parts = messages.select("conv_id", "place", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), body.alias("body"))
    turn = F.concat("head", "body", F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("place")
    before = F.sum(F.octet_length(turn).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.octet_length(turn)
    start = before + F.octet_length("head")
    placed = parts.withColumn("turn", turn).withColumn("start", start).withColumn("end", F.col("start") + F.octet_length("body"))
    span = F.when(F.col("role") == "assistant", F.struct("start", "end"))
    gathered = placed.select("conv_id", F.struct("place", "turn", span.alias("span")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    spans = F.filter(F.transform("t", lambda x: x.span), lambda s: s.isNotNull())
    return gathered.select("conv_id", F.array_join(F.transform("t", lambda x: x.turn), "").alias("formatted"), spans.alias("loss_spans"))


def parse(output: DataFrame) -> DataFrame:
    """Rendered rows with ``turns`` (role, text) and ``learnt``, the unescaped text under the mask."""
    cut = F.split("formatted", "\\Q" + END + "\\E")
    pieces = F.slice(cut, F.lit(1), F.size(cut) - 1)
    split = F.transform(pieces, lambda p: F.struct(F.substring_index(p, CLOSE, 1).alias("head"), p.alias("all")))
    turns = F.transform(
        split,
        lambda s: F.struct(
            unescape(F.substring(s["head"], F.lit(len(OPEN) + 1), F.length(s["head"]))).alias("role"),
            unescape(F.substring(s["all"], F.length(s["head"]) + len(CLOSE) + 1, F.length(s["all"]))).alias("text"),
        ),
    )
    raw = F.col("formatted").cast("binary")
    learnt = F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(raw, (s.start + 1).cast("int"), (s.end - s.start).cast("int")), "UTF-8")))
    return output.withColumn("turns", turns).withColumn("learnt", F.array_join(learnt, ""))


def events_of(rows: DataFrame) -> DataFrame:
    """A log with one event for each row (conv_id, turn, role, text); rows of a conversation are
    numbered by turn, then role, then text, so repeated turns stay messages of their own."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    return rows.select("conv_id", n.alias("seq"), n.alias("message"), F.lit("message").alias("kind"), "role", "text")


def log_of(rows: DataFrame) -> DataFrame:
    """The log of a service that came to the same rows (conv_id, turn, role, text) by streaming.

    Every message is begun with a draft.  An assistant's is regenerated, which drops a message that
    was begun meanwhile; another's is edited.  Either event brings the first third of the text and
    two streamed deltas the rest, so :func:`fold` has all its work to do to give back the rows.
    """
    plain = events_of(rows)
    text, n = F.coalesce("text", F.lit("")), F.col("message")
    third = F.ceil(F.length(text) / 3).cast("int")
    part = lambda k: F.substring(text, F.lit(1) + k * third, third)
    said = F.coalesce("role", F.lit("")) == "assistant"
    event = lambda at, message, kind, role, t: F.struct((8 * n + at).alias("seq"), message.alias("message"), F.lit(kind).alias("kind"), role.alias("role"), t.alias("text"))
    none = F.lit(None).cast("string")
    events = F.array(
        event(0, n, "message", F.col("role"), F.lit("a draft")), F.when(said, event(1, -n, "message", F.lit("user"), F.lit("meanwhile"))),
        F.when(said, event(2, n, "regenerate", none, part(0))).otherwise(event(2, n, "edit", none, part(0))), event(3, n, "delta", none, part(1)), event(4, n, "delta", none, part(2)),
    )
    return plain.select("conv_id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("conv_id", "e.*")


def write_and_read(events: DataFrame) -> DataFrame:
    """Render the log, write it to the shared folder and parse what is read back."""
    spark = events.sparkSession
    path = scratch_path(spark, "chat")
    out = render(fold(events))
    out.write.parquet(path)
    return parse(spark.read.schema(out.schema).parquet(path))


def digest(rows: DataFrame) -> DataFrame:
    """One row per conversation with the digest columns of its output, from rows (conv_id, turn,
    role, text) by way of a streamed log of them (:func:`log_of`).

    Null texts and roles are empty; a null conversation id is a conversation; repeated rows and
    turns are messages of their own, ordered by role, then text; other columns are left out; an
    empty table gives no rows."""
    back = write_and_read(log_of(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
