"""Sessions in batch: what was asked last, what was replied, and what the view is told."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.classify import code_blocks
from quarrykit.functions.textfn import contains_code, trim_all
from quarrykit.operators.reply import save_form, saved_row
from quarrykit.session import cut_lineage

#: Events of one chunk; a long session is carried forward chunk by chunk.
CHUNK_EVENTS = 1_000


def delivered_once(events: DataFrame) -> DataFrame:
    """One row per (session_id, seq): the one that arrived first, copies of later deliveries dropped."""
    first = events.groupBy("session_id", "seq").agg(F.min("arrived_at").alias("arrived_at"))
    same = ["session_id", "seq", "arrived_at"]
    return events.join(first, same, "left_semi").dropDuplicates(same)


def _chunked(rows: DataFrame, chunk: int) -> DataFrame:
    return rows.withColumn("__chunk", F.floor(F.col("__at") / chunk))


def _last_before(rows: DataFrame, chunk: int, levels: int) -> DataFrame:
    """(session_id, __at, __before): the last non-null ``__value`` of the session at a lesser ``__at``."""
    order = Window.partitionBy("session_id").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        return rows.select("session_id", "__at", F.last("__value", ignorenulls=True).over(order).alias("__before"))
    cut = _chunked(rows, chunk)
    inside = Window.partitionBy("session_id", "__chunk").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("session_id", "__at", "__chunk", F.last("__value", ignorenulls=True).over(inside).alias("__own"))
    ends = cut.groupBy("session_id", F.col("__chunk").alias("__at")).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__at"))).alias("__value"))
    starts = _last_before(ends, chunk, levels - 1).withColumnRenamed("__at", "__chunk")
    return own.join(starts, ["session_id", "__chunk"]).select("session_id", "__at", F.coalesce("__own", "__before").alias("__before"))


def carry_forward(events: DataFrame, value: Column, name: str, chunk: int = CHUNK_EVENTS, levels: int = 2) -> DataFrame:
    """Each event with the last non-null ``value`` of its session up to and including it.

    ``(session_id, seq)`` is unique. Sessions are cut into chunks of ``chunk``
    consecutive ``seq``, and these into chunks again, ``levels`` times. Chunks
    are worked on apart, so a session that holds a third of all events is spread
    over many tasks; what a chunk starts with is found on one row per chunk. A
    session without a value so far has null. Null sessions are left out.
    """
    valued = events.where("session_id IS NOT NULL").withColumn("__value", value)
    before = _last_before(valued.select("session_id", F.col("seq").alias("__at"), "__value"), chunk, levels)
    joined = valued.join(before.withColumnRenamed("__at", "seq"), ["session_id", "seq"])
    return joined.withColumn(name, F.coalesce("__value", "__before")).drop("__value", "__before")


def numbered(rows: DataFrame, name: str = "n", chunk: int = CHUNK_EVENTS) -> DataFrame:
    """Each row with its place, from 1, among its session's rows by ``seq``, counted chunk by chunk."""
    cut = _chunked(rows.withColumn("__at", F.col("seq")), chunk)
    before = Window.partitionBy("session_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("session_id", "__chunk").agg(F.count(F.lit(1)).alias("__n")).select("session_id", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("session_id", "__chunk").orderBy("seq"))
    return cut.withColumn("__own", inside).join(starts, ["session_id", "__chunk"]).withColumn(name, F.col("__own") + F.col("__start")).drop("__at", "__chunk", "__own", "__start")


def numbered_by(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Each row with its place, from 1, among its session's rows by ``order``, whatever type that has.

    ``(session_id, order)`` is unique. Rows are put in ranges of session and
    order, so a session of any size lies over many tasks; a range is numbered
    from the count of the session's rows in the ranges before it. The ranges are
    written once, so that a lost task cannot move their bounds. Rows of a null
    session are numbered among themselves.
    """
    cut = cut_lineage(rows.repartitionByRange("session_id", order).withColumn("__chunk", F.spark_partition_id()))
    before = Window.partitionBy("session_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("session_id", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(F.col("session_id").alias("__session"), F.col("__chunk").alias("__range"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = cut.withColumn("__own", F.row_number().over(Window.partitionBy("session_id", "__chunk").orderBy(order)))
    met = own.join(starts, F.col("session_id").eqNullSafe(F.col("__session")) & (F.col("__chunk") == F.col("__range")))
    return met.withColumn(name, F.col("__own") + F.col("__start")).drop("__session", "__range", "__start", "__chunk", "__own")


def asked(message: Column) -> Column:
    """The trimmed message, null for a blank one, which is not sent."""
    text = trim_all(message)
    return F.when(F.length(text) > 0, text)


def last_question(events: DataFrame) -> DataFrame:
    """(session_id, seq, type, last_query) of every event, each delivered once."""
    once = delivered_once(events).select("session_id", "seq", "arrived_at", "type", "message")
    question = F.when(F.col("type") == "sendMessage", asked(F.col("message")))
    return carry_forward(once, question, "last_query").select("session_id", "seq", "type", "last_query")


def confirmed_patterns(events: DataFrame) -> DataFrame:
    """The patterns that confirmed forms save, with the session's last question; a blank name saves nothing."""
    once = delivered_once(events)
    question = F.when(F.col("type") == "sendMessage", asked(F.col("message")))
    state = carry_forward(once, question, "last_query").where("type = 'confirmSavePattern'")
    made = saved_row(F.col("last_query"), F.col("name"), F.col("description"), F.col("tags"), F.col("code"))
    return state.select("session_id", "seq", *[c.alias(n) for n, c in made.items()]).where("name != ''")


def view_events(events: DataFrame, replies: DataFrame) -> DataFrame:
    """(session_id, seq, step, type): what the view is told after each event.

    A question is echoed, typing starts, the context is shown, the reply is
    shown if there is one (else a notice), the save button is offered if the
    reply holds code, and typing stops. ``replies`` has session_id, seq and
    response. A confirmed form gives a notice and hides form and button; a
    cancelled one hides the form. Requests to save are told by ``save_events``.
    """
    once = delivered_once(events).select("session_id", "seq", "type", "message", "name")
    joined = once.join(replies.select("session_id", "seq", "response"), ["session_id", "seq"], "left")
    sent = (F.col("type") == "sendMessage") & asked(F.col("message")).isNotNull()
    said = lambda *names: F.array(*[F.lit(n) for n in names])
    told = (
        F.when(sent & contains_code(F.col("response")), said("addMessage", "startTyping", "addMessage", "addMessage", "showSaveButton", "stopTyping"))
        .when(sent, said("addMessage", "startTyping", "addMessage", "addMessage", "stopTyping"))
        .when((F.col("type") == "confirmSavePattern") & (F.length(trim_all(F.col("name"))) > 0), said("addMessage", "hideSaveForm", "hideSaveButton"))
        .when(F.col("type") == "cancelSave", said("hideSaveForm"))
        .otherwise(F.array().cast("array<string>"))
    )
    return joined.select("session_id", "seq", F.posexplode(told).alias("step", "type"))


def save_events(events: DataFrame, replies: DataFrame, held: Column | None = None) -> DataFrame:
    """(session_id, seq, step, type): what the view is told after each request to save.

    The form is shown if the reply to the session's last question holds a code
    block; without a question, a reply, text or a block there is a notice. A new
    question puts the reply before it out of reach, also if it has none itself.
    ``replies`` is as for ``view_events``; if ``held`` tells of its rows whether
    they hold a block, it needs no response.
    """
    held = F.size(code_blocks(F.col("response"))) > 0 if held is None else held
    # flags instead of texts, before anything is shuffled
    sent = (F.col("type") == "sendMessage") & asked(F.col("message")).isNotNull()
    once = delivered_once(events.select("session_id", "seq", "arrived_at", "type", sent.alias("sent"))).where("type IN ('sendMessage', 'savePattern')")
    joined = once.join(replies.select("session_id", "seq", held.alias("held")), ["session_id", "seq"], "left")
    offered = F.when(F.col("sent"), F.when(F.col("held"), "showSaveForm").otherwise("addMessage"))
    # the outcome travels on, not the reply; it is read several times below
    outcome = cut_lineage(joined.select("session_id", "seq", "type", offered.alias("offered")))
    state = carry_forward(outcome, F.col("offered"), "told")
    return state.where("type = 'savePattern'").select("session_id", "seq", F.lit(0).alias("step"), F.coalesce("told", F.lit("addMessage")).alias("type"))


def save_forms(events: DataFrame, replies: DataFrame) -> DataFrame:
    """What the save form shows after each request to save that gets one: (session_id, seq) and the columns of ``reply.save_form``.

    Question and reply are those of the session's last question before the
    request, not of its last one of all. ``replies`` has session_id, seq of the
    question, and response. Only the place of the question is carried forward;
    texts are met by it once.
    """
    sent = (F.col("type") == "sendMessage") & asked(F.col("message")).isNotNull()
    once = delivered_once(events.select("session_id", "seq", "arrived_at", "type", sent.alias("sent"))).where("type IN ('sendMessage', 'savePattern')")
    state = carry_forward(once.select("session_id", "seq", "type", "sent"), F.when(F.col("sent"), F.col("seq")), "asked_at").where("type = 'savePattern' AND asked_at IS NOT NULL")
    questions = delivered_once(events.where("type = 'sendMessage'").select("session_id", "seq", "arrived_at", "message")).select("session_id", F.col("seq").alias("asked_at"), asked(F.col("message")).alias("query"))
    known = questions.join(replies.select("session_id", F.col("seq").alias("asked_at"), "response"), ["session_id", "asked_at"])
    made = save_form(state.select("session_id", "seq", "asked_at").join(known, ["session_id", "asked_at"]))
    return made.where("status = 'form'").select("session_id", "seq", "code", "language", "suggested_name", "suggested_description", "suggested_tags")
