"""Session state in batch and over a stream."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import session
from quarrykit.streaming import chat

T0 = dt.datetime(2025, 1, 1)
COLUMNS = chat.EVENT_SCHEMA


def events(spark, rows):
    """rows: (session, seq, type, message, minutes late, form)"""
    made = [(s, n, T0, T0 + dt.timedelta(minutes=late), kind, message, *(form or (None,) * 4)) for s, n, kind, message, late, form in rows]
    return spark.createDataFrame(made, COLUMNS)


ROWS = [
    ("a", 1, "sendMessage", " q1 ", 0, None),
    ("a", 2, "savePattern", None, 0, None),
    ("a", 3, "sendMessage", "  ", 0, None),
    ("a", 4, "confirmSavePattern", None, 0, (" N ", " ", " a, ,b,", "package x")),
    ("a", 4, "confirmSavePattern", None, 9, (" N ", " ", " a, ,b,", "package x")),
    ("a", 5, "sendMessage", "q2", 0, None),
    ("a", 2500, "cancelSave", None, 0, None),
    ("b", 1, "showContext", None, 0, None),
    ("b", 2, "confirmSavePattern", None, 0, ("", "d", None, None)),
]
WANT = {("a", 1): "q1", ("a", 2): "q1", ("a", 3): "q1", ("a", 4): "q1", ("a", 5): "q2", ("a", 2500): "q2", ("b", 1): None, ("b", 2): None}


def test_last_question(spark):
    got = session.last_question(events(spark, ROWS)).collect()
    assert len(got) == len(WANT) and {(r.session_id, r.seq): r.last_query for r in got} == WANT


def test_numbered(spark):
    rows = spark.range(0, 300).select(F.lit("s").alias("session_id"), (F.col("id") * 3).alias("seq"))
    assert all(r.n == r.seq // 3 + 1 for r in session.numbered(rows, chunk=7).collect())


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_carry_forward_over_chunks(spark, levels):
    rows = spark.range(0, 500).select(F.lit("s").alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") % 37 == 5, F.col("id").cast("string")).alias("v"))
    got = {r.seq: r.last for r in session.carry_forward(rows, F.col("v"), "last", chunk=10, levels=levels).collect()}
    want, last = {}, None
    for i in range(500):
        last = str(i) if i % 37 == 5 else last
        want[i] = last
    assert got == want


def test_confirmed_patterns(spark):
    got = session.confirmed_patterns(events(spark, ROWS)).collect()
    assert [(r.name, r.language, r.type, r.description, r.tags) for r in got] == [("N", "java", "component", "q1", ["a", "b"])]


def test_view_events(spark):
    replies = spark.createDataFrame([("a", 1, "x"), ("a", 5, "public class")], "session_id string, seq bigint, response string")
    got = {}
    for r in session.view_events(events(spark, ROWS), replies).orderBy("session_id", "seq", "step").collect():
        got.setdefault((r.session_id, r.seq), []).append(r.type)
    assert got == {
        ("a", 1): ["addMessage", "startTyping", "addMessage", "addMessage", "stopTyping"],
        ("a", 4): ["addMessage", "hideSaveForm", "hideSaveButton"],
        ("a", 5): ["addMessage", "startTyping", "addMessage", "addMessage", "showSaveButton", "stopTyping"],
        ("a", 2500): ["hideSaveForm"],
    }


def test_save_events(spark):
    block = "text\n```java\nclass A {}\n```"
    rows = [
        ("a", 1, "savePattern", None, 0, None), ("a", 2, "sendMessage", "q", 0, None), ("a", 3, "savePattern", None, 0, None), ("a", 3, "savePattern", None, 9, None),
        ("a", 4, "sendMessage", " ", 0, None), ("a", 2500, "savePattern", None, 0, None), ("a", 2501, "sendMessage", "unanswered", 0, None), ("a", 2502, "savePattern", None, 0, None),
        ("b", 1, "sendMessage", "q", 0, None), ("b", 2, "savePattern", None, 0, None), ("c", 1, "sendMessage", "q", 0, None), ("c", 2, "savePattern", None, 0, None),
    ]
    replies = spark.createDataFrame([("a", 2, block), ("b", 1, "public class without a block"), ("c", 1, "")], "session_id string, seq bigint, response string")
    got = sorted(map(tuple, session.save_events(events(spark, rows), replies).collect()))
    form, notice = "showSaveForm", "addMessage"
    assert got == [("a", 1, 0, notice), ("a", 3, 0, form), ("a", 2500, 0, form), ("a", 2502, 0, notice), ("b", 2, 0, notice), ("c", 2, 0, notice)]


def test_stream_over_two_triggers(spark, tmp_path):
    events(spark, [r for r in ROWS if r[1] < 4]).coalesce(1).write.parquet(str(tmp_path / "in"))
    first = chat.run_to_end(chat.last_question_stream(chat.event_stream(spark, str(tmp_path / "in"))), str(tmp_path)).collect()
    assert {(r.session_id, r.seq): r.last_query for r in first} == {k: v for k, v in WANT.items() if k[1] < 4}
    import time

    time.sleep(1.1)
    events(spark, [r for r in ROWS if r[1] >= 4 or r[1] == 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = chat.last_question_stream(chat.event_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    both = chat.run_to_end(stream, str(tmp_path)).collect()
    assert {(r.session_id, r.seq): r.last_query for r in both} == WANT and len(both) == len(WANT)


def test_stream_over_three_triggers(spark, tmp_path):
    rows = [("hot", n, "sendMessage" if n % 700 == 5 else "savePattern", f"q{n}", 0, None) for n in range(1, 4001)]
    place = str(tmp_path / "in")
    for low, high in ((1, 1500), (1400, 3000), (3001, 4001)):
        part = [r for r in rows if low <= r[1] < high] + [r for r in ROWS if low <= r[1] < high] + [(None, low, "sendMessage", "x", 0, None)]
        events(spark, part).coalesce(1).write.mode("append").parquet(place)
        import time

        time.sleep(1.1)
    got = chat.run_to_end(chat.last_question_stream(chat.event_stream(spark, place, files_per_trigger=1)), str(tmp_path)).collect()
    want = {("hot", n): None if n < 5 else f"q{(n - 5) // 700 * 700 + 5}" for n in range(1, 4001) if n != 3000} | WANT
    assert {(r.session_id, r.seq): r.last_query for r in got} == want and len(got) == len(want)
    (tmp_path / "none").mkdir()
    assert chat.run_to_end(chat.last_question_stream(chat.event_stream(spark, str(tmp_path / "none"))), str(tmp_path)).collect() == []


def test_numbered_by(spark):
    rows = [("hot", f"r{i:04d}") for i in range(3000)] + [("b", "x"), (None, "y"), (None, "z"), ("b", None)]
    df = spark.createDataFrame(rows, "session_id string, request_id string").selectExpr("*", "7 as __n").repartition(5)
    got = {(r.session_id, r.request_id): r.n for r in session.numbered_by(df, "request_id").collect()}
    assert got == {**{("hot", f"r{i:04d}"): i + 1 for i in range(3000)}, ("b", None): 1, ("b", "x"): 2, (None, "y"): 1, (None, "z"): 2}
    assert session.numbered_by(df.limit(0), "request_id").collect() == []


def test_save_forms(spark):
    block = "text\n```java\npublic class {}Thing {{}}\n```"
    rows = [
        ("a", 1, "savePattern", None, 0, None), ("a", 2, "sendMessage", "make first thing", 0, None), ("a", 3, "savePattern", None, 0, None), ("a", 4, "sendMessage", "make second thing", 0, None),
        ("a", 2500, "savePattern", None, 0, None), ("a", 2500, "savePattern", None, 9, None), ("a", 2501, "sendMessage", "unanswered", 0, None), ("a", 2502, "savePattern", None, 0, None), ("b", 2, "savePattern", None, 0, None),
    ]
    replies = spark.createDataFrame([("a", 2, block.format("First")), ("a", 4, block.format("Second"))], "session_id string, seq bigint, response string")
    got = sorted((r.session_id, r.seq, r.suggested_name, r.suggested_description) for r in session.save_forms(events(spark, rows), replies).collect())
    assert got == [("a", 3, "FirstThing Pattern", "make first thing"), ("a", 2500, "SecondThing Pattern", "make second thing")]
    assert session.save_forms(events(spark, rows), replies.limit(0)).collect() == []


def test_replay(spark, tmp_path):
    rows = [("hot", n, "sendMessage" if n % 70 == 5 else "savePattern", f"q{n}", 0, None) for n in range(1, 1001)] + ROWS
    stream = chat.replay(events(spark, rows), str(tmp_path), ["seq", "session_id"], trigger_rows=200)
    got = chat.run_to_end(chat.last_question_stream(stream), str(tmp_path)).collect()
    want = {("hot", n): None if n < 5 else f"q{(n - 5) // 70 * 70 + 5}" for n in range(1, 1001)} | WANT
    assert {(r.session_id, r.seq): r.last_query for r in got} == want and len(got) == len(want)
    import glob

    assert len(glob.glob(f"{tmp_path}/stream-*/state/commits/[0-9]*")) >= 5
    none = chat.replay(events(spark, rows).limit(0), str(tmp_path), ["seq"])
    assert chat.run_to_end(chat.last_question_stream(none), str(tmp_path)).collect() == []
