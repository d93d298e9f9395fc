"""Session state over a stream of chat events."""
from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrykit.functions.textfn import trim_all

EVENT_SCHEMA = "session_id string, seq bigint, ts timestamp, arrived_at timestamp, type string, message string, name string, description string, tags string, code string"
OUT_SCHEMA = "session_id string, seq bigint, type string, last_query string"
STATE_SCHEMA = "last_query string, last_seq bigint"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """Chat events as they arrive in the Parquet files below ``path``, or in the one file that it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    if files.getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def by_kind(events: DataFrame, *kinds: str) -> DataFrame:
    """The events of the given kinds; works on streams and tables."""
    return events.where(F.col("type").isin(*kinds))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # a trigger's rows of one session come in no order: they are sorted here, and the state carries over triggers
    last, seen = state.get if state.exists else (None, -1)
    rows = pd.concat(list(batches)).drop_duplicates("seq").sort_values("seq")
    rows = rows[rows.seq > seen]
    if len(rows):
        asked = rows.question.ffill()
        rows = rows.assign(session_id=key[0], last_query=asked.where(asked.notna(), last))
        last, seen = rows.last_query.iloc[-1], int(rows.seq.iloc[-1])
        yield rows[["session_id", "seq", "type", "last_query"]]
    state.update((None if last is None or pd.isna(last) else last, seen))


def _questions(events: DataFrame) -> DataFrame:
    text = trim_all(F.col("message"))
    question = F.when((F.col("type") == "sendMessage") & (F.length(text) > 0), text)
    return events.where("session_id IS NOT NULL").select("session_id", "seq", "type", question.alias("question"))


def last_question_stream(events: DataFrame) -> DataFrame:
    """Each event with its session's last question so far, as a stream.

    Within a trigger the events of a session are put in order of ``seq`` and a
    repeated delivery counts once; over triggers an event whose ``seq`` is not
    above the last one seen was delivered before or came too late, and is
    dropped. A session's state is two values. One task sorts what a trigger has
    of a session, so the trigger's size must be bounded, as ``event_stream`` and
    ``replay`` do.
    """
    return _questions(events).groupBy("session_id").applyInPandasWithState(_advance, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, folder: str, order: list[str], trigger_rows: int = 250_000, least: int = 4) -> DataFrame:
    """A stream over the rows of a table in the order of ``order``, of about ``trigger_rows`` rows a trigger.

    The rows are written below ``folder``, which all executors share, one file
    for each range of ``order``. The file source takes files by age, so theirs
    are set in that order; the driver touches as many files as there are
    triggers. There are ``least`` triggers at least, fewer for a few rows.
    """
    spark = events.sparkSession
    triggers = max(least, -(-events.count() // trigger_rows))
    place = os.path.join(folder, f"replay-{uuid.uuid4().hex}")
    names = [f.split(" ")[0] for f in EVENT_SCHEMA.split(", ")]
    events.select(*names).repartitionByRange(triggers, *order).write.parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    written = sorted((f.getPath() for f in files.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    now = int(time.time() * 1000)
    for i, file in enumerate(written):
        files.setTimes(file, now - 1000 * (len(written) - i), -1)
    return event_stream(spark, place, files_per_trigger=1)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Process all that is there, write it below ``folder`` and read it back as a table.

    ``folder`` must be one that all executors share. The checkpoint beside the
    output makes the run repeatable after a loss. Keyed state is held by RocksDB
    stores, on disk and only as changes in the checkpoint.
    """
    spark = stream.sparkSession
    place = os.path.join(folder, f"stream-{uuid.uuid4().hex}")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
