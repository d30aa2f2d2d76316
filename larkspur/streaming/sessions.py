"""Chat session state over a stream of messages, and an artifact sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

OUT = "session_id string, seq long, exam string, history_len int, answer string"
STATE = "exam string, roles array<string>, texts array<string>, last long, due long"
#: A session without messages for so long is forgotten.
IDLE_MS = 24 * 3600 * 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionProcessor(StatefulProcessor):
    """A session's exam and its last turns.

    Where messages have a time (at_ms) one that comes idle_ms or more after the one before finds no history,
    and a timer removes the state once the watermark is so far.
    """

    def __init__(self, keep: int, idle_ms: int, timed: bool) -> None:
        self.keep, self.idle_ms, self.timed = keep, idle_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (names that Spark calls)
        exam, roles, texts, last, due = self.session.get() or (None, [], [], None, None)
        roles, texts = list(roles), list(texts)
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            at = row["at_ms"] if self.timed else None
            if (exam is not None and row["exam"] != exam) or (last is not None and at is not None and at - last >= self.idle_ms):
                roles, texts = [], []
            exam, last = row["exam"], at
            out.append((key[0], row["seq"], exam, len(roles), row["answer"]))
            if row["answer"]:
                roles, texts = (roles + ["user", "assistant"])[-self.keep :], (texts + [row["query"], row["answer"]])[-self.keep :]
        if self.timed:
            if due is not None:
                self.handle.deleteTimer(due)
            due = max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
        self.session.update((exam, roles, texts, last, due))
        yield pd.DataFrame(out, columns=["session_id", "seq", "exam", "history_len", "answer"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.session.clear()
        yield from ()

    def close(self) -> None:
        pass


def session_turns(messages: DataFrame, keep: int = 6, time: str | None = None, idle_ms: int = IDLE_MS, late: str = "10 minutes") -> DataFrame:
    """messages: a stream of session_id, seq, exam, query, answer.  For each message the length of the history it was asked with.

    The history is cleared when the exam changes; question and answer go behind it if the answer isn't empty.  Only the last
    `keep` turns are kept in the state.  time: a timestamp of the messages; sessions that were idle for idle_ms are then
    forgotten, their state once the watermark (`late` behind the newest message) is so far.  Without it a session is
    kept for ever.  The state store is set to RocksDB, which such state needs, where no other one than Spark's default is set.
    """
    conf = messages.sparkSession.conf
    if conf.get(_PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        conf.set(_PROVIDER, _ROCKS)
    columns = ["session_id", "seq", "exam", "query", "answer"]
    rows = messages.select(*columns) if time is None else messages.withWatermark(time, late).select(*columns, time, F.unix_millis(time).alias("at_ms"))
    return rows.groupBy("session_id").transformWithStateInPandas(SessionProcessor(keep, idle_ms, time is not None), OUT, "append", "None" if time is None else "EventTime")


def artifact_sink(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Records appended to a folder of JSON lines, exactly once."""
    return rows.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window of event time; later ones than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
