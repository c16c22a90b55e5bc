"""Streams with state of their own: summaries that fall due, and memories that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def summary_trigger(messages: DataFrame, least: int = 8, chars: int = 5000) -> DataFrame:
    """messages (session_id, id, content) -> a row (session_id, covered, n, chars) whenever the messages since the last one reach
    `least` or `chars`; then the count starts anew. Within a batch messages go by id; ids up to the last one taken are
    left out, so a message sent twice counts once. State is three numbers a session."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, n, size = state.get if state.exists else (-1, 0, 0)
        rows = pd.concat(list(batches)).drop_duplicates("id").sort_values("id")
        out = []
        for i, length in zip(rows["id"].tolist(), rows["size"].tolist()):
            if i > seen:
                seen, n, size = i, n + 1, size + length
                if n >= least or size >= chars:
                    out.append((key[0], seen, n, size))
                    n = size = 0
        state.update((seen, n, size))
        yield pd.DataFrame(out, columns=["session_id", "covered", "n", "chars"])

    kind = dict(messages.dtypes)["session_id"]
    rows = messages.where("id is not null").select("session_id", F.col("id").cast("long").alias("id"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("size"))
    return rows.groupBy("session_id").applyInPandasWithState(
        step, f"session_id {kind}, covered long, n long, chars long", "seen long, n long, chars long", "append", GroupStateTimeout.NoTimeout
    )


def memory_state(events: DataFrame, ttl_minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """events (memory_id, ts, kind write or read, content) -> (memory_id, content, expires_at, alive) after each batch with events of
    the memory, and once when it expires. A write sets the content, a read keeps alive; both move expiry to ts + ttl. A read
    after expiry revives nothing. Time is event time; state goes when the watermark passes expiry."""
    ttl = ttl_minutes * 60_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, until = state.get if state.exists else (None, -1)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"memory_id": [key[0]], "content": [content], "expires_ms": [until], "alive": [False]})
            return
        rows = pd.concat(list(batches)).sort_values(["ms", "kind"])
        for ms, kind, text in zip(rows["ms"].tolist(), rows["kind"].tolist(), rows["content"].tolist()):
            if kind == "write":
                content, until = text, max(until, ms + ttl)
            elif ms < until:
                until = max(until, ms + ttl)
        if until < 0:
            return
        state.update((content, until))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"memory_id": [key[0]], "content": [content], "expires_ms": [until], "alive": [True]})

    kind = dict(events.dtypes)["memory_id"]
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("memory_id", "ts", F.unix_millis("ts").alias("ms"), "kind", "content")
    found = rows.groupBy("memory_id").applyInPandasWithState(
        step, f"memory_id {kind}, content string, expires_ms long, alive boolean", "content string, until long", "update", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("memory_id", "content", F.timestamp_millis("expires_ms").alias("expires_at"), "alive")
