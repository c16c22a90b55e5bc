"""Rolling metrics over the last samples of each name, as a stream with state of its own."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State in lists needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastSamples(StatefulProcessor):
    """Holds the `last` newest samples of a name, by time and then id, so rows may come in any order."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "us long, id long, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(x) for x in self.samples.get()] if self.samples.exists() else []
        for batch in rows:
            held += list(zip(batch["us"].tolist(), batch["id"].tolist(), batch["value"].tolist()))
        held = heapq.nlargest(self.last, held, key=lambda x: x[:2])
        self.samples.put(held)
        values = sorted(v for *_, v in held)
        n = len(values)
        yield pd.DataFrame({"name": [key[0]], "n": [n], "avg": [round(sum(values) / n, 6)], "p50": [values[n // 2]], "p95": [values[min(n - 1, int(n * 0.95))]]})

    def close(self) -> None:
        pass


def rolling_latency(events: DataFrame, last: int = 200) -> DataFrame:
    """events (name, ts, event_id, value) -> after each batch, for the names it has rows of: name, n, avg, p50 (sorted[n // 2]) and
    p95 (sorted[min(n - 1, int(0.95 n))]) of their last samples. For update mode; samples without a value are left out, and the
    session's state store must be PROVIDER. The state of a name is `last` samples."""
    rows = events.where("name is not null and value is not null").select("name", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("name").transformWithStateInPandas(
        statefulProcessor=LastSamples(last), outputStructType="name string, n long, avg double, p50 double, p95 double", outputMode="update", timeMode="none"
    )
