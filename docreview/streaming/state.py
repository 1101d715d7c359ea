"""Streaming forms of the state operators. Events carry an event-time column `ts` of type timestamp."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _History(StatefulProcessor):
    """Last n ids of a key in list state; every batch emits the history as it stands."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "ts timestamp, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.items.get()) if self.items.exists() else []
        for pdf in rows:
            kept.extend(zip(pdf["ts"].dt.to_pydatetime(), pdf["id"].astype(int)))
            kept = sorted(kept)
            if self.limit > 0:
                kept = kept[-self.limit:]
        self.items.put([(ts, int(i)) for ts, i in kept])
        yield pd.DataFrame({"key": [key[0]] * len(kept), "id": [int(i) for _, i in kept],
                            "age": range(len(kept), 0, -1)})

    def close(self) -> None:
        pass


def stream_bounded_history(events: DataFrame, limit: int) -> DataFrame:
    """`events(key long, id long, ts)` -> (key, id, age) after every batch that touches the key."""
    return events.groupBy("key").transformWithStateInPandas(_History(limit), "key long, id long, age long", "Update", "None")


class _Admission(StatefulProcessor):
    """Admission times of a key inside the window; rejected requests leave no trace."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.width = limit, pd.Timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [pd.Timestamp(r[0]) for r in self.times.get()] if self.times.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])
        flags = []
        for ts in batch["ts"]:
            kept = [t for t in kept if t > ts - self.width]
            flags.append(len(kept) < self.limit)
            if flags[-1]:
                kept.append(ts)
        self.times.put([(t.to_pydatetime(),) for t in kept])
        yield pd.DataFrame({"key": key[0], "id": batch["id"].to_numpy(), "admitted": flags})

    def close(self) -> None:
        pass


def stream_admission(events: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """`events(key long, id long, ts)` -> (key, id, admitted); the source delivers requests in order of time."""
    return events.groupBy("key").transformWithStateInPandas(
        _Admission(limit, seconds), "key long, id long, admitted boolean", "Append", "None")


class _Store(StatefulProcessor):
    """Latest value of a (namespace, key) that expires by itself."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", "value double, updated_at timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values(["updated_at", "value"]).iloc[-1]
        known = self.item.get() if self.item.exists() else None
        stamp = last["updated_at"].to_pydatetime()
        if known is not None and known[1] > stamp:
            return
        if last["op"] == "delete":
            self.item.clear()
        else:
            self.item.update((float(last["value"]), stamp))
        yield pd.DataFrame({"namespace": [key[0]], "key": [key[1]], "value": [last["value"]], "updated_at": [last["updated_at"]],
                            "op": [last["op"]]})

    def close(self) -> None:
        pass


def stream_ttl_store(puts: DataFrame, ttl_hours: float = 24) -> DataFrame:
    """`puts(namespace, key long, value double, updated_at, op)` -> changes of the store; values leave after their TTL.

    Processing-time state keeps asking for further batches: run it continuously or with `once`, not with `availableNow`.
    """
    ttl_ms = int(ttl_hours * 3_600_000) if ttl_hours > 0 else None
    return puts.groupBy("namespace", "key").transformWithStateInPandas(
        _Store(ttl_ms), "namespace string, key long, value double, updated_at timestamp, op string", "Update", "ProcessingTime")


def stream_running_metrics(events: DataFrame) -> DataFrame:
    """Count and mean per status; run in complete or update mode."""
    return events.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("avg_value"))


def stream_metrics_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same per tumbling window; windows close once the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("avg_value")).select(
        F.col("window.start").alias("window_start"), "status", "n", "avg_value")


def stream_request_rate(events: DataFrame, width: str = "60 seconds", slide: str = "10 seconds", late: str = "60 seconds") -> DataFrame:
    """Requests per key in sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "key").agg(F.count("*").alias("rate")).select(
        F.col("window.end").alias("window_end"), "key", "rate")


def stream_silent_runs(events: DataFrame, timeout: str = "900 seconds", late: str = "60 seconds") -> DataFrame:
    """Sessions of a running record; a closed session means that it has been silent for the timeout."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", timeout), "key").agg(F.count("*").alias("n")).select(
        "key", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("silent_at"), "n")


def stream_dedupe(events: DataFrame, key: str = "id", late: str = "1 hour") -> DataFrame:
    """First submission per id; ids are forgotten once the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stream_latest_status(events: DataFrame, outcome: dict[str, str]) -> DataFrame:
    """Status per key from its last terminal event; run in update mode into `upsert_to`."""
    pairs = F.create_map(*[F.lit(x) for item in outcome.items() for x in item])
    return events.filter(F.col("kind").isin(list(outcome))).groupBy("key").agg(
        F.max_by(F.element_at(pairs, F.col("kind")), F.struct("ts", "id")).alias("status"), F.max("ts").alias("updated_at"))


def upsert_to(path: str, key: str = "key", stamp: str = "updated_at") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: one folder per batch, so a repeated batch replaces itself; see `read_upserts`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserts(spark, path: str, key: str = "key") -> DataFrame:
    """The newest row per key over all batches."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
