"""Event streams: watched folders, windows with late data, sessions, and custom state (an extension)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def watch(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder; micro-batches run one after the other."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values of each kind by window; data later than ``late`` is left out."""
    w = F.window("ts", size)
    counts = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by a pause."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def transitions(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``(user_id, from, to, n)`` of each batch: transitions across batches, the last event kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kinds = ([last] if last else []) + rows["event_type"].tolist()
        state.update((kinds[-1],))
        pairs = pd.Series(list(zip(kinds, kinds[1:])), dtype=object).value_counts()
        yield pd.DataFrame([(key[0], a, b, int(n)) for (a, b), n in pairs.items()], columns=["user_id", "from", "to", "n"])

    grouped = events.withWatermark("ts", late).groupBy("user_id")
    return grouped.applyInPandasWithState(step, "user_id long, from string, to string, n long", "last string", "append", GroupStateTimeout.NoTimeout)


def answers(log: DataFrame, late: str = "10 minutes", patience: str = "30 seconds") -> DataFrame:
    """``(address, request, response, outcome)`` of a log (ts, seq, address, kind): each response with the first open
    request of its address, in order of time within a batch.

    Open requests are the state of an address. Eviction is an extension: a
    request that is older than ``patience`` when the watermark passes it leaves
    as ``unanswered``; a response without an open request leaves as ``early``.
    """
    wait = pd.Timedelta(patience)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, numbers = (list(x) for x in state.get) if state.exists else ([], [])
        open_requests = deque(zip(times, numbers))
        rows = []
        if not state.hasTimedOut:
            said = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
            for ts, seq, kind in zip(said["ts"], said["seq"].tolist(), said["kind"]):
                if kind == "request":
                    open_requests.append((int(ts.timestamp() * 1000), seq))
                elif open_requests:
                    rows.append((key[0], open_requests.popleft()[1], seq, "answered"))
                else:
                    rows.append((key[0], None, seq, "early"))
        now = state.getCurrentWatermarkMs()
        while open_requests and open_requests[0][0] + int(wait.total_seconds() * 1000) <= now:
            rows.append((key[0], open_requests.popleft()[1], None, "unanswered"))
        if open_requests:
            state.update(([t for t, _ in open_requests], [s for _, s in open_requests]))
            state.setTimeoutTimestamp(max(now + 1, open_requests[0][0] + int(wait.total_seconds() * 1000)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["address", "request", "response", "outcome"]).astype({"request": "Int64", "response": "Int64"})

    grouped = log.withWatermark("ts", late).groupBy("address")
    return grouped.applyInPandasWithState(step, "address string, request long, response long, outcome string", "times array<bigint>, numbers array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
