"""Progress events as streams: last values per run, windowed counts, and runs that fell silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "runId string, event string, phase string, message string, timestamp timestamp, counters map<string,double>"


def read_events(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    """JSON lines of a folder; lines that don't parse are dropped."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT).option("mode", "DROPMALFORMED").json(folder).filter("runId is not null")


def counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; rows later than ``late`` behind the newest are left out."""
    grouped = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", size), "event")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "event", "n")


def runs(events: DataFrame, silent_after: str = "5 minutes") -> DataFrame:
    """(runId, phase, events, last, status): a row whenever a run moves, and ``stale`` once it is silent too long.

    State is one row a run; the timeout follows event time, so replays give the same rows.
    """
    wait = int(pd.Timedelta(silent_after).total_seconds() * 1000)

    def step(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            phase, n, last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], phase, n, pd.Timestamp(last, unit="ms"), "stale")], columns=["runId", "phase", "events", "last", "status"])
            return
        phase, n, last = state.get if state.exists else (None, 0, 0)
        for g in groups:
            n += len(g)
            newest = g.loc[g["timestamp"].idxmax()]
            at = int(newest["timestamp"].value // 1_000_000)
            if at >= last:
                last, phase = at, newest["phase"]
        ended = phase in ("completed", "failed")
        if ended:
            state.remove()
        else:
            state.update((phase, n, last))
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], phase, n, pd.Timestamp(last, unit="ms"), phase if ended else "running")], columns=["runId", "phase", "events", "last", "status"])

    out = "runId string, phase string, events long, last timestamp, status string"
    keyed = events.withWatermark("timestamp", "0 seconds").groupBy("runId")
    return keyed.applyInPandasWithState(step, out, "phase string, events long, last long", "append", GroupStateTimeout.EventTimeTimeout)
