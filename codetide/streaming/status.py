"""The latest status of every commit, kept by a stream of status events."""

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codetide.operators import events

# The state function travels with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATEST = "repo string, sha string, received_at long, event_id long, seq long, state string, description string"
_STATE = "received_at long, event_id long, seq long, state string, description string"
_NONE = -(1 << 63)


def _rank(row: tuple) -> tuple:
    """Order of `events.latest_status`: nulls first."""
    return tuple((v is not None, v if v is not None else "") if i > 2 else v for i, v in enumerate(row))


def latest_statuses(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """One row whenever a commit (repo, sha) gets a later status than any seen: by received_at, event_id and seq, as far as the stream has them.

    Redelivered and late events change nothing. The state of a commit is one row; with `idle_ms` it goes when the
    commit was idle for so long, and what arrives after that is judged by `current`. A stream with
    that time-out looks for idle commits for ever, so it does not fit a trigger that ends by itself.
    """
    present = set(stream.columns)
    received = F.unix_micros(F.col("received_at").cast("timestamp")) if "received_at" in present else F.lit(None)
    order = [received, *(F.col(c) if c in present else F.lit(None) for c in ("event_id", "seq"))]
    rows = stream.select("repo", "sha", *[F.coalesce(c.cast("bigint"), F.lit(_NONE)).alias(name) for c, name in zip(order, ("received_at", "event_id", "seq"))],
                         "state", "description")

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = best = tuple(state.get) if state.exists else None
        for part in parts:
            for row in part[["received_at", "event_id", "seq", "state", "description"]].itertuples(index=False, name=None):
                row = tuple(int(v) for v in row[:3]) + tuple(v if isinstance(v, str) else None for v in row[3:])
                if best is None or _rank(row) > _rank(best):
                    best = row
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if best != before:
            state.update(best)
            yield pd.DataFrame([(*key, *best)], columns=["repo", "sha", "received_at", "event_id", "seq", "state", "description"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("repo", "sha").applyInPandasWithState(follow, LATEST, _STATE, "append", timeout)


def start_statuses(stream: DataFrame, path: str, checkpoint: str, idle_ms: int | None = None, **trigger) -> StreamingQuery:
    """Follow the stream into the table at `path`, exactly once."""
    return latest_statuses(stream, idle_ms).writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(table: DataFrame) -> DataFrame:
    """repo, sha, state, description: the latest row of each commit in a table of `start_statuses`."""
    return events.latest_status(table)
