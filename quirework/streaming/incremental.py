"""Incremental forms of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_items(items: DataFrame, checksum: str, received: str, delay: str) -> DataFrame:
    """The first item of each checksum in a stream. State is kept for `delay` after an item's time,
    so it is bounded; a copy that comes later than that is new again. Items without a checksum are
    dropped."""
    known = items.where(F.col(checksum).isNotNull()).withWatermark(received, delay)
    return known.dropDuplicatesWithinWatermark([checksum])


def counts_by_window(events: DataFrame, at: str, kind: str, width: str, delay: str) -> DataFrame:
    """Events of each kind counted by tumbling windows; late events are counted up to `delay`."""
    return (
        events.withWatermark(at, delay).groupBy(F.window(at, width), kind)
        .agg(F.count("*").alias("n")).select(F.col("window.start").alias("begins"), kind, "n")
    )


STATE = "failures int, stopped boolean"
OUT = "stream string, seq long, failures int, stopped boolean"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, stopped = state.get if state.exists else (0, False)
    rows = []
    for frame in frames:
        for seq, outcome in frame.sort_values("seq")[["seq", "outcome"]].itertuples(index=False):
            failures = 0 if outcome == "fetched" else failures + (outcome == "throttled")
            stopped = stopped or failures >= 5
            rows.append((key[0], seq, failures, stopped))
    state.update((failures, stopped))
    yield pd.DataFrame(rows, columns=["stream", "seq", "failures", "stopped"])


def fetch_states(log: DataFrame) -> DataFrame:
    """The fold of an attempt log (stream, seq, outcome): throttled answers in a row, set back by a
    fetched file, and whether there have been five. One number a stream is kept as state."""
    return log.groupBy("stream").applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
